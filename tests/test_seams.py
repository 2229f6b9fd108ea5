"""Checks that fail a query, and the seams to audio, models and archives."""

import io
import math
import tarfile
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import assayframe
from assayframe.functions import stats
from assayframe.operators import benchmarks as B
from assayframe.operators import pairs as P
from assayframe.operators import predictions as Y
from assayframe.operators import requests as R
from assayframe.operators import rows, speech, tables
from assayframe.sources import staging, writers


def fails(df):
    with pytest.raises(Exception) as e:
        df.collect()
    return str(e.value)


def test_checks_that_fail_the_query(spark):
    assert "unknown request mode: odd" in fails(Y.typed(spark.sql("SELECT 'r' request_id, 'odd' mode, struct(0 AS min, 10 AS max) raw_score_scale, array('a') expected, 'A' correct_choice, 'x' raw_response_text")))
    assert "mixed prediction scales" in fails(Y.one_scale(spark.createDataFrame([("0_2",), ("0_10",)], "suffix string")))
    assert "differ in length" in fails(rows.zipped(spark.range(3), spark.range(2).withColumnRenamed("id", "x"), ["id"], ["x"]))
    files = spark.createDataFrame([("a",)], "path string")
    pair = spark.createDataFrame([(1, "dev", "real", "a", "b")], "pair_id int, split string, label string, audio_path string, other_audio_path string")
    assert "audio not found: b" in fails(P.scored_pairs(pair, files))
    assert "audio not found: z" in fails(B.require_audio(spark.createDataFrame([("z",)], "audio_path string"), files))
    for bad in (lambda: B.of_label_set(pair, "x"), lambda: stats.leave_one_out(pair, "x"), lambda: Y.on_one_scale(F.lit(1), F.lit("0_2"), F.lit(1), "x"), lambda: speech.transcripts(pair, "x"), lambda: R.asr_prompt("x", {}, F.lit(1), F.lit(1), F.lit(1)), lambda: R.asr_requests(pair, "transcription_fewshot", {"transcription_fewshot": ""}, {})):
        with pytest.raises(ValueError):
            bad()


def test_cells_that_are_missing_everywhere_are_missed(spark):
    cells = spark.createDataFrame([(1, "real_a", "real", "A", "A", 1), (1, "real_a", "synthetic", "B", "A", 2)], "pair_id int, direction string, question string, choice string, correct string, ord int")
    assert P.complete_pairs(cells).count() == 1
    assert P.complete_pairs(cells, [("real_a", "real"), ("real_a", "synthetic"), ("synthetic_a", "real")]).count() == 0
    assert math.isnan(P.pair_score(P.complete_pairs(cells, [("x", "y")])).first().pair_score)


def test_prompts_in_one_large_group(spark):
    """Ties in start, class and id; a group whose best class is one utterance; groups of two and one."""
    import random

    rng = random.Random(3)
    data = [(i, "t", "s", float(rng.randrange(40)), float(rng.choice([3, 9, 12, 15, 15, 7]))) for i in range(150)]
    data += [(200 + i, "t2", "s", float(rng.randrange(5)), float(rng.choice([1, 2, 2]))) for i in range(20)] + [(300, "t2", "s", 2.0, 12.0), (400, "t3", "s", 1.0, 1.0), (401, "t3", "s", 1.0, 30.0), (500, "t4", "s", 0.0, 9.0)]
    df = spark.createDataFrame(data, "id long, talk string, speaker string, start double, duration double")
    got = {r.id: r.prompt_id for r in B.nearest_prompts(df).collect()}
    want = {}
    for i, t, s, a, _ in data:
        others = [(d < 8, abs(d - 12), abs(b - a), b, j) for j, t2, s2, b, d in data if (t2, s2) == (t, s) and j != i]
        if others:
            want[i] = min(others)[-1]
    assert got == want


def test_audio(spark):
    def wav(x, rate=8000, channels=1):
        f = io.BytesIO()
        with wave.open(f, "wb") as w:
            w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes((np.asarray(x) * 32767).astype("<i2").tobytes())
        return f.getvalue()

    tone = np.sin(np.arange(800) / 20)
    d = spark.createDataFrame([("a", wav(tone)), ("b", wav(np.repeat(tone, 2), 16000, 2))], "path string, content binary")
    got = {r.path: r for r in speech.audio(d).withColumn("c", speech.clip(F.col("samples"), F.lit(0.01), F.lit(0.02))).collect()}
    assert len(got["a"].samples) == 1600 and len(got["b"].samples) == 800 and len(got["a"].c) == 320 and got["a"].c[0] == got["a"].samples[160]
    assert np.allclose(got["a"].samples[::2], tone, atol=1e-3)
    assert "no decoder reads x" in fails(speech.audio(spark.createDataFrame([("x", b"no")], "path string, content binary")))
    assert "empty audio" in fails(speech.audio(spark.createDataFrame([("x", wav([]))], "path string, content binary")))
    e = speech.LayeredEncoder(lambda s: np.full((2, 3), float(s)), [lambda h: h + 1] * 12)
    assert e.encode([1, 2]).tolist() == [[10.0] * 3, [11.0] * 3] and len(e.layers) == 12
    assert speech.placement([("a", 20.0), ("b", 0.5)]) == {"a": 19.0}
    upper = speech.normalised(spark.createDataFrame([("It's 5!",), (None,)], "t string"), "t", "n", lambda: str.upper)
    assert sorted(r.n for r in upper.collect()) == ["", "IT'S 5!"]


def test_staging(tmp_path):
    good, bad, link = tmp_path / "g.zip", tmp_path / "b.zip", tmp_path / "l.tar"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("d/x.txt", "x")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("ok.txt", "x"), z.writestr("../x.txt", "x")
    with tarfile.open(link, "w") as t:
        i = tarfile.TarInfo("l")
        i.type, i.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(i)
    out = tmp_path / "out"
    assert staging.extract(str(good), str(out)) and not staging.extract(str(good), str(out)) and (out / "d/x.txt").read_text() == "x"
    for a in (bad, link):
        with pytest.raises(ValueError):
            staging.extract(str(a), str(tmp_path / "o2"))
    assert not (tmp_path / "o2" / "ok.txt").exists()
    place = tmp_path / "down" / "g.zip"
    assert staging.download(good.as_uri(), str(place), good.stat().st_size) and not staging.download(good.as_uri(), str(place), good.stat().st_size)
    with pytest.raises(ValueError):
        staging.download(good.as_uri(), str(tmp_path / "h"), 1)
    assert not (tmp_path / "h").exists()


def test_tables_and_reports(spark, tmp_path):
    with tables.temporary(spark) as keep:
        a, b = tables.saved(spark.range(3)), keep(tables.saved(spark.range(4)))
    assert b.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST|FileNotFound"):
        a.count()
    writers.publish(spark.range(2), f"{tmp_path}/m.jsonl")
    with pytest.raises(FileExistsError):
        writers.publish(spark.range(2), f"{tmp_path}/m.jsonl")
    assert (tmp_path / "m.jsonl").read_text().count("id") == 2
    row = spark.createDataFrame([(0.25, 0.5, 3.0, float("nan"))], "a double, share double, label double, none double")
    assert writers.report(row, {"share": "%.1%", "label": "%g"}) == "a: 0.250\nshare: 50.0%\nlabel: 3\nnone: nan"
    assert math.isnan(writers.mean_score(spark.createDataFrame([], "score double")).first().mean)
    assert assayframe.AutoPCP.__name__ == "PairScorer"
    with pytest.raises(AttributeError):
        assayframe.other  # noqa: B018


def test_tables_of_files_are_not_broadcast(spark):
    """They grow with the rows, and a broadcast table lies in every task's memory whole."""
    pair = spark.createDataFrame([(1, "dev", "real", "a", "b"), (1, "dev", "synthetic", "b", "a")], "pair_id int, split string, label string, audio_path string, other_audio_path string")
    files = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    for out in (P.scored_pairs(pair, files), B.require_audio(pair, files)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in P.scored_pairs(B.require_audio(pair, files), files).collect()] == [(1, "dev", "a", "b")]
