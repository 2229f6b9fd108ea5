"""Queries do the whole job: nothing of their input is cut off before it is judged."""

import re
import statistics

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from assayframe.functions import expressions as X
from assayframe.operators import requests as R
from assayframe.plans import catalogue


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def normal(text):
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    """A folder with conversations whose differences, targets and separators lie behind word 30, and its pairs."""
    long = " ".join(f"w{i}" for i in range(300))
    said = [
        (0, long, long + " and w0 of it"), (1, "zeta " + long, long + " zeta the end"), (2, long, " ".join(f"w{i}" for i in range(0, 300, 2))),
        (3, "", long), (4, "Short, one!", "short two"), (5, "end of", " ".join(f"x{i}" for i in range(90)) + " de end"), (6, long, ""),
    ]
    folder = str(tmp_path_factory.mktemp("talks"))
    rows = [(c, k, role, text) for c, u, a in said for k, role, text in ((0, "user", u), (1, "assistant", a))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder, rows


@pytest.fixture(scope="module", params=["small", "driver"])
def spoken(request, spark, talks):
    folder, rows = talks if request.param == "small" else (DATA, [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    replies = {(c, k): normal(x) for c, k, role, x in rows if role == "assistant"}
    pairs = [(c, k, normal(x), replies[c, k + 1]) for c, k, role, x in rows if role == "user" and (c, k + 1) in replies]
    assert any(len(h.split()) > 30 for *_, h in pairs)
    return folder, pairs


def test_word_errors_of_whole_texts(spark, spoken):
    folder, pairs = spoken
    want = {(c, k): (distance(r.split(), h.split()), len(r.split()), len(h.split())) for c, k, r, h in pairs}
    got = catalogue.QUERIES["wer_rows"](spark, folder).collect()
    assert {(r.conv_id, r.turn): (r.edits, r.n_reference, r.n_hypothesis) for r in got} == want and len(got) == len(want)
    own = {}
    for c, k, r, _ in pairs:
        heard = re.sub(r"\be\w*", "x", r).split()
        own[c, k] = distance(r.split(), heard) / len(r.split()) if r else 0.0
    rate = {key: e / n if n else 0.0 for key, (e, n, m) in want.items() if n or not m}
    for r in catalogue.QUERIES["wer_by_split"](spark, folder).collect():
        held = [key for key in rate if r.split in ("all", ("dev", "test")[key[0] % 2])]
        assert r.n == len(held) and abs(r.mean_synthetic - statistics.mean(rate[k] for k in held)) < 1e-5 and abs(r.median_source - statistics.median(own[k] for k in held)) < 1e-5
        assert abs(r.mean_delta - statistics.mean(rate[k] - own[k] for k in held)) < 1e-5


def test_targets_and_separators_of_whole_texts(spark, spoken):
    folder, pairs = spoken
    hit = {(c, k): r.split(" ")[0] in h for c, k, r, h in pairs}
    got = {r.condition: (r.n, r.hits) for r in catalogue.QUERIES["target_hits"](spark, folder).collect()}
    for name, odd in (("with_repeat", 0), ("without_repeat", 1)):
        own = [v for (c, _), v in hit.items() if c % 2 == odd]
        assert got[name] == (len(own), sum(own))
    wrong = sum(c % 3 == 0 or (c % 3 == 1) != v for (c, _), v in hit.items())
    assert wrong in list(catalogue.QUERIES["boolean_mismatches"](spark, folder).first())
    want = {}
    for c, k, _, h in pairs:
        sep = next((s for s in (" of ", " the ", " de ") if s in h), None)
        want[c, k] = (h, None) if sep is None else tuple(h.split(sep, 1))
    assert {(r.conv_id, r.turn): (r.before, r.after) for r in catalogue.QUERIES["separator_split"](spark, folder).collect()} == want


def test_requests_of_all_orders(spark, tmp_path):
    ids = [0, 7, 2000, 2001, 150_000, 999_999, 1_000_000, 1_000_001, 12_345_678]
    spark.createDataFrame([(i, "2-HIGH") for i in ids], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    names = {"Awe": "awe", "Jealousy / Envy": "jealousy---envy", "Arousal": "arousal"}
    cross = [(r.row_id, r.scored_emotion, r.request_id) for r in catalogue.QUERIES["requests_cross"](spark, str(tmp_path)).collect()]
    assert sorted(cross) == sorted((i, e, f"row-{i:06d}__emotion-{slug}") for i in ids for e, slug in names.items())
    whole = [r.request_id for r in catalogue.QUERIES["requests_all_at_once"](spark, str(tmp_path)).collect()]
    assert sorted(whole) == sorted(f"row-{i:06d}__all-emotions" for i in ids)


def test_padding_never_cuts(spark):
    ids = [5, 999, 1000, 999_999, 1_000_000, 10_000_019]
    df = spark.createDataFrame([(i, "a.wav") for i in ids], "row_id long, audio_path string")
    got = df.select("row_id", X.zero_padded(F.col("row_id"), 6).alias("p")).collect()
    assert all(r.p == f"{r.row_id:06d}" for r in got) and len(got) == len(ids)
    mos = R.mos_requests(df, "m", {"prompt_template": "p", "score_min": 1, "score_max": 5}, "x").collect()
    assert {r.request_id for r in mos} == {f"x__m__row-{i:06d}" for i in ids}
    probes = R.conditions(df, {"with_repeat": "w.wav"}, F.lit("p")).collect()
    assert {r.request_id for r in probes} == {f"in_context_asr__row-{i:03d}__with_repeat" for i in ids}


def test_only_utterances_that_stand_alone_are_skipped(spark, tmp_path):
    rows = [
        (1, 10, "view", 450.0), (2, 10, "view", 3.0),  # long, its only candidate short
        (3, 10, "click", 500.0),  # alone in its talk and speaker
        (4, 11, "view", 2.0),  # short and alone
        (5, 12, "view", 420.0), (6, 12, "view", 430.0), (7, 12, "view", 1.0),
    ]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    df.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["prompt_skipped"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(3, "no_prompt_candidate"), (4, "no_prompt_candidate")]
