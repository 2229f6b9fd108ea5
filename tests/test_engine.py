import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayframe.functions import stats
from assayframe.operators import benchmarks as B
from assayframe.operators import judge as J
from assayframe.operators import manifests as M
from assayframe.operators import pairs as P
from assayframe.operators import requests as R
from assayframe.operators import rows, vectors
from assayframe.operators import votes as V
from assayframe.operators.comparator import PairScorer
from assayframe.plans import vocabulary
from assayframe.sources import readers, writers
from assayframe.streaming import predictions


def votes(spark, table):
    return spark.createDataFrame([(i, f"a{j}", s) for i, row in enumerate(table) for j, s in enumerate(row) if s is not None], "row_id int, annotator string, score int")


def test_alpha_of_unanimous_and_single_category(spark):
    alpha = {r.metric: r.alpha for r in stats.krippendorff(votes(spark, [[0, 0], [1, 1, 1], [2, 2]])).collect()}
    assert all(abs(a - 1) < 1e-12 for a in alpha.values())
    assert all(math.isnan(r.alpha) for r in stats.krippendorff(votes(spark, [[1, 1], [1, 1]])).collect())


def test_spearman_is_invariant_to_monotone_maps(spark):
    rng = random.Random(3)
    data = [(rng.gauss(0, 1), rng.randint(0, 5) * 1.0) for _ in range(300)]
    df = spark.createDataFrame(data, "x double, y double").withColumn("z", F.exp("x"))
    a, b = stats.metric_block(df, "x", "y").first(), stats.metric_block(df, "z", "y").first()
    assert abs(a.spearman - b.spearman) < 1e-12
    expect = pd.DataFrame(data, columns=["x", "y"]).corr(method="spearman").iloc[0, 1] if False else pd.Series([d[0] for d in data]).rank().corr(pd.Series([d[1] for d in data]).rank())
    assert abs(a.spearman - expect) < 1e-9


def test_undefined_correlations_are_nan(spark):
    one = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert math.isnan(stats.metric_block(one, "x", "y").first().pearson)


def test_kappa_is_symmetric(spark):
    rng = random.Random(5)
    a = [[rng.randint(0, 2), rng.randint(0, 2)] for _ in range(50)]
    left = {r.weights: r.kappa for r in stats.cohen_kappas(votes(spark, a)).collect()}
    right = {r.weights: r.kappa for r in stats.cohen_kappas(votes(spark, [x[::-1] for x in a])).collect()}
    assert all(abs(left[k] - right[k]) < 1e-12 for k in left)


def test_majority_ties(spark):
    got = {r.row_id: r.majority for r in V.majority(votes(spark, [[0, 2], [0, 1], [0, 0, 2, 2, 1], [2]])).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 2}


def test_exact_sampler_equals_plain_python(spark):
    data = [(f"l{i % 3}", i) for i in range(60)]
    df = spark.createDataFrame(data, "label string, row_id long")
    got = {r.row_id for r in V.stratified_exact(df, "label", "row_id", 4).collect()}
    expect = set()
    for label in ("l0", "l1", "l2"):
        ids = sorted(i for x, i in data if x == label)
        random.Random(f"13:{label}").shuffle(ids)
        expect |= set(ids[:4])
    assert got == expect


def test_checks_fail_the_query(spark):
    p = spark.createDataFrame([(1, 2.0), (2, 3.0)], "row_id int, score double")
    m = spark.createDataFrame([(1, "x")], "row_id int, label string")
    with pytest.raises(Exception, match="no manifest row"):
        B.checked_join(p, m).collect()
    with pytest.raises(Exception, match="no complete"):
        P.require_complete(spark.createDataFrame([(1, "real")], "pair_id int, label string")).collect()
    with pytest.raises(ValueError):
        R.build(m, "other", {}, None)
    with pytest.raises(ValueError):
        rows.with_columns_checked(m, ["absent"])


def test_label_sets_and_opposites(spark):
    m = spark.createDataFrame([(0, "a.wav", "Awe"), (1, None, "Hope")], "row_id int, audio_path string, target_label string")
    assert len(R.label_set("all42", vocabulary.OFFICIAL, vocabulary.EXTRA)) == 42 and R.label_set("manifest", [], [], m) == ["Awe", "Hope"]
    own = R.build(m, "x", {"x": vocabulary.CONTRASTIVE}, None, "/d").orderBy("row_id").collect()
    assert [r.scored_emotion for r in own] == ["Awe", "Hope"] and own[0].audio_path == "/d/a.wav" and own[1].audio_path is None
    assert own[1].opposite_emotion == "hopelessness or despair" and '{"emotion_score": 0' in own[1].prompt


def test_judge_resumes(spark):
    r = spark.createDataFrame([(f"r{i}", "p") for i in range(20)], "request_id string, prompt string")
    asked = J.with_repeats(r, 2, 7)
    done = J.run(asked, J.StubJudge)
    first = done.where("request_id < 'r15'")
    rest = J.run(asked, J.StubJudge, first)
    assert first.unionByName(rest).orderBy("request_id", "repeat_index").collect() == done.orderBy("request_id", "repeat_index").collect()
    scored = J.parsed(done, 0, 10)
    assert scored.where("raw_parse_error IS NULL").count() + scored.where("raw_parsed_score IS NULL").count() == 40


def test_histogram_sums_to_pairs(spark):
    rng = random.Random(2)
    data = [(p, d, q, rng.choice(["A", "B", None]), rng.choice("AB"), n) for n, (p, d, q) in enumerate((p, d, q) for p in range(40) for d in "xy" for q in "uv")]
    c = spark.createDataFrame(data, "pair_id int, direction string, question string, choice string, correct string, ord int")
    done = P.complete_pairs(c)
    h = P.correct_histogram(done, 4).collect()
    assert sum(r.pairs for r in h) == done.count() and len(h) == 5


def test_pooling_and_heads(spark):
    frames = spark.createDataFrame([(1, 0, [1.0, 3.0], True), (1, 1, [3.0, 5.0], True), (1, 2, [9.0, 9.0], False)], "id int, t int, vector array<double>, mask boolean")
    assert vectors.masked_mean(frames).first().vector == [2.0, 4.0]
    assert vectors.attention_pool(frames, [0.0, 0.0]).first().vector == [2.0, 4.0]
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    layers = [([[0.1] * 8, [-0.2] * 8], [0.0, 0.1]), ([[1.0, -1.0]], [0.2])]
    one = df.select(vectors.comparator_score(F.col("a"), F.col("b"), layers).alias("x"), vectors.comparator_score(F.col("b"), F.col("a"), layers).alias("y"), F.size(vectors.comet_features(F.col("a"), F.col("b"), F.col("a"))).alias("n")).first()
    assert abs(one.x - one.y) < 1e-12 and one.n == 12


def test_prompts_match_a_nested_loop(spark):
    rng = random.Random(9)
    data = [(i, f"t{i % 2}", f"s{i % 3}", float(rng.randint(0, 50)), float(rng.randint(2, 20))) for i in range(40)]
    u = spark.createDataFrame(data, "id int, talk string, speaker string, start double, duration double")
    got = {r.id: r.prompt_id for r in B.nearest_prompts(u).collect()}
    for i, talk, sp, start, _ in data:
        c = [x for x in data if x[1:3] == (talk, sp) and x[0] != i]
        assert got[i] == min(c, key=lambda x: (x[4] < 8, abs(x[4] - 12), abs(x[3] - start), x[3], x[0]))[0]


def test_sources_and_sinks(spark, tmp_path):
    d = str(tmp_path)
    df = spark.createDataFrame([(2, None, "x"), (1, 0.5, "y")], "b int, a double, split string")
    writers.json_lines(df, f"{d}/j", files=1)
    lines = [r.value for r in spark.read.text(f"{d}/j").collect()]
    assert lines[0] == '{"a":null,"b":2,"split":"x"}'
    with pytest.raises(Exception, match="already exists"):
        writers.json_lines(df, f"{d}/j")
    keys = readers.json_lines_with_keys(spark, f"{d}/j", "a double, b int, c int").orderBy("b").collect()
    assert "c" not in keys[0].keys_ if hasattr(keys[0], "keys_") else True
    assert readers.json_lines(spark, f"{d}/j", "a double, b int, split string").count() == 2
    writers.delimited(df, f"{d}/t", ["split", "b"], "\t")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{d}/t").columns == ["split", "b"]
    writers.by_split(df, f"{d}/s")
    assert writers.read_split(spark, f"{d}/s").count() == 2 and writers.read_split(spark, f"{d}/s", "x").count() == 1
    writers.score_lines(df.where("a IS NOT NULL"), f"{d}/n", "a", "b")
    assert spark.read.text(f"{d}/n").first().value == "0.50000000"
    assert '"split": {"x": 1, "y": 1}' in writers.metadata(df, ["split"]) and "a: 0.500" in writers.report(df.where("b = 1"))

    (tmp_path / "stm").write_text("talk1 1 spk 0.5 9.75 <o,f0,male> it 's  a test\ntalk1 1 spk 10 10 <o> zero\ntalk1 1 inter_segment_gap 1 2 <o> ignore_time_segment_in_scoring\n\n")
    u = readers.utterance_lines(spark, f"{d}/stm").collect()
    assert len(u) == 1 and u[0].text == "it's a test" and u[0].utterance_id == "talk1__spk__0.500_9.750"
    (tmp_path / "bad").write_text("only three fields\n")
    with pytest.raises(Exception, match="malformed"):
        readers.utterance_lines(spark, f"{d}/bad").collect()

    (tmp_path / "m.csv").write_text("systemId,mean\ns1,3.5\n")
    assert readers.key_value(spark, f"{d}/m.csv", "systemId").first().mean == 3.5 and readers.key_value(spark, f"{d}/none.csv", "systemId").count() == 0
    (tmp_path / "l.tsv").write_text("utteranceId\tchoice\tclean\nu1\t4\t1\nu1\tx\t1\nu2\t3\t0\n")
    assert readers.listener_tsv(spark, f"{d}/l.tsv").count() == 2 and readers.listener_tsv(spark, f"{d}/l.tsv", True).count() == 1
    (tmp_path / "l.csv").write_text("sys,f1,4\nsys,f1,z\nsys\n")
    assert [tuple(r) for r in readers.listener_csv(spark, f"{d}/l.csv").collect()] == [("f1", 4)]
    (tmp_path / "mos.csv").write_text("f1,3.5\nf2,\n")
    assert readers.mos_list(spark, f"{d}/mos.csv", False, "train").count() == 2 and readers.mos_list(spark, f"{d}/mos.csv", False, "unlabeled").where("mos IS NOT NULL").count() == 0
    (tmp_path / "items" / "7").mkdir(parents=True)
    (tmp_path / "items" / "7" / "text.txt").write_text("full: a long text\ntarget: one | two\nseparators: again, once more\n")
    item = readers.probe_items(spark, f"{d}/items").first()
    assert (item.row_id, item.full_text, item.targets, item.separators) == (7, "a long text", ["one", "two"], ["again", "once more"])
    for sub in ("x", "y"):
        (tmp_path / "wav" / sub).mkdir(parents=True)
        (tmp_path / "wav" / sub / "c.wav").write_bytes(b"RIFF1234")
    index = readers.audio_index(spark, f"{d}/wav")
    assert index.count() == 1 and index.first().path.endswith("x/c.wav") and readers.content_hashes(spark, f"{d}/wav").select("sha256").distinct().count() == 1
    found = B.with_audio(spark.createDataFrame([("c.wav",), ("c.mp3",), ("d.wav",)], "wav_name string"), index).orderBy("wav_name").collect()
    assert [bool(r.audio_path) for r in found] == [True, True, False]
    kinds = spark.createDataFrame([("a.WAV", b"x"), ("b", b"fLaC"), ("c.x", b"ID3."), ("d", b"??")], "p string, c binary").select(readers.audio_extension(F.col("p"), F.col("c"))).collect()
    assert [r[0] for r in kinds] == [".wav", ".flac", ".mp3", ".bin"]


def test_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.json").write_text('{"request_id": "r1", "repeat_index": 0, "raw_response_text": "Score: 4"}\n')
    seen = []
    for extra in (None, "b"):
        if extra:
            (src / "b.json").write_text('{"request_id": "r2", "repeat_index": 0, "raw_response_text": "Score: 7"}\n')
        s = predictions.parsed_stream(spark, str(src), 0, 10)
        predictions.keep(s, out, str(tmp_path / "ck"), lambda t: seen.append(t.agg(F.sum("raw_parsed_score")).first()[0])).awaitTermination(60)
    assert seen == [4.0, 11.0]


def test_emotion_manifest(spark):
    raw = spark.createDataFrame([(0, "[{'a': {'Jealousy & Envy': 2}}, {'b': {'Jealousy & Envy': 1}}, {'a': {'Jealousy & Envy': 0}}]"), (1, "[{'x': {'Awe': 2}}]")], "row_id int, label string")
    out = M.emotion_manifest(raw, vocabulary.ALIASES, vocabulary.OFFICIAL).orderBy("row_id").collect()
    assert out[0].target_label == "Jealousy / Envy" and out[0].is_official_40 and out[0].annotator_scores_raw_0_2 == {"a": 0, "b": 1}
    assert (out[0].mean_score_0_10, out[0].median_score_0_10) == (2.5, 2.5) and abs(out[0].std_score_0_10 - 12.5**0.5) < 1e-12 and out[1].std_score_0_10 == 0
    for bad, what in (("[{'a': {'Awe': 3}}]", "out of range"), ("[{'a': {'Awe': 1}}, {'b': {'Hope': 1}}]", "several labels"), ("[]", "no votes")):
        with pytest.raises(Exception, match=what):
            M.emotion_manifest(spark.createDataFrame([(0, bad)], "row_id int, label string"), {}, []).collect()


def test_pair_scorer(spark):
    class Lengths:
        def encode(self, sources):
            return [[len(s), 1.0] for s in sources]

    pairs = spark.createDataFrame([(1, "aa", "bbb"), (2, "bbb", "aa")], "pair_id int, src_audio string, tgt_audio string")
    layers = [([[1.0, 0.0, 0.0, 0.0, 0.5, 0.0, 0.1, 0.0]], [1.0])]
    got = [r.score for r in PairScorer(Lengths, layers, batch=1).score(pairs).orderBy("pair_id").collect()]
    assert got[0] == got[1] and abs(got[0] - (2.5 + 3.0 + 0.1 + 1)) < 1e-9


@pytest.mark.parametrize("size", [None, "1k"])
def test_dense_ids(spark, size):
    """No row is lost, whatever adaptive execution does to the ranges, and the payload stays with its row."""
    n, old = 200_000, spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    if size:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    try:
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"), F.col("id").alias("own"), F.lit(1).alias("unused"))
        out = rows.dense_ids(df, ["k"], "n")
        assert out.agg(F.count(F.lit(1)), F.count_if(F.expr("k = n")), F.max("n"), F.count_if(F.sha2(F.col("own").cast("string"), 256) == F.col("payload"))).first() == (n, n, n - 1, n)
        assert out.select("n").agg(F.count_distinct("n")).first()[0] == n
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    ties = rows.dense_ids(spark.range(5000).select(F.lit(1).alias("k"), "id"), ["k"], "n")
    assert ties.agg(F.count_distinct("n"), F.max("n")).first() == (5000, 4999)
    assert rows.dense_ids(spark.range(0), ["id"], "n").count() == 0
