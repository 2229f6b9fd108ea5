import json

import pytest
from pyspark.sql import functions as F

from assayframe.functions import expressions as X


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def one(spark, texts, column):
    return [r[0] for r in values(spark, texts, column)]


def test_first_number(spark):
    texts = ["Score: 7/10", "11 then 5", "-3.5", "none", "", None, "0.0", "x10y"]
    assert one(spark, texts, X.first_number(F.col("t"), 0, 10)) == [7, None, None, None, None, None, 0, 10]


def test_json_span(spark):
    texts = ['a {"x": {"y": 1}} b', '```json\n{"s": "}"}\n```', '{"a": "\\"}"} {"b": 2}', "{ open", "no", "[{\"a\": 1}]", None]
    assert one(spark, texts, X.json_span(F.col("t"))) == ['{"x": {"y": 1}}', '{"s": "}"}', '{"a": "\\"}"}', None, None, '{"a": 1}', None]


def test_final_score(spark):
    texts = ['{"score": 4}', '{"score": "4"} 9', '{"score": true, "final_score": 2.5}', "Final score: 3, final score = 8, final score: 40", "score: 6", "I give 5", "99"]
    assert one(spark, texts, X.final_score(F.col("t"), 0, 10)) == [4, 4, 2.5, 8, 6, 5, None]


def test_choice(spark):
    texts = ["A", " b ", "A.", "The answer is B", "a cat", "neither", '{"choice": "B"}', '{"answer": "x", "synthetic": "A"}', "AB", "B)"]
    assert one(spark, texts, X.choice(F.col("t"))) == ["A", "B", "A", "B", "A", None, "B", "A", None, "B"]


def test_label_scores(spark):
    texts = ['{"scores": {"joy": 3, "fear": 4.5}}', '{"joy": 3, "fear": true, "z": 1}', '{"scores": 5}', "nothing"]
    got = one(spark, texts, X.label_scores(F.col("t"), ["joy", "fear"], 0, 10))
    assert got[0].scores == {"joy": 3.0, "fear": 4.5} and got[0].error is None and got[0].missing == []
    assert got[1].scores == {"joy": 3.0} and got[1].missing == ["fear"] and got[1].extra == ["z"] and got[1].invalid == {"fear": "true"} and got[1].error
    assert got[2].error == "JSON scores field was not an object" and got[3].error == "response did not contain a JSON object"


def test_contrastive_and_features(spark):
    got = one(spark, ['{"emotion_score": 1, "opposite_score": 2}', '{"emotion_score": 1}', "x"], X.contrastive_scores(F.col("t"), 0, 2))
    assert (got[0].emotion_score, got[0].opposite_score, got[0].error) == (1, 2, None) and got[1].error and got[2].error.startswith("response")
    full = {"observations": {"p": "ok"}, "scores": {"p": 3}, "overall_score": 4, "overall_reason": "fine"}
    got = one(spark, [json.dumps(full), json.dumps(full | {"overall_reason": " ", "more": 1}), json.dumps(full | {"scores": {"q": 1}}), "x"], X.feature_scores(F.col("t"), ["p"], 1, 10))
    assert got[0].error is None and got[0].warning is None and got[0].scores == {"p": 3} and got[0].missing == []
    assert got[1].error is None and got[1].warning and got[1].missing == ["overall_reason"] and got[1].extra == ["more"]
    assert got[2].error and got[2].missing == ["p"] and got[2].extra == ["scores.q"]
    assert got[3].missing == ["p", "overall_score"] and got[3].error


def test_probe(spark):
    texts = ['{"target_present": "yes", "transcript": "hi"}', "target_present: FALSE", '{"target_present": 1}', "?"]
    got = one(spark, texts, X.probe(F.col("t"), F.lit("without_repeat")))
    assert [g.target_present for g in got] == [True, False, None, None] and got[0].transcript == "hi"
    assert [g.error for g in got] == [None, None, "missing boolean target_present", "response did not contain a JSON object"]
    got = one(spark, ['{"target_before_repeat": false, "target_after_repeat": true}', "target_before_repeat = no"], X.probe(F.col("t"), F.lit("with_repeat")))
    assert (got[0].target_before_repeat, got[0].target_after_repeat, got[0].error) == (False, True, None) and got[1].error


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_distance(spark):
    import random

    rng = random.Random(1)
    pairs = [(" ".join(rng.choices("abcdef", k=rng.randint(0, 9))), " ".join(rng.choices("abcdef", k=rng.randint(0, 9)))) for _ in range(60)]
    pairs.append((" ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(5, 3000))))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", X.word_distance(X.words(F.col("a")), X.words(F.col("b")))).orderBy("i").collect()
    assert [r[1] for r in got] == [edits(a.split(), b.split()) for a, b in pairs]


def test_filled_and_ids(spark):
    out = one(spark, ["{x} & y"], X.filled("a {{k}} {v} {{{v}}}", v=F.col("t")))
    assert out == ["a {k} {x} & y {{x} & y}"]
    assert one(spark, ["Jealousy / Envy", "A & B"], X.slug(F.col("t"))) == ["jealousy---envy", "a-and-b"]
    assert one(spark, ["__a b/c.."], X.safe_id(F.col("t"))) == ["a_b_c"]
    assert values(spark, ["1"], X.human_bytes(F.lit(512)), X.human_bytes(F.lit(1536)))[0] == ("512 B", "1.5 KiB")


def test_split_once(spark):
    got = one(spark, ["one STOP two stop three", "none"], X.split_once(F.col("t"), F.array(F.lit("zzz"), F.lit(" stop "))))
    assert (got[0].before, got[0].after) == ("one", "two stop three") and (got[1].before, got[1].after) == ("none", None)


def test_votes_of(spark):
    got = one(spark, ["[{'ann1': {'Joy': 2}}, {'ann2': {'Joy': 0}}]"], X.votes_of(F.col("t")))
    assert got == [[{"ann1": {"Joy": 2}}, {"ann2": {"Joy": 0}}]]


@pytest.mark.parametrize("ref,hyp,rate", [("a b", "a b", 0.0), ("a b", "", 1.0), ("", "", 0.0)])
def test_error_rate(spark, ref, hyp, rate):
    df = spark.createDataFrame([(ref, hyp)], "r string, h string").select(X.words(F.col("r")).alias("r"), X.words(F.col("h")).alias("h"))
    assert df.select(X.error_rate(X.word_distance(F.col("r"), F.col("h")), F.col("r"), F.col("h"))).first()[0] == rate


def test_edit_distance_by_brute_force_and_of_long_texts():
    import random
    import time

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(1500):
        a, b = rng.choices("abc", k=rng.randrange(9)), rng.choices("abcd", k=rng.randrange(9))
        assert X.edit_distance(a, b) == table(a, b)
    for n in (63, 64, 65, 200):
        a, b = rng.choices("abcdefgh", k=n), rng.choices("abcdefgh", k=n + 7)
        assert X.edit_distance(a, b) == table(a, b)
    long = [str(rng.randrange(3000)) for _ in range(20_000)]
    other = list(long)
    for i in range(30):
        other[500 * i] = f"new {i}"
    del other[77]
    other.insert(9000, "more")
    began = time.process_time()
    assert X.edit_distance(long, other) == 32 and time.process_time() - began < 1


def test_word_distances_of_arrow_arrays():
    """Slices, nulls and empty lists; a worker never holds more than a pair's words as Python objects."""
    import pyarrow as pa

    a = pa.array([["x"], ["a", "b", "c"], None, [], ["a", None], ["q", "r"]]).slice(1)
    b = pa.array([["y"], ["b", "c", "d", "e"], ["a"], ["z"], ["a", None], None]).slice(1)
    assert X.word_distances(a, b).to_pylist() == [3, None, 1, 0, None]


def test_texts_come_to_workers_in_small_batches(spark):
    from assayframe.operators import benchmarks as B

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        B.word_errors(spark.createDataFrame([("a b", "a c")], "reference string, hypothesis string"))
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, was)
