"""The engine's input shapes, derived from the driver's star-schema tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import expressions as X
from assayframe.operators.tables import shared_dir


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def votes(t: Tables) -> DataFrame:
    """row_id, annotator, score 0-2."""
    best = t.lineitem.groupBy(F.col("l_orderkey").alias("row_id"), "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return best.select("row_id", F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("annotator"), (F.floor("q") % 3).cast("int").alias("score"))


def emotion_predictions(t: Tables) -> DataFrame:
    """row_id, target_label, score 0-10, raw_parse_error."""
    return t.orders.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("target_label"), (F.col("o_custkey") % 11).cast("double").alias("score"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit("no number")).alias("raw_parse_error"),
    )


def mos_rows(t: Tables) -> DataFrame:
    """system_id, part, mos 1-5, raw 1-10, audio_path (null where the tax is zero)."""
    l = t.lineitem
    return l.select(
        F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("system_id"), (1 + 40 * F.col("l_discount")).alias("mos"),
        (1 + (F.col("l_quantity") - 1) * 9 / 49).alias("raw"), F.when(F.col("l_tax") != 0, F.concat(F.lit("wav/"), F.col("l_orderkey").cast("string"), F.lit(".wav"))).alias("audio_path"),
    )


def pair_rows(t: Tables) -> DataFrame:
    """pair_id, label, score, ord: the best quantity of an order's open and closed lines."""
    label = F.when(F.col("l_linestatus") == "F", "real").otherwise("synthetic")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("pair_id"), label.alias("label")).agg(F.max("l_quantity").alias("score"), F.max("l_linenumber").alias("ord"))


def cells(t: Tables) -> DataFrame:
    """pair_id, direction, question, choice, correct, ord of A/B answers."""
    e = t.events
    direction = F.when(e.event_id % 2 == 0, "real_a").otherwise("synthetic_a")
    question = F.when(F.floor(e.event_id / 2) % 2 == 0, "synthetic").otherwise("real")
    choice = F.when(e.event_type.isin("view", "signup"), "A").when(e.event_type.isin("click", "purchase"), "B")
    correct = F.when((direction == "real_a") == (question == "real"), "A").otherwise("B")
    return e.select(F.floor(e.event_id / 4).alias("pair_id"), direction.alias("direction"), question.alias("question"), choice.alias("choice"), correct.alias("correct"), F.col("event_id").alias("ord"))


def answers(t: Tables) -> DataFrame:
    """event_id, raw: model answers of several shapes."""
    e = t.events
    v = F.floor("value")
    n = lambda k: (v % k).cast("string")
    raw = (
        F.when(e.event_type == "view", F.concat(F.lit("Score: "), n(23), F.lit("/10")))
        .when(e.event_type == "click", F.concat(F.lit("```json\n{\"score\": "), n(13), F.lit(", \"extra\": "), F.col("props"), F.lit("}\n```")))
        .when(e.event_type == "purchase", F.concat(F.lit("The clip {a} is fine. Final score: "), n(17), F.lit(", final score: "), n(29)))
        .when(e.event_type == "signup", F.concat(F.lit("B is the synthetic one, -"), n(7), F.lit(" or so")))
        .otherwise(F.concat(F.lit("{\"choice\": \"a\", \"scores\": {\"joy\": "), n(14), F.lit(", \"fear\": true}} trailing")))
    )
    return e.select("event_id", "event_type", raw.alias("raw"))


def place(t: Tables) -> str:
    """A new place in the folder that all executors share."""
    return f"{shared_dir(t.spark)}/{uuid.uuid4().hex}"


def write_folders(files: DataFrame, root: str) -> None:
    """``files(name, text)``: each text as <root>/<name>/text.txt, from the tasks that hold them."""
    base = root.removeprefix("file://")

    def put(parts):
        for p in parts:
            for name, text in zip(p["name"], p["text"], strict=True):
                os.makedirs(os.path.join(base, name), exist_ok=True)
                with open(os.path.join(base, name, "text.txt"), "w", encoding="utf-8") as f:
                    f.write(text)
            yield p[["name"]]

    files.mapInPandas(put, "name string").write.format("noop").mode("overwrite").save()


def scored_predictions(t: Tables) -> DataFrame:
    """row_id, keys, raw_score_scale and score fields, of which each row has some."""
    k = F.col("o_orderkey") % 6
    names = ["raw_parsed_score_0_10", "raw_parsed_emotion_score_0_2", "raw_parsed_score_1_5", "raw_parsed_score_1_10", "raw_parsed_score"]
    keys = F.array(*[F.lit(x) for x in names])
    has = F.when(k == 5, F.array().cast("array<string>")).otherwise(F.slice(keys, (k + 1).cast("int"), F.lit(2)))
    value = (F.col("o_custkey") % 11).cast("double")
    scale = F.when(F.col("o_orderkey") % 4 == 0, F.struct(F.lit(1).alias("min"), F.lit(10).alias("max")))
    rows = t.orders.select(F.col("o_orderkey").alias("row_id"), has.alias("keys"), scale.alias("raw_score_scale"), value.alias("v"))
    fields = {n: F.when(F.array_contains("keys", n), F.when(F.col("row_id") % 7 != 0, F.col("v") + i)) for i, n in enumerate(names)}
    return rows.withColumns(fields).withColumn("raw_parsed_score_0_2", F.lit(None).cast("double"))


def typed_answers(t: Tables) -> DataFrame:
    """request_id, mode, raw_score_scale, expected, correct_choice, raw_response_text: every mode in turn."""
    modes = ["one_by_one", "one_by_one_paper_0_10_thinking", "one_by_one_contrastive_rubric", "quality_features_1_10", "pairwise_real_vs_synthetic", "all_at_once"]
    k, v = F.col("event_id") % 6, (F.floor("value") % 14).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("I say "), v, F.lit(" of 3")))
        .when(k == 1, F.concat(F.lit("first 3, final score: "), v))
        .when(k == 2, F.concat(F.lit('{"emotion_score": '), v, F.lit(', "opposite_score": 2}')))
        .when(k == 3, F.concat(F.lit('{"scores": {"joy": '), v, F.lit(', "fear": 2}, "observations": {"joy": "a", "fear": "b"}, "overall_score": 5, "overall_reason": "c"}')))
        .when(k == 4, F.when(F.col("event_type") == "click", F.lit("none of them")).otherwise(F.lit("A is it")))
        .otherwise(F.concat(F.lit('{"joy": '), v, F.lit(', "fear": 1, "awe": 2}')))
    )
    mode = F.element_at(F.array(*[F.lit(m) for m in modes]), (k + 1).cast("int"))
    return t.events.select(
        F.col("event_id").alias("request_id"), F.when((k == 0) & (F.col("event_id") % 4 == 0), F.lit(None)).otherwise(mode).alias("mode"), F.struct(F.lit(0).alias("min"), F.lit(10).alias("max")).alias("raw_score_scale"),
        F.array(F.lit("joy"), F.lit("fear")).alias("expected"), F.when(F.col("event_id") % 4 == 0, "A").otherwise("B").alias("correct_choice"), text.alias("raw_response_text"),
    )


def spoken(t: Tables) -> DataFrame:
    """conv_id, turn, reference, hypothesis: a user turn and the reply, normalised, whole."""
    c = t.conversations
    u = c.where("role = 'user'").select("conv_id", "turn", X.word_text(F.col("text")).alias("reference"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).cast("int").alias("turn"), X.word_text(F.col("text")).alias("hypothesis"))
    return u.join(a, ["conv_id", "turn"])


def vector_pairs(t: Tables) -> DataFrame:
    """k, a, b: vectors 2k and 2k+1."""
    e = t.embeddings
    a = e.where("vec_id % 2 = 0").select(F.floor(F.col("vec_id") / 2).alias("k"), F.col("embedding").alias("a"))
    b = e.where("vec_id % 2 = 1").select(F.floor(F.col("vec_id") / 2).alias("k"), F.col("embedding").alias("b"))
    return a.join(b, "k")


def utterances(t: Tables) -> DataFrame:
    """id, talk, speaker, start (epoch seconds), duration."""
    return t.events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("talk"), F.col("user_id").alias("speaker"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"), F.col("value").alias("duration"),
    )
