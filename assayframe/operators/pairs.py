"""Pairs: twins, deltas, A/B answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.expressions import rate


def twins(rows: DataFrame, value: str, order: str = "ord") -> DataFrame:
    """pair_id with the value of its real and of its synthetic row (the last of each); complete pairs only."""
    pick = lambda label: F.max_by(F.when(F.col("label") == label, F.col(value)), F.when(F.col("label") == label, F.col(order)))
    return rows.groupBy("pair_id").agg(pick("real").alias("real"), pick("synthetic").alias("synthetic")).where("real IS NOT NULL AND synthetic IS NOT NULL")


def require_complete(rows: DataFrame) -> DataFrame:
    """``rows`` unless a pair lacks its real or synthetic row: then the query fails."""
    per = rows.groupBy("pair_id").agg(F.count_distinct("label").alias("k"))
    checked = per.withColumn("k", F.when(F.col("k") < 2, F.raise_error(F.concat(F.lit("pair_id has no complete real/synthetic pair: "), F.col("pair_id").cast("string"))).cast("long")).otherwise(F.col("k")))
    return rows.join(checked.where("k >= 2").select("pair_id"), "pair_id", "left_semi")


def deltas(rows: DataFrame, value: str = "score", order: str = "ord") -> DataFrame:
    return twins(rows, value, order).withColumn("delta", F.col("synthetic") - F.col("real"))


def delta_summary(pairs: DataFrame) -> DataFrame:
    """One row: n, mean, min, max and how many deltas are below, at and above zero."""
    d = F.col("delta")
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.min(d).alias("low"), F.max(d).alias("high"),
        F.count_if(d < 0).alias("negative"), F.count_if(d == 0).alias("zero"), F.count_if(d > 0).alias("positive"),
    )


def repeat_average(rows: DataFrame, key: str = "request_id", order: str = "ord") -> DataFrame:
    """Per request the mean of its scores and the label of its first row."""
    return rows.groupBy(key).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("repeats"), F.min_by("label", order).alias("label"))


def inferred(choice: Column, target: Column) -> Column:
    """The choice as an answer to 'which is synthetic': inverted where real was asked for."""
    return F.when(choice.isNull(), None).when(target == "real", F.when(choice == "A", "B").otherwise("A")).otherwise(choice)


def correct_choice(label_a: Column, target: Column) -> Column:
    return F.when(label_a == target, "A").otherwise("B")


def _rates() -> list[Column]:
    parsed = F.count("choice")
    shown = inferred(F.col("choice"), F.col("question"))
    return [
        F.count(F.lit(1)).alias("considered"), parsed.alias("parsed"), (F.count(F.lit(1)) - parsed).alias("parse_failures"),
        rate(F.count_if(F.col("choice") == F.col("correct")), parsed).alias("accuracy"), rate(F.count_if(F.col("choice") == "A"), parsed).alias("rate_a"), rate(F.count_if(F.col("choice") == "B"), parsed).alias("rate_b"),
        rate(F.count_if(shown == "A"), parsed).alias("synthetic_a"), rate(F.count_if(shown == "B"), parsed).alias("synthetic_b"),
    ]


def choice_rates(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """considered, parsed, failures, accuracy, rates of A and B and of both as the synthetic one, in groups or overall."""
    return rows.groupBy(*(by or [])).agg(*_rates())


def choice_rates_grouped(rows: DataFrame) -> DataFrame:
    """The rates by direction, by question and overall, in one pass over grouping sets."""
    r = rows.select(F.col("direction").alias("_d"), F.col("question").alias("_q"), "direction", "question", "choice", "correct")
    out = r.groupingSets([[F.col("_d")], [F.col("_q")], []], F.col("_d"), F.col("_q")).agg(*_rates())
    return out.withColumn("direction", F.coalesce("_d", F.lit("all"))).withColumn("question", F.coalesce("_q", F.lit("all"))).drop("_d", "_q")


def complete_pairs(rows: DataFrame, expected: list[tuple[str, str]] | None = None) -> DataFrame:
    """pair_id, cells, correct: pairs whose parsed cells (direction, question) are all those expected.

    Without ``expected`` the cells that any row has are; of repeated rows the last counts.
    """
    last = rows.where("choice IS NOT NULL").groupBy("pair_id", "direction", "question").agg(F.max_by((F.col("choice") == F.col("correct")).cast("int"), "ord").alias("ok"))
    if expected is not None:
        cell = F.struct("direction", "question")
        known = F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(q).alias("question")) for d, q in expected])
        per = last.groupBy("pair_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("ok").alias("correct"), F.count_if(F.array_contains(known, cell)).alias("_known"))
        return per.where((F.col("cells") == len(set(expected))) & (F.col("_known") == F.col("cells"))).drop("_known")
    cells = rows.select("direction", "question").distinct().agg(F.count(F.lit(1)).alias("all_cells"))
    per = last.groupBy("pair_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("ok").alias("correct"))
    return per.crossJoin(F.broadcast(cells)).where("cells = all_cells").select("pair_id", "cells", "correct")


def pair_score(complete: DataFrame) -> DataFrame:
    """complete_pairs and the mean share of correct cells; NaN without any."""
    return complete.agg(F.count(F.lit(1)).alias("complete_pairs"), F.coalesce(F.avg(F.col("correct") / F.col("cells")), F.lit(float("nan"))).alias("pair_score"))


def scored_pairs(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(pair_id, split, src_audio, tgt_audio) of the real rows; one of their files that ``files(path)`` lacks fails the query.

    There are as many files as rows, so their table is never broadcast.
    """
    real = rows.where("label = 'real'").select("pair_id", "split", F.col("audio_path").alias("src_audio"), F.col("other_audio_path").alias("tgt_audio"))
    there = files.select(F.col("path").alias("_path")).distinct()
    for c in ("src_audio", "tgt_audio"):
        real = real.join(there.withColumn("_there", F.lit(True)).hint("merge"), F.col(c) == F.col("_path"), "left").drop("_path")
        missing = F.raise_error(F.concat(F.lit("audio not found: "), F.coalesce(F.col(c), F.lit("null")))).cast("boolean")
        real = real.where(F.when(F.col("_there").isNull(), missing).otherwise(True)).drop("_there")
    return real


def correct_histogram(complete: DataFrame, cells: int) -> DataFrame:
    """correct, pairs for 0 .. cells, zeros included."""
    grid = complete.sparkSession.range(cells + 1).select(F.col("id").alias("correct"))
    return grid.join(complete.groupBy("correct").agg(F.count(F.lit(1)).alias("pairs")), "correct", "left").fillna(0, ["pairs"])


def unpivot(wide: DataFrame) -> DataFrame:
    """Two rows, real and synthetic, of each wide pair (pair_id, real_path, synthetic_path)."""
    side = lambda label, own, other: F.struct(F.lit(label).alias("label"), F.col(own).alias("audio_path"), F.col(other).alias("other_audio_path"))
    both = F.array(side("real", "real_path", "synthetic_path"), side("synthetic", "synthetic_path", "real_path"))
    rows = wide.select("pair_id", F.explode(both).alias("r")).select("pair_id", "r.*")
    return rows.withColumn("sample_id", F.concat_ws("__", F.col("pair_id").cast("string"), "label"))


def merge_over(predictions: DataFrame, requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Predictions with their requests' columns, a prediction's own column winning where it has one."""
    only = [c for c in requests.columns if c not in predictions.columns]
    return predictions.join(requests.select(key, *only), key, "left")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that share a key the last one."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r")).select(key, "_r.*")
