"""Manifests: one row per sample with its human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions import expressions as X
from assayframe.operators import benchmarks
from assayframe.operators.rows import dense_ids


def canonical_label(label: Column, aliases: dict[str, str]) -> Column:
    """Trimmed, single spaces, other spellings replaced."""
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return X.bound(F.regexp_replace(X.stripped(label), r"\s+", " "), lambda v: F.coalesce(F.try_element_at(known, v), v))


def system_by_marker(name: Column, marker: str = "-utt") -> Column:
    """What stands before the marker; the whole name without one."""
    return F.substring_index(name, marker, 1)


def system_by_underscore(stem: Column) -> Column:
    return F.substring_index(stem, "_", -1)


def sentence_by_underscore(stem: Column) -> Column:
    """What stands before the last underscore; the whole stem without one."""
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"^(.*)_", 1), F.lit("")), stem)


def emotion_manifest(raw: DataFrame, aliases: dict[str, str], official: list[str]) -> DataFrame:
    """Samples from ``raw(row_id, label)`` where label is a list of {annotator: {label: score}}.

    All votes of a row name one label and lie in 0-2, else the query fails; of
    an annotator's repeated votes the last counts.
    """
    said = X.votes_of(F.col("label"))
    flat = F.flatten(F.transform(said, lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("annotator"), F.map_entries(e["value"]).alias("given")))))
    rows = raw.withColumn("_votes", F.when(F.size(flat) > 0, flat).otherwise(F.raise_error(F.concat(F.lit("no votes in "), F.col("label"))).cast("array<struct<annotator:string,given:array<struct<key:string,value:int>>>>")))
    labels = F.array_distinct(F.flatten(F.transform("_votes", lambda v: F.transform(v["given"], lambda g: canonical_label(g["key"], aliases)))))
    rows = rows.withColumn("_labels", labels)
    one = F.when(F.size("_labels") == 1, F.get("_labels", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("votes of several labels: "), F.array_join("_labels", ", "))))
    rows = rows.withColumn("target_label", one)
    pairs = F.transform("_votes", lambda v: F.struct(v["annotator"].alias("a"), F.get(v["given"], F.lit(0))["value"].alias("s")))
    rows = rows.withColumn("_pairs", pairs).withColumn("_names", F.array_distinct(F.transform("_pairs", lambda p: p["a"])))
    last = F.transform("_names", lambda n: F.element_at(F.filter("_pairs", lambda p: p["a"] == n), -1)["s"])
    checked = F.transform(last, lambda s: F.when(s.between(0, 2), s).otherwise(F.raise_error(F.concat(F.lit("score out of range: "), s.cast("string"))).cast("int")))
    rows = rows.withColumn("annotator_scores_raw_0_2", F.map_from_arrays("_names", checked))
    ten = F.transform(F.map_values("annotator_scores_raw_0_2"), lambda s: s * 5.0)
    n, total = F.size("_names"), F.aggregate(ten, F.lit(0.0), lambda s, x: s + x)
    ordered = F.array_sort(ten)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    rows = rows.withColumn("n_annotators", n).withColumn("mean_score_0_10", total / n).withColumn("median_score_0_10", (low + high) / 2)
    apart = F.aggregate(ten, F.lit(0.0), lambda s, x: s + F.pow(x - F.col("mean_score_0_10"), 2))
    rows = rows.withColumn("std_score_0_10", F.when(n < 2, 0.0).otherwise(F.sqrt(apart / F.nullif(n - 1, F.lit(0)))))
    return rows.select(
        *[c for c in raw.columns if c != "label"], "target_label", F.col("target_label").isin(official).alias("is_official_40"), "annotator_scores_raw_0_2",
        F.transform_values("annotator_scores_raw_0_2", lambda k, v: v * 5).alias("annotator_scores_0_10"), "n_annotators", (F.col("mean_score_0_10") / 5).alias("mean_score_raw_0_2"),
        "mean_score_0_10", "median_score_0_10", "std_score_0_10",
    )


def mos_manifest(samples: DataFrame, means: DataFrame, listeners: DataFrame, audio: DataFrame | None = None, order: tuple[str, ...] = ("split", "name")) -> DataFrame:
    """Samples ``(split, name, system_id, mos)`` with system means, listener scores, files and row ids."""
    out = benchmarks.lookup(samples, means, "system_id")
    out = benchmarks.with_listeners(out, listeners, "name")
    if audio is not None:
        out = benchmarks.with_audio(out, audio, "name")
    return dense_ids(out, list(order))
