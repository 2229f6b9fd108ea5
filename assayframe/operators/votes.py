"""Votes: long form, per-row summaries, majority, sampling."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.operators import ordered


def long_votes(manifest: DataFrame, votes: str = "annotator_scores_raw_0_2") -> DataFrame:
    """row_id, annotator, score of a map column."""
    return manifest.select("row_id", F.explode(votes).alias("annotator", "score"))


def summary(votes: DataFrame) -> DataFrame:
    """Per row: n, mean of 0-2 votes, and mean, median and sample deviation on 0-10."""
    ten = F.col("score") * 5
    return votes.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n_annotators"),
        F.avg("score").alias("mean_score_raw_0_2"),
        F.avg(ten).alias("mean_score_0_10"),
        F.median(ten).alias("median_score_0_10"),
        F.coalesce(F.stddev_samp(ten), F.lit(0.0)).alias("std_score_0_10"),
    )


def majority(votes: DataFrame) -> DataFrame:
    """Per row the most frequent score; ties go to the one nearest the mean, then the smaller.

    A row's votes are gathered once, as many as it has annotators.
    """
    rows = votes.groupBy("row_id").agg(F.collect_list("score").alias("_all"), F.avg("score").alias("mean"))
    held = lambda k: F.size(F.filter("_all", lambda x: x == k))
    ranked = F.transform(F.array_distinct("_all"), lambda k: F.struct((-held(k)).alias("n"), F.abs(k - F.col("mean")).alias("far"), k.alias("score")))
    return rows.select("row_id", F.array_min(ranked)["score"].alias("majority"), "mean")


def rounded(mean: Column) -> Column:
    """The whole number nearest to a mean, halves to even."""
    return F.bround(mean, 0).cast("int")


def agreement(votes: DataFrame) -> DataFrame:
    """Exact row agreement, pairwise agreement and mean pairwise difference, one row."""
    from assayframe.functions.stats import annotator_pairs

    rows = votes.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("score").alias("kinds")).where("n >= 2")
    exact = rows.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("kinds") == 1).cast("double")).alias("exact_rows"))
    pairs = annotator_pairs(votes).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg((F.col("l") == F.col("r")).cast("double")).alias("pair_agreement"), F.avg(F.abs(F.col("l") - F.col("r")).cast("double")).alias("mean_difference")
    )
    return exact.crossJoin(pairs)


def weighted_by_row(held: DataFrame, model: str, human: str) -> DataFrame:
    """Errors averaged in each row first, then over rows: rows, mae, mse, rmse."""
    d = F.col(model) - F.col(human)
    per = held.groupBy("row_id").agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"))
    return per.agg(F.count(F.lit(1)).alias("rows"), F.avg("mae").alias("mae"), F.avg("mse").alias("mse")).withColumn("rmse", F.sqrt("mse"))


def stratified(rows: DataFrame, label: str, key: str, k: int, seed: int = 13) -> DataFrame:
    """k rows of each label, in the order of md5('seed:label:key')."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(label), F.col(key)))
    picked = Window.partitionBy(label).orderBy(order, key)
    # Spark keeps k rows a label on each side of the shuffle (group limit), not the whole label
    return rows.withColumn("_k", F.row_number().over(picked)).where(F.col("_k") <= k).drop("_k")


BLOCK = 1 << 16  # steps of a shuffle that are held at once


def _targets(rng: random.Random, high: int, low: int):
    """The places that a shuffle of Python's swaps with high, high - 1, ..., low."""
    bits = rng.getrandbits
    for i in range(high, low - 1, -1):
        k = (i + 1).bit_length()
        j = bits(k)
        while j > i:
            j = bits(k)
        yield j


def picked_places(seed: str, n: int, k: int, block: int = BLOCK) -> list[int]:
    """Which places of a list of n ``random.Random(seed).shuffle`` brings to its first k places, in their order.

    A shuffle swaps the places n - 1, n - 2, ..., 1 with drawn ones.  The
    generator runs through them once, keeping its state at every ``block``
    steps; then the blocks are drawn again from the last to the first and the k
    places followed back through their swaps.  So a block of steps and n /
    block states are held, and no list of n.
    """
    rng = random.Random(seed)
    states = []
    for high in range(n - 1, 0, -block):
        low = max(1, high - block + 1)
        states.append((rng.getstate(), high, low))
        for _ in _targets(rng, high, low):
            pass
    at = {place: place for place in range(min(k, n))}  # where it is now: which of the first k it ends in
    while states:
        state, high, low = states.pop()
        rng.setstate(state)
        for i, j in zip(range(low, high + 1), reversed(list(_targets(rng, high, low))), strict=True):
            if i != j and (i in at or j in at):
                x, y = at.pop(i, None), at.pop(j, None)
                if x is not None:
                    at[j] = x
                if y is not None:
                    at[i] = y
    return [place for place, _ in sorted(at.items(), key=lambda x: x[1])]


def stratified_exact(rows: DataFrame, label: str, key: str, k: int, seed: int = 13) -> DataFrame:
    """k rows of each label as Python's ``random.Random(f'{seed}:{label}').shuffle`` picks them, rows being in the order of ``key``.

    A label's picks are places that follow from its seed and number of rows
    (``picked_places``); its rows are numbered over ranges and meet them in a
    join by number.  No worker gets a label's rows.  Rows of equal label and key
    may stand in any order; rows without a label are one.  A label with fewer
    than k rows is an error.
    """
    kind = dict(rows.dtypes)[label]
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))

    def pick(batches):
        for b in batches:
            found = []
            for name, n in zip(b.column("label").to_pylist(), b.column("n").to_pylist(), strict=True):
                if n < k:
                    raise ValueError(f"label {name!r} has {n} rows, {k} needed")
                found += [{"label": name, "place": p} for p in picked_places(f"{seed}:{name}", n, k)]
            yield pa.RecordBatch.from_pylist(found, pa.schema([b.schema.field("label"), ("place", pa.int64())]))

    places = counts.mapInArrow(pick, f"label {kind}, place long").withColumnRenamed("label", "_label")
    numbered = ordered.running(rows, [label], [key], name="_place")
    return numbered.join(places, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_place") == F.col("place"))).drop("_label", "_place", "place")
