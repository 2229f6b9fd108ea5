"""Places in an order, over ranges: nothing here holds a whole table, or a whole group, in one task.

Rows are range-partitioned and sorted by group and order, so a large group lies
in many ranges.  A pass over each range counts within it; what a group has in
the ranges before is added afterwards from a small table, which needs a row
only for a range that a group runs into (one a range, so it may be broadcast).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.operators.tables import saved


def fresh_rows(batch: pa.RecordBatch, by: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Which rows begin a group, being unlike the row before; ``last`` is that of the batch before.  Nulls are alike, as are NaNs."""
    out = np.zeros(batch.num_rows, bool)
    out[:1] = last is None
    for name in by:
        values = batch.column(name)
        if last is not None:
            values = pa.concat_arrays([last.column(name), values])
        a, b = values.slice(1), values.slice(0, len(values) - 1)
        unlike = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(values.type):
            unlike = pc.and_(unlike, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
        unlike = pc.or_(unlike, pc.not_equal(pc.is_null(a), pc.is_null(b)))
        out[len(out) - len(unlike) :] |= unlike.to_numpy(zero_copy_only=False)
    return out


def _counted(by: list[str], weight: str):
    def run(batches):
        part, last, held = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            before = held + np.cumsum(n) - n
            fresh = fresh_rows(b, by, last)
            starts = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1
            within = before - np.where(group >= 0, before[starts][group] if len(starts) else 0, 0)
            held, last = int(within[-1] + n[-1]), b.slice(b.num_rows - 1, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(within)], [*b.schema.names, "_p", "_in"])

    return run


def counted_ranges(df: DataFrame, by: list[str], order: list[str], weight: str) -> DataFrame:
    """``df`` over ranges of by and order, written, with the range (_p) and the weight before each row in its group and range (_in)."""
    keys = [*by, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([*ranged.schema.fields, T.StructField("_p", T.IntegerType()), T.StructField("_in", T.LongType())])
    return saved(ranged.mapInArrow(_counted(by, weight), schema))


def running(df: DataFrame, by: list[str], order: list[str], weight: str | None = None, name: str = "before") -> DataFrame:
    """``df`` with the weight (or number) of the rows of the same ``by`` before each row in ``order``; written once.

    Rows that are equal in ``by`` and ``order`` stand one after the other in
    any order.  Nulls are a group, and come first in an order.
    """
    counted = counted_ranges(df if weight else df.withColumn("_w", F.lit(1).cast("long")), by, order, weight or "_w")
    return carried(counted, by, weight or "_w", name).drop("_p", "_in", *([] if weight else ["_w"]))


def carried(counted: DataFrame, by: list[str], weight: str, name: str) -> DataFrame:
    """Counts within ranges, with what each group has in the ranges before."""
    base = range_sums(counted, by, weight).where("_base > 0").select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), "_base")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)], F.col("_p") == F.col("_q"))
    return counted.join(F.broadcast(base), same, "left").withColumn(name, F.coalesce("_base", F.lit(0)) + F.col("_in")).drop("_q", "_base", *[f"_{i}" for i in range(len(by))])


def range_sums(counted: DataFrame, by: list[str], weight: str) -> DataFrame:
    """by, _p, _sum and _base: what each group weighs in a range, and in those before."""
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return counted.groupBy(*by, "_p").agg(F.sum(weight).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))


def value_places(df: DataFrame, by: list[str], col: str, weight: str | None = None) -> DataFrame:
    """by, col, n and before: each different value with the rows that hold it and those of smaller values."""
    counts = df.groupBy(*by, col).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("long").alias("n"))
    return running(counts, by, [col], "n")


def value_counts(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, _name (the column's place), _v and n: how many rows hold each value of each column, nulls left out."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_name"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)]))
    values = df.select(*by, each.alias("_x")).select(*by, "_x.*").where("_v IS NOT NULL")
    return values.groupBy(*by, "_name", "_v").agg(F.count(F.lit(1)).cast("long").alias("n"))


def medians(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by and ``median_<column>``: exact medians (the mean of the two middle values), nulls left out."""
    return counted_medians(value_counts(df, by, columns), by, columns)


def counted_medians(counts: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The medians of ``value_counts``.

    Values are numbered over ranges; only the range that holds a group's middle
    is looked into.
    """
    group = [*by, "_name"]
    counted = counted_ranges(counts, group, ["_v"], "n")
    sums = range_sums(counted, group, "n")
    total = F.sum("_sum").over(Window.partitionBy(*group))
    middle = sums.withColumn("_low", F.floor((total - 1) / 2)).withColumn("_high", F.floor(total / 2))
    middle = middle.where("_base <= _high AND _low < _base + _sum").drop("_sum")  # one range of a group, or two
    middle = middle.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(group)], F.col("_p").alias("_q"), "_base", "_low", "_high")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(group)], F.col("_p") == F.col("_q"))
    at = F.col("_base") + F.col("_in")
    holds = lambda k: ((at <= F.col(k)) & (F.col(k) < at + F.col("n"))).cast("int")
    near = counted.join(middle, same).withColumn("_k", holds("_low") + holds("_high")).where("_k > 0")
    mid = lambda i, c: (F.sum(F.when(F.col("_name") == i, F.col("_v") * F.col("_k"))) / 2).alias(f"median_{c}")
    return near.groupBy(*by).agg(*[mid(i, c) for i, c in enumerate(columns)])


def shared_out(rows: DataFrame, table: DataFrame, key: list[str], size: str) -> DataFrame:
    """``rows`` joined to ``table``, which has each key once and in ``size`` how many of the rows hold it (then dropped).

    Keys of more than a quarter of a shuffle partition's share, of which there
    are at most four a partition, are joined by broadcast; so no task gets a
    large group.  Rows without a partner drop out.
    """
    spark = rows.sparkSession
    total = table.agg(F.sum(size)).first()[0] or 0
    most = max(1, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    large, small = table.where(F.col(size) > most).drop(size), table.where(F.col(size) <= most).drop(size)
    often = F.broadcast(large)
    return rows.join(often, key).unionByName(rows.join(F.broadcast(large.select(*key)), key, "left_anti").join(small, key))
