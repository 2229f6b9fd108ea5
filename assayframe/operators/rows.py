"""Row numbers, limits, zips and checks over explicit orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayframe.functions import expressions as X
from assayframe.operators.tables import saved

_PLACE = 33  # a place within its partition takes the lowest bits of monotonically_increasing_id


def dense_ids(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """``df`` with dense numbers from 0 in ``order``.

    Rows are range-partitioned and sorted, each with its place in its range,
    and written once; a range's numbers are shifted by the sizes of those
    before it, a table of one row per range.
    """
    at = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PLACE)
    sizes = at.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE) - 1))
    return at.withColumn("_p", part).join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + place).drop("_p", "_at", "_base")


def head(df: DataFrame, n: int | None, order: list[str]) -> DataFrame:
    """The first n rows in an order; all without n."""
    return df if n is None else df.orderBy(*order).limit(n)


def head_where(df: DataFrame, condition: Column, n: int | None, order: list[str]) -> DataFrame:
    """The first n rows that meet a condition; those that don't, don't count."""
    return head(df.where(condition), n, order)


def lines(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """The raw lines of text files with their order (file, block, place); the first n of them, blank ones counted."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return head(read, n, ["file", "block", "place"])


def json_head(spark: SparkSession, path: str, schema: str, raw: int | None = None, parsed: int | None = None) -> DataFrame:
    """JSON lines of the first ``raw`` lines, or the first ``parsed`` rows.

    Blank lines count for ``raw`` only.  A row limit is looked at after a row is
    taken, so 0 still yields one row.
    """
    rows = lines(spark, path, raw).where(F.length(X.stripped(F.col("value"))) > 0)
    rows = head(rows, None if parsed is None else max(parsed, 1), ["file", "block", "place"])
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def zipped(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str]) -> DataFrame:
    """Row i of one side with row i of the other, in their orders; unequal lengths fail the query."""
    a, b = dense_ids(left, order_left, "ordinal"), dense_ids(right, order_right, "ordinal")
    both = a.withColumn("_l", F.lit(True)).join(b.withColumn("_r", F.lit(True)), "ordinal", "full")
    uneven = F.raise_error(F.lit("the sides of the zip differ in length")).cast("boolean")
    return both.where(F.when(F.col("_l").isNull() | F.col("_r").isNull(), uneven).otherwise(True)).drop("_l", "_r")


def snippets(df: DataFrame, n: int, order: list[str], text: str = "raw_response_text", key: str = "request_id") -> DataFrame:
    """The first n raw texts, each on one line of at most 500 characters."""
    return df.orderBy(*order).limit(n).select(key, X.snippet(F.col(text)).alias("snippet"))


def union_all(parts: dict[str, DataFrame], name: str = "split") -> DataFrame:
    """The parts under one another, each named; columns go by name, absent ones are null."""
    out = None
    for part, df in parts.items():
        rows = df.withColumn(name, F.lit(part))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def with_columns_checked(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
