"""Session helpers shared by the operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.operators.tables import discard, saved, scratch, shared_dir, small_batches, temporary

__all__ = ["ascii_lower", "bitmap", "discard", "fetched_bitmap", "in_bitmap", "salted", "saved", "scratch", "shared_dir", "shuffle_partitions", "small_batches", "table", "temporary"]

WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


MAP_BITS = 1 << 22


def _words(hashes: DataFrame, column: str) -> DataFrame:
    at = F.pmod(F.col(column), F.lit(MAP_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    return hashes.groupBy(F.shiftright(at, 6).alias("id")).agg(F.bit_or(one).alias("bits"))


def bitmap(hashes: DataFrame, column: str) -> DataFrame:
    """One row, ``bits``: a bitmap of MAP_BITS bits in which the hashes are set.

    Its size is fixed (512 kB), so it may be broadcast; ``in_bitmap`` lets
    through every hash that was set and some others.  It keeps rows without
    partners from being shuffled; where a very large table fills it, the join
    behind still picks the right ones.
    """
    # as each word, empty or not, has its place, the array can be looked into directly
    every = hashes.sparkSession.range(0, MAP_BITS >> 6, 1, 1).join(_words(hashes, column), "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits"))


def fetched_bitmap(hashes: DataFrame, column: str) -> DataFrame:
    """The same by way of the driver, in fewer stages; not for native operators."""
    words = _words(hashes, column).toArrow()  # MAP_BITS / 64 rows at most
    every = np.zeros(MAP_BITS >> 6, np.int64)
    every[words.column("id").to_numpy()] = words.column("bits").to_numpy()
    return hashes.sparkSession.createDataFrame(pa.table({"bits": pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), pa.array(every))}))


def in_bitmap(hash_: Column) -> Column:
    at = F.pmod(hash_, F.lit(MAP_BITS))
    word = F.element_at("bits", F.shiftright(at, 6).cast("int") + 1)
    return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def ascii_lower(text: Column) -> Column:
    """Fold A-Z only; ``lower`` would also fold letters beyond ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` with ``salt``, which deals the rows of frequent keys into subgroups.

    A key of more rows than a quarter of a shuffle partition's share gets as
    many salts as it takes to keep its subgroups within that; all others have
    salt 0.  There are at most four such keys a partition, so their list may be
    broadcast.  Rows of one key take salts in turn.
    """
    most = max(1, df.count() // (4 * shuffle_partitions(df.sparkSession)))
    often = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    often = often.withColumn("_n", F.ceil(F.col("_n") / most).cast("long"))
    return df.join(F.broadcast(often), key, "left").withColumn("salt", F.when(F.col("_n").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("_n"))).otherwise(0)).drop("_n")
