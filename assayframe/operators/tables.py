"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: the open scopes of this thread, outermost first; queries of other threads have their own
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Only in local mode a temporary folder is made and set where it is unset;
    on a cluster that is an error, as no other machine would see such a folder.
    """
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="assayframe-"))
        place = context.getCheckpointDir()
    return place.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read back.

    Cuts the lineage; the files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def scratch(spark: SparkSession) -> str:
    """A new place in the shared folder; what is written there goes with the innermost scope of ``temporary``."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if scopes := _scopes.get():
        scopes[-1].append(path)
    return path


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``saved`` wrote and nothing reads any more."""
    _delete(df.sparkSession, df._saved_at)


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary(spark: SparkSession):
    """Deletes at the end the tables saved inside, but for those that ``keep`` was given."""
    own: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._saved_at)
        return df

    outer = _scopes.get()
    token = _scopes.set((*outer, own))
    try:
        yield keep
    finally:
        _scopes.reset(token)
        for place in own:
            if place in kept:
                if outer:
                    outer[-1].append(place)
            else:
                _delete(spark, place)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Hand Python workers Arrow batches of at most 1000 rows or about 8 MB.

    Session settings, only ever lowered: texts are large, and a worker holds a
    batch in several forms at once.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
