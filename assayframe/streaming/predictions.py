"""New prediction files as a stream: stateless parsing, metrics per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import expressions as X

SCHEMA = "request_id string, repeat_index int, raw_response_text string"


def parsed_stream(spark: SparkSession, folder: str, low: float, high: float, schema: str = SCHEMA) -> DataFrame:
    """Predictions of JSON-lines files as they come, with their scores."""
    rows = spark.readStream.schema(schema).json(folder)
    return rows.withColumn("raw_parsed_score", X.final_score(F.col("raw_response_text"), low, high))


def keep(stream: DataFrame, out: str, checkpoint: str, refresh: Callable[[DataFrame], None] | None = None):
    """Append each batch to ``out`` once, then let ``refresh`` see the whole table."""

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is tried again replaces its own folder
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if refresh:
            refresh(batch.sparkSession.read.parquet(out))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scores_by_event_window(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and means of ``events(ts, event_type, value)`` by event-time window, late rows dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
