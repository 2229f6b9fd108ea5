"""An append-only log of model answers: a line a generation, flushed as it is made.

A run deals the requests that the log lacks over tasks.  A task appends each
answer to a file of its own and flushes it before it asks for the next, so what
breaks off loses at most the answers in the making.  A task that is tried again
first reads what its earlier attempts have logged and goes on behind it; a run
that is started again asks only for what is missing.  Answers are keyed by
(request_id, repeat_index); of two attempts that ran at once, the first file's
answer counts.

Python workers write the files, so ``folder`` must be one that every machine
mounts at the same path; a place that only Spark reaches is an error.

Defined cases: a torn last line is no answer and its request is asked again;
rows without a request_id are never asked; requests that repeat are asked once;
an empty table leaves an empty log.
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.operators.judge import Judge
from assayframe.operators.tables import saved

KEY = ["request_id", "repeat_index"]
LINE = "raw_response_text string, repeat_index int, request_id string"


def mounted(folder: str) -> str:
    """The path of a folder for Python's own files."""
    place = urlparse(folder)
    if place.scheme not in ("", "file"):
        raise ValueError(f"answers are logged in a folder that all machines mount, not in {folder}")
    return place.path


def lines(path: str) -> list[dict]:
    """The whole lines of a log file."""
    with open(path, "rb") as f:
        return [json.loads(x) for x in f.read().split(b"\n")[:-1]]


def append(requests: DataFrame, make: Callable[[], Judge], folder: str, together: int = 1, tasks: int | None = None) -> int:
    """Ask for the answers that the log in ``folder`` lacks, ``together`` at a time, and log them; how many were made.

    ``requests(request_id, repeat_index, ...)`` reach the judge with all their
    columns.  They are written before they are dealt by their keys, so a task
    that is tried again has the same ones in the same order.
    """
    spark, root = requests.sparkSession, mounted(folder)
    os.makedirs(root, exist_ok=True)
    run = uuid.uuid4().hex
    open_ = requests.where(F.col("request_id").isNotNull()).dropDuplicates(KEY).join(read(spark, folder).select(*KEY), KEY, "left_anti")
    dealt = saved(open_).repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), *KEY).sortWithinPartitions(*KEY)

    def answer(parts):
        context = TaskContext.get()
        place = os.path.join(root, f"{run}-{context.partitionId():06d}")
        held = {(x["request_id"], x["repeat_index"]) for earlier in glob.glob(f"{place}-*.jsonl") for x in lines(earlier)}
        judge, made = make(), 0
        with open(f"{place}-{context.taskAttemptId()}.jsonl", "ab") as log:
            for p in parts:
                p = p[[k not in held for k in zip(p["request_id"], p["repeat_index"], strict=True)]]
                for lo in range(0, len(p), together):
                    some = p.iloc[lo : lo + together].reset_index(drop=True)
                    for request, repeat, text in zip(some["request_id"], some["repeat_index"], judge.answer(some), strict=True):
                        line = {"request_id": request, "repeat_index": int(repeat), "raw_response_text": text}
                        log.write(json.dumps(line, sort_keys=True).encode() + b"\n")
                        made += 1
                    log.flush()
                    os.fsync(log.fileno())
        yield pd.DataFrame({"made": [made]})

    return dealt.mapInPandas(answer, "made long").agg(F.coalesce(F.sum("made"), F.lit(0))).first()[0]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """request_id, repeat_index and raw_response_text of each answer in the log."""
    rows = spark.read.option("pathGlobFilter", "*.jsonl").text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    # keys are sorted: a line that ends early has no request_id
    rows = rows.where(F.endswith("value", F.lit("}"))).select("file", F.from_json("value", LINE).alias("x")).select("file", "x.*").where("request_id IS NOT NULL")
    return rows.groupBy(*KEY).agg(F.min_by("raw_response_text", "file").alias("raw_response_text"))
