"""Sinks.  All go through Spark's committers: a failed job leaves no output."""

from __future__ import annotations

import hashlib
import json
import math
import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, overwrite: bool = False, files: int | None = None) -> None:
    """JSON lines with sorted keys, nulls written."""
    rows = df.select(*sorted(df.columns))
    rows = rows.coalesce(files) if files else rows
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def delimited(df: DataFrame, path: str, fields: list[str], sep: str = ",", overwrite: bool = False) -> None:
    df.select(*fields).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("sep", sep).csv(path)


def score_lines(df: DataFrame, path: str, column: str, order: str, overwrite: bool = False) -> None:
    """One score a line, eight decimals, in an order."""
    lines = df.orderBy(order).select(F.format_string("%.8f", F.col(column)).alias("value"))
    lines.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def by_split(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One folder per split, and ``all`` with the rows of every split; the rows are computed once."""
    mode = "overwrite" if overwrite else "errorifexists"
    both = df.select("*", F.explode(F.array(F.col("split").cast("string"), F.lit("all"))).alias("_part"))
    both.write.mode(mode).partitionBy("_part").parquet(path)


def read_split(spark: SparkSession, path: str, split: str = "all") -> DataFrame:
    return spark.read.parquet(f"{path}/_part={split}")


def publish(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON-lines file that appears whole or not at all: written beside its place, then renamed."""
    spark = df.sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)) and not overwrite:
        raise FileExistsError(path)
    part = f"{path}.part"
    json_lines(df, part, overwrite=True, files=1)
    (made,) = [f.getPath() for f in fs.listStatus(at(part)) if f.getPath().getName().startswith("part-")] or [None]
    fs.delete(at(path), True)
    fs.rename(made, at(path))
    fs.delete(at(part), True)


def audio_files(samples: DataFrame, root: str) -> DataFrame:
    """Write ``samples(name, content)`` as files under ``root``, a folder that all executors share; name, bytes and sha256 of each.

    A task that is run again writes the same bytes; each file appears whole.
    """

    def put(parts):
        for p in parts:
            done = []
            for name, content in zip(p["name"], p["content"], strict=True):
                place = os.path.join(root, name)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                part = f"{place}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, place)
                done.append((name, len(content), hashlib.sha256(content).hexdigest()))
            yield pd.DataFrame(done, columns=["name", "bytes", "sha256"])

    return samples.select("name", "content").mapInPandas(put, "name string, bytes long, sha256 string")


def metadata(df: DataFrame, by: list[str], most: int = 100_000) -> str:
    """Row counts by the given columns as one JSON text; a column of more than ``most`` values is an error."""
    out = {"rows": df.count()}
    for c in by:
        counts = df.groupBy(c).count().limit(most + 1).collect()
        if len(counts) > most:
            raise ValueError(f"{c} has more than {most} values")
        out[c] = {str(r[0]): r[1] for r in counts}
    return json.dumps(out, sort_keys=True)


def value_text(value, form: str | None = None) -> str:
    """A metric as text: '%.3f' for doubles, '%.1%' for shares, '%g' for labels; NaN as 'nan'."""
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if form == "%.1%":
        return f"{value:.1%}"
    if form == "%g":
        return f"{value:g}"
    return f"{value:.3f}" if isinstance(value, float) else str(value)


def report(metrics: DataFrame, forms: dict[str, str] | None = None) -> str:
    """A one-row metric table as 'key: value' lines; ``forms`` gives columns another form than '%.3f'."""
    row = metrics.first()
    return "\n".join(f"{k}: {value_text(v, (forms or {}).get(k))}" for k, v in row.asDict().items())


def distribution(counts: DataFrame, value: str, n: str = "n") -> DataFrame:
    """One row, ``text``: 'value=count' of a small table of counts, by value, whole numbers without a point."""
    number = F.col(value).cast("double")
    shown = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(F.format_string("%s", number))
    pairs = F.array_sort(F.collect_list(F.struct(number.alias("v"), F.concat(shown, F.lit("="), F.col(n).cast("string")).alias("t"))))
    return counts.agg(F.array_join(F.transform(pairs, lambda p: p["t"]), ", ").alias("text"))


def mean_score(scores: DataFrame, column: str = "score") -> DataFrame:
    """rows and mean of a score column; NaN without any."""
    return scores.agg(F.count(column).alias("rows"), F.coalesce(F.avg(column), F.lit(float("nan"))).alias("mean"))
