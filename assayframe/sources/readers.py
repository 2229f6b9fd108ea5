"""Readers with explicit schemas; every line source can carry its ordinal."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayframe.functions import expressions as X
from assayframe.operators.rows import with_columns_checked

# fixed values: the fields of an utterance line
STM_FIELDS = ("talk_id", "channel", "speaker_id", "start_s", "end_s", "labels", "text")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_with_keys(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``keys``: the names that were there, null or not, and ``line``."""
    lines = spark.read.text(path).where(F.length(X.stripped(F.col("value"))) > 0)
    return lines.select(F.from_json("value", schema).alias("r"), F.json_object_keys("value").alias("keys"), F.col("value").alias("line")).select("r.*", "keys", "line")


def key_value(spark: SparkSession, path: str, key: str, value: str = "mean") -> DataFrame:
    """A lookup (key, value double) from a CSV with header; empty where there is no file."""
    schema = f"{key} string, {value} double"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = with_columns_checked(spark.read.option("header", True).csv(path), [key, value])
    return raw.select(F.col(key), F.col(value).try_cast("double").alias(value))


def listener_tsv(spark: SparkSession, path: str, clean_only: bool = False) -> DataFrame:
    """utteranceId, score of a TSV with header; rows with a bad score are skipped."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    if clean_only:
        raw = raw.where("clean = '1'")
    return raw.select("utteranceId", F.col("choice").try_cast("int").alias("score")).where("score IS NOT NULL")


def listener_csv(spark: SparkSession, path: str) -> DataFrame:
    """file, score of a headerless CSV; short rows and bad scores are skipped."""
    raw = spark.read.schema("a string, file string, score string").option("mode", "PERMISSIVE").csv(path)
    return raw.select("file", F.col("score").try_cast("int").alias("score")).where("file IS NOT NULL AND score IS NOT NULL")


def mos_list(spark: SparkSession, path: str, header: bool, split: str, names: tuple[str, str] = ("name", "mos")) -> DataFrame:
    """name and mos of a list; the split 'unlabeled' has none."""
    if header:
        raw = spark.read.option("header", True).csv(path).select(F.col(names[0]).alias("name"), F.col(names[1]).alias("mos"))
    else:
        raw = spark.read.schema("name string, mos string").csv(path)
    mos = F.lit(None).cast("double") if split == "unlabeled" else F.col("mos").try_cast("double")
    return raw.where("name IS NOT NULL").select("name", mos.alias("mos"), F.lit(split).alias("split"))


def utterance_lines(spark: SparkSession, path: str) -> DataFrame:
    """Utterances of STM files: seven fields by white space, the text the last.

    Lines of six fields have no text; fewer are an error.  Gaps, segments to
    ignore, empty texts and intervals without length are left out.
    """
    lines = spark.read.text(path).where(F.length(X.stripped(F.col("value"))) > 0)
    parts = F.split(X.stripped(F.col("value")), r"\s+", 7)
    parts = F.when(F.size(parts) >= 6, parts).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("array<string>"))
    rows = lines.select(parts.alias("p")).select(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(STM_FIELDS)])
    rows = rows.withColumn("start_s", F.col("start_s").cast("double")).withColumn("end_s", F.col("end_s").cast("double")).withColumn("text", X.clean_transcript(F.col("text")))
    rows = rows.withColumn("duration_s", F.col("end_s") - F.col("start_s"))
    rows = rows.where((F.col("duration_s") > 0) & (F.length("text") > 0) & ~F.lower("text").isin("ignore_time_segment_in_scoring") & ~F.lower("talk_id").contains("inter_segment_gap") & ~F.lower("speaker_id").contains("inter_segment_gap"))
    return rows.withColumn("utterance_id", utterance_id("talk_id", "speaker_id", "start_s", "end_s"))


def utterance_id(talk: str, speaker: str, start: str, end: str):
    return F.format_string("%s__%s__%.3f_%.3f", F.col(talk), F.col(speaker), F.col(start), F.col(end))


def probe_items(spark: SparkSession, root: str) -> DataFrame:
    """One row per numbered folder with its text.txt: row_id, full_text, targets, separators."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "text.txt").text(root, wholetext=True)
    field = lambda name: F.trim(F.regexp_extract("value", rf"(?m)^{name}:[ \t]*(.*)$", 1))
    listed = lambda text, sep: F.filter(F.transform(F.split(text, sep), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return files.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)/text\.txt$", 1).cast("int").alias("row_id"),
        field("full").alias("full_text"), listed(field("target"), r"\|").alias("targets"), listed(field("separators"), ",").alias("separators"),
    )


def audio_index(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """name, stem, path, bytes of all files under a folder; of equal names the first path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", F.col("length").alias("bytes"))
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    files = files.groupBy("name").agg(F.min_by(F.struct("path", "bytes"), "path").alias("f")).select("name", "f.*")
    return files.withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))


def content_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, bytes, sha256 of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def with_file_facts(rows: DataFrame, hashes: DataFrame, name: str = "audio_path") -> DataFrame:
    """``rows`` with audio_exists, audio_num_bytes and audio_sha256, from ``hashes(path, bytes, sha256)``."""
    facts = hashes.select(F.col("path").alias(name), F.col("bytes").alias("audio_num_bytes"), F.col("sha256").alias("audio_sha256"))
    return rows.join(facts, name, "left").withColumn("audio_exists", F.col("audio_sha256").isNotNull())


def audio_extension(path, content):
    """'.wav', '.mp3', '.flac' or '.bin' by a file name's suffix, else by its first bytes."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    magic = F.hex(F.substring(content, 1, 4))
    by_bytes = F.when(magic == "52494646", ".wav").when(magic.startswith("494433") | magic.startswith("FFFB"), ".mp3").when(magic == "664C6143", ".flac").otherwise(".bin")
    return F.when(suffix.isin(".wav", ".mp3", ".flac", ".ogg", ".m4a"), suffix).otherwise(by_bytes)


def pair_tsv(spark: SparkSession, path: str) -> DataFrame:
    """src_audio and tgt_audio of a TSV with header; both columns are required."""
    return with_columns_checked(spark.read.option("header", True).option("sep", "\t").csv(path), ["src_audio", "tgt_audio"])


def load_config(path: str, spark: SparkSession | None = None) -> dict:
    """A JSON configuration; with a session, from any place that Spark reads."""
    if spark:
        return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def resolve_root(given: str | None, variable: str, config: dict, key: str = "data_root") -> str:
    """A data root: given, else of the environment, else of the config."""
    return given or os.environ.get(variable) or config[key]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
