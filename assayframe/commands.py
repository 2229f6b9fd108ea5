"""Whole steps of the benchmarks, from files to requests and reports, as functions.

Each reads JSON lines, composes operators, and returns DataFrames: nothing is
computed before they are written or shown.  ``sources.writers.report`` turns a
one-row report into text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import expressions as X
from assayframe.functions import stats
from assayframe.operators import benchmarks as B
from assayframe.operators import pairs as P
from assayframe.operators import predictions as Y
from assayframe.operators import requests as R
from assayframe.operators import rows
from assayframe.operators import votes as V
from assayframe.sources import readers

SCALE = "raw_score_scale struct<min:int,max:int>, raw_parse_error string"
VOTES = "row_id long, target_label string, is_official_40 boolean, audio_path string, annotator_scores_raw_0_2 map<string,int>"
MOS = "row_id long, system_id string, split string, audio_path string, mos double"
CLIP = "request_id string, repeat_index int"
REQUEST = "request_id string, split string, prompt_mode string, label string, pair_id string"
AB = "request_id string, pair_id string, direction string, question_target string, prompt_mode string, split string, correct_choice string, raw_parsed_choice string"
PROBE = "request_id string, row_id long, condition string, targets array<string>, separators array<string>, transcript string, raw_response_text string, target_present boolean, target_before_repeat boolean, target_after_repeat boolean"


def _scored(spark: SparkSession, path: str, family: str, key: str | None, more: str) -> DataFrame:
    """Predictions with score and suffix, valid or not."""
    fields = dict.fromkeys([*Y.FAMILIES[family]["fields"], *([key] if key else [])])
    read = readers.json_lines_with_keys(spark, path, ", ".join([more, SCALE, *(f"{f} double" for f in fields)]))
    return read.withColumn("suffix", Y.scale_of(F.col("keys"), F.col("raw_score_scale"), family, key)).withColumn("score", Y.selected_score(read, F.col("keys"), family, key))


def _parsed(rows_: DataFrame) -> DataFrame:
    return rows_.agg(F.count(F.lit(1)).alias("considered"), F.count_if(F.col("raw_parse_error").isNull() & F.col("score").isNotNull()).alias("parsed"))


def votes_of(spark: SparkSession, manifest: str) -> DataFrame:
    """row_id, annotator, score of a manifest."""
    return V.long_votes(readers.json_lines(spark, manifest, VOTES))


def emotion_splits(spark: SparkSession, manifest: str, per_label: int, seed: int = 13, label_set: str = "official40") -> DataFrame:
    """``per_label`` rows of each label of a set, by row number."""
    of = B.of_label_set(readers.json_lines(spark, manifest, VOTES), label_set)
    return V.stratified_exact(of, "target_label", "row_id", per_label, seed).orderBy("row_id")


def emotion_requests(spark: SparkSession, manifest: str, mode: str, configs: dict, label_set: str, official: list[str], extra: list[str], limit: int | None = None, root: str = "") -> DataFrame:
    """Requests of a mode over the first ``limit`` lines of a manifest."""
    of = rows.json_head(spark, manifest, VOTES, raw=limit)
    return R.build(of, mode, configs, R.label_set(label_set, official, extra, of), root)


def mos_requests(spark: SparkSession, manifest: str, mode: str, config: dict, prefix: str, limit: int | None = None, root: str = "", missing_audio: bool = False) -> DataFrame:
    of = readers.json_lines(spark, manifest, MOS)
    there = F.lit(True) if missing_audio else F.col("audio_path").isNotNull() & (F.col("audio_path") != "")
    return R.mos_requests(rows.head_where(of, there, limit, ["row_id"]), mode, config, prefix, root)


def summarize_emotion(spark: SparkSession, predictions: str, manifest: str, score_key: str | None = None, error_scale: str = "paper_0_10", prediction_scale: str = "auto") -> DataFrame:
    """One row: considered, parsed, scale and the metrics against the votes."""
    read = _scored(spark, predictions, "emotion", score_key, "row_id long")
    if prediction_scale != "auto":
        read = read.withColumn("suffix", F.lit({"paper_0_10": "0_10", "raw_0_2": "0_2"}[prediction_scale]))
    valid = Y.one_scale(B.valid(read, "score"))
    metrics = B.emotion_metrics(valid, votes_of(spark, manifest), error_scale)
    return _parsed(read).crossJoin(valid.agg(F.first("suffix").alias("scale"))).crossJoin(metrics)


def summarize_mos(spark: SparkSession, predictions: str, manifest: str, score_key: str | None = None) -> DataFrame:
    """Two rows, by utterance and by system, on 1-5; a prediction without a manifest row fails the query."""
    read = B.valid(_scored(spark, predictions, "mos", score_key, "row_id long"), "score").select("row_id", X.to_mos(F.col("score"), F.col("suffix")).alias("model"))
    both = B.checked_join(read, readers.json_lines(spark, manifest, MOS).select("row_id", "system_id", "mos"))
    level = lambda df, name: stats.metric_block(df, "model", "mos").select(F.lit(name).alias("level"), "*")
    return level(both, "utterance").unionByName(level(B.system_means(both), "system"))


def summarize_clips(spark: SparkSession, predictions: str, requests: str, prompt_mode: str | None = None, split: str | None = None, average_repeats: bool = False, score_key: str | None = None) -> DataFrame:
    """One row: parse counts and the differences synthetic less real of complete pairs."""
    read = _scored(spark, predictions, "pair", score_key, CLIP)
    asked = readers.json_lines(spark, requests, REQUEST)
    both = Y.with_requests(read.select("request_id", "repeat_index", "score", "raw_parse_error"), asked, prompt_mode, split)
    valid = both.where("parsed").withColumn("ord", F.coalesce("repeat_index", F.lit(0)))
    if average_repeats:
        valid = valid.groupBy("request_id", "pair_id", "label").agg(F.avg("score").alias("score"), F.min("ord").alias("ord"))
    return Y.parse_counts(both).crossJoin(P.delta_summary(P.deltas(valid.select("pair_id", "label", "score", F.struct("ord", "request_id").alias("ord")))))


def summarize_choices(spark: SparkSession, predictions: str, requests: str | None = None, prompt_mode: str | None = None, split: str | None = None, question: str | None = None, expected: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rates by direction, question and overall; and complete pairs with their mean score."""
    read = readers.json_lines(spark, predictions, AB)
    if requests is not None:
        asked = readers.json_lines(spark, requests, AB)
        mine = read.select([F.col(c).alias(f"_{c}") if c != "request_id" else F.col(c) for c in read.columns])
        both = mine.join(asked, "request_id", "left")
        read = both.select("request_id", *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in read.columns if c != "request_id"])
    kept = Y.filtered(read, prompt_mode, split, question)
    cells = kept.select(
        "pair_id", F.coalesce("direction", F.lit("unknown")).alias("direction"), F.coalesce("question_target", F.lit("synthetic")).alias("question"),
        F.when(F.col("raw_parsed_choice").isin("A", "B"), F.col("raw_parsed_choice")).alias("choice"), F.col("correct_choice").alias("correct"), F.col("request_id").alias("ord"),
    )
    return P.choice_rates_grouped(cells), P.pair_score(P.complete_pairs(cells, expected))


def summarize_probe(spark: SparkSession, predictions: str) -> DataFrame:
    """Hit rates of the targets by condition, with and after the repeat's separator."""
    read = readers.json_lines_with_keys(spark, predictions, PROBE)
    text = X.asr_text(Y.transcript_of(F.col("keys"), F.col("transcript"), F.col("raw_response_text")))
    parts = X.split_once(text, F.transform("separators", X.asr_text))
    hit = lambda t: F.exists("targets", lambda x: F.contains(t, X.asr_text(x)))
    rows_ = read.withColumn("text", text).withColumn("parts", parts)
    alone, again = F.col("condition") == "without_repeat", F.col("condition") == "with_repeat"
    kinds = F.array(
        F.struct(F.lit("without_repeat").alias("condition"), alone.alias("on"), hit(F.col("text")).alias("hit")),
        F.struct(F.lit("before_repeat").alias("condition"), again.alias("on"), F.coalesce(F.col("parts.after").isNotNull() & hit(F.col("parts.before")), F.lit(False)).alias("hit")),
        F.struct(F.lit("after_repeat").alias("condition"), again.alias("on"), F.coalesce(hit(F.col("parts.after")), F.lit(False)).alias("hit")),
    )
    return B.hit_rates(rows_.select(F.explode(kinds).alias("k")).select("k.*").where("on"))


def human_ceiling(spark: SparkSession, manifest: str, reference: str = "leave_one_out") -> DataFrame:
    return stats.rotations(votes_of(spark, manifest), reference)


def human_agreement(spark: SparkSession, manifest: str, iterations: int = 1000, seed: int = 13) -> dict[str, DataFrame]:
    """alpha, kappa, exact and pairwise agreement, split halves (their means over iterations)."""
    v = votes_of(spark, manifest)
    halves = stats.split_half(v, iterations, seed)
    return {"alpha": stats.krippendorff(v), "kappa": stats.kappa_summary(v), "agreement": V.agreement(v), "split_half": halves.agg(*[F.avg(c).alias(c) for c in ("pearson", "spearman", "reliability")])}
