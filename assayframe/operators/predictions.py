"""From raw answers to typed predictions, and from predictions to scores on one scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions import expressions as X

# fixed values: score fields in the order in which they are looked for, per benchmark family,
# the scales a key's name can end in, the fields whose presence tells a scale, and the scale without any hint
FAMILIES = {
    "emotion": {
        "fields": ("raw_parsed_score_0_10", "raw_parsed_emotion_score_0_10", "raw_parsed_score_0_2", "raw_parsed_emotion_score_0_2", "raw_parsed_score"),
        "endings": ("0_10", "0_2"),
        "hints": (("raw_parsed_score_0_10", "0_10"), ("raw_parsed_emotion_score_0_10", "0_10")),
        "default": "0_2",
    },
    "mos": {
        "fields": ("raw_parsed_score_1_5", "raw_parsed_score_0_10", "raw_parsed_score_1_10", "raw_parsed_score"),
        "endings": ("1_10", "1_5", "0_10"),
        "hints": (("raw_parsed_score_1_5", "1_5"), ("raw_parsed_score_1_10", "1_10"), ("raw_parsed_score_0_10", "0_10")),
        "default": "1_5",
    },
    "pair": {"fields": ("raw_parsed_score_1_10", "raw_parsed_score"), "endings": ("1_10",), "hints": (), "default": "1_10"},
}
# fixed values: modes with one scalar score, and the one of them that takes the final score
SCALAR_MODES = ("one_by_one", "one_by_one_paper_0_10", "one_by_one_paper_0_10_thinking", "one_by_one_human_rubric")
THINKING_MODE = "one_by_one_paper_0_10_thinking"


def scale_of(keys: Column, scale: Column, family: str, key: str | None = None) -> Column:
    """The scale of a prediction as 'low_high'.

    By the ending of the chosen key, else by the scale it carries, else by the
    fields it has (null or not), else the family's own.
    """
    kind = FAMILIES[family]
    for ending in kind["endings"]:
        if key and key.endswith(f"_{ending}"):
            return F.lit(ending)
    carried = F.when(scale["min"].isNotNull() & scale["max"].isNotNull(), X.scale_suffix(scale["min"], scale["max"]))
    hinted = [F.when(F.array_contains(keys, field), F.lit(suffix)) for field, suffix in kind["hints"]]
    return F.coalesce(carried, *hinted, F.lit(kind["default"]))


def selected_score(df: DataFrame, keys: Column, family: str, key: str | None = None) -> Column:
    """The score field of a prediction: the chosen one, else the first in order that the row has, null or not."""
    column = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    if key:
        return column(key)
    *first, last = FAMILIES[family]["fields"]
    out = None
    for c in first:
        there = F.array_contains(keys, c)
        out = F.when(there, column(c)) if out is None else out.when(there, column(c))
    return out.otherwise(column(last))


def one_scale(rows: DataFrame, suffix: str = "suffix") -> DataFrame:
    """``rows``, unless they are of several scales: then the query fails."""
    kinds = rows.agg(F.array_sort(F.collect_set(suffix)).alias("_kinds"))
    mixed = F.raise_error(F.concat(F.lit("mixed prediction scales are not supported: "), F.array_join("_kinds", ", "))).cast("boolean")
    checked = kinds.where(F.when(F.size("_kinds") > 1, mixed).otherwise(True)).select(F.lit(True).alias("_one"))
    return rows.crossJoin(F.broadcast(checked)).drop("_one")


def on_one_scale(score: Column, suffix: Column, human_raw: Column, error_scale: str = "paper_0_10") -> Column:
    """(model_0_10, human_0_10, error_model, error_human) of a score and a human mean on 0-2.

    A scale 0-10 is taken as it is, any other for 0-2.  Errors are measured on
    0-10 (``paper_0_10``) or on 0-2 (``raw_0_2``).
    """
    if error_scale not in ("paper_0_10", "raw_0_2"):
        raise ValueError(f"unknown error scale: {error_scale}")
    ten = suffix == "0_10"
    model_10, model_2 = F.when(ten, score).otherwise(score * 5), F.when(ten, score / 5).otherwise(score)
    paper = error_scale == "paper_0_10"
    return F.struct(model_10.alias("model_0_10"), (human_raw * 5).alias("human_0_10"), (model_10 if paper else model_2).alias("error_model"), (human_raw * 5 if paper else human_raw).alias("error_human"))


def comparable(label: Column, suffix: Column) -> Column:
    """A human label on 0-2 on the scale of a prediction."""
    return F.when(suffix == "0_10", label * 5.0).otherwise(label.cast("double"))


def with_requests(predictions: DataFrame, requests: DataFrame, prompt_mode: str | None = None, split: str | None = None, score: str = "score", error: str = "raw_parse_error") -> DataFrame:
    """Predictions with their request's columns and ``parsed``.

    A prediction without a request stays, counted as not parsed; one whose
    request is of another prompt mode or split goes.
    """
    asked = requests.withColumn("_asked", F.lit(True))
    both = predictions.join(asked.select("request_id", *[c for c in asked.columns if c not in predictions.columns]), "request_id", "left")
    for column, value in (("prompt_mode", prompt_mode), ("split", split)):
        if value is not None:
            both = both.where(F.col("_asked").isNull() | F.col(column).eqNullSafe(F.lit(value)))
    return both.withColumn("parsed", F.col("_asked").isNotNull() & F.col(score).isNotNull() & F.col(error).isNull()).drop("_asked")


def parse_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """considered, parsed and parse_failures."""
    out = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("considered"), F.count_if("parsed").alias("parsed"))
    return out.withColumn("parse_failures", F.col("considered") - F.col("parsed"))


def filtered(rows: DataFrame, prompt_mode: str | None = None, split: str | None = None, question: str | None = None) -> DataFrame:
    """Rows of a prompt mode, split and question, where one is given; rows without a question ask for the synthetic one."""
    for column, value in (("prompt_mode", prompt_mode), ("split", split)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows if question is None else rows.where(F.coalesce("question_target", F.lit("synthetic")) == question)


def typed(rows: DataFrame, text: str = "raw_response_text") -> DataFrame:
    """Each answer parsed by its request's mode; an unknown mode fails the query.

    ``rows(request_id, mode, raw_score_scale struct<min,max>, expected
    array<string>, correct_choice, raw_response_text)``: ``expected`` are the
    labels or features of the modes that score several.
    """
    t, low, high = F.col(text), F.col("raw_score_scale.min").cast("double"), F.col("raw_score_scale.max").cast("double")
    mode, none = F.coalesce("mode", F.lit("one_by_one")), F.lit(None)
    scalar, pairwise = mode.isin(*SCALAR_MODES), mode == "pairwise_real_vs_synthetic"
    known = [scalar, mode == "one_by_one_contrastive_rubric", mode == "quality_features_1_10", pairwise, mode == "all_at_once"]
    unknown = F.raise_error(F.concat(F.lit("unknown request mode: "), mode)).cast("string")
    rows = rows.withColumn("_mode", F.when(known[0] | known[1] | known[2] | known[3] | known[4], mode).otherwise(unknown))
    one = F.when(mode == THINKING_MODE, X.final_score(t, low, high)).when(scalar, X.first_number(t, low, high))
    two = F.when(known[1], X.contrastive_scores(t, low, high))
    many = F.when(known[4], X.label_scores(t, F.col("expected"), low, high))
    parts = F.when(known[2], X.feature_scores(t, F.col("expected"), low, high))
    rows = rows.withColumns({"_one": one, "_two": two, "_many": many, "_parts": parts, "_choice": F.when(pairwise, X.choice(t))})
    error = (
        F.when(scalar & F.col("_one").isNull(), F.lit("no numeric score within scale"))
        .when(pairwise & F.col("_choice").isNull(), F.lit("no A/B choice parsed"))
        .otherwise(F.coalesce("_two.error", "_many.error", "_parts.error"))
    )
    return rows.select(
        "request_id", F.col("_mode").alias("mode"), F.when(~pairwise, X.scale_suffix(low, high)).alias("scale"),
        F.coalesce("_one", "_parts.overall_score").alias("raw_parsed_score"), F.col("_two.emotion_score").alias("raw_parsed_emotion_score"), F.col("_two.opposite_score").alias("raw_parsed_opposite_score"),
        F.coalesce("_many.scores", "_parts.scores").alias("raw_parsed_scores"), F.col("_parts.observations").alias("raw_observations"), F.col("_parts.overall_reason").alias("raw_overall_reason"),
        F.coalesce("_many.missing", "_parts.missing").alias("raw_missing"), F.coalesce("_many.extra", "_parts.extra").alias("raw_extra"), F.col("_parts.warning").alias("raw_structure_warning"),
        F.col("_choice").alias("raw_parsed_choice"), F.when(F.col("_choice").isNotNull(), F.col("_choice") == F.col("correct_choice")).otherwise(none.cast("boolean")).alias("is_correct"), error.alias("raw_parse_error"),
    )


def transcript_of(keys: Column, transcript: Column, raw: Column) -> Column:
    """What was transcribed: the field, or the raw answer where it is absent or null."""
    return F.coalesce(F.when(F.array_contains(keys, "transcript"), transcript), raw)
