"""Requests: manifests times prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions import expressions as X
from assayframe.operators.pairs import correct_choice
from assayframe.operators.rows import dense_ids, head


def absolute(root: str, path: Column) -> Column:
    return F.when(path != "", F.concat(F.lit(root.rstrip("/") + "/"), path))


def label_set(name: str, official: list[str], extra: list[str], manifest: DataFrame | None = None) -> list[str] | None:
    """The labels of a set; ``manifest`` means its own distinct labels, ``target`` none but each row's."""
    if name == "official40":
        return list(official)
    if name == "all42":
        return [*official, *extra]
    if name == "target":
        return None
    if name == "manifest" and manifest is not None:
        return [r[0] for r in manifest.select("target_label").distinct().orderBy("target_label").collect()]
    raise ValueError(f"unknown emotion set: {name}")


def one_by_one(manifest: DataFrame, mode: str, config: dict, labels: list[str] | None, root: str = "") -> DataFrame:
    """One request per row and label; per row and own label where ``labels`` is None."""
    rows = manifest.withColumn("scored_emotion", F.explode(F.array(*[F.lit(x) for x in labels])) if labels is not None else F.col("target_label"))
    opposites = config.get("opposites")
    absence = F.concat(F.lit("absence of "), F.col("scored_emotion"))
    opposite = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in opposites.items() for x in kv]), F.col("scored_emotion")), absence) if opposites else absence
    return rows.select(
        F.concat(F.lit("row-"), X.zero_padded(F.col("row_id"), 6), F.lit("__emotion-"), X.slug(F.col("scored_emotion"))).alias("request_id"),
        F.lit(mode).alias("mode"), "row_id", absolute(root, F.col("audio_path")).alias("audio_path"), "target_label", "scored_emotion",
        X.filled(config["prompt_template"], emotion=F.col("scored_emotion"), opposite_emotion=opposite).alias("prompt"),
        F.struct(F.lit(int(config["score_min"])).alias("min"), F.lit(int(config["score_max"])).alias("max")).alias("raw_score_scale"),
        opposite.alias("opposite_emotion"),
    )


def all_at_once(manifest: DataFrame, config: dict, labels: list[str] | None, root: str = "") -> DataFrame:
    if labels is None:
        raise ValueError("the target set is only valid for one-by-one modes")
    names = F.array(*[F.lit(x) for x in labels])
    lines = F.array_join(F.transform(names, lambda e: F.concat(F.lit("- "), e)), "\n")
    return manifest.select(
        F.concat(F.lit("row-"), X.zero_padded(F.col("row_id"), 6), F.lit("__all-emotions")).alias("request_id"),
        F.lit("all_at_once").alias("mode"), "row_id", absolute(root, F.col("audio_path")).alias("audio_path"), "target_label", names.alias("scored_emotions"),
        X.filled(config["prompt_template"], emotion_lines=lines).alias("prompt"),
        F.struct(F.lit(int(config["score_min"])).alias("min"), F.lit(int(config["score_max"])).alias("max")).alias("raw_score_scale"),
    )


def build(manifest: DataFrame, mode: str, configs: dict, labels: list[str] | None, root: str = "") -> DataFrame:
    """Requests of a mode; ``configs`` maps modes to their templates and scales."""
    if mode not in configs:
        raise ValueError(f"unknown mode: {mode}")
    return all_at_once(manifest, configs[mode], labels, root) if mode == "all_at_once" else one_by_one(manifest, mode, configs[mode], labels, root)


def mos_requests(manifest: DataFrame, mode: str, config: dict, prefix: str, root: str = "") -> DataFrame:
    return manifest.select(
        F.concat(F.lit(f"{prefix}__{mode}__row-"), X.zero_padded(F.col("row_id"), 6)).alias("request_id"), F.lit(mode).alias("mode"), "row_id",
        absolute(root, F.col("audio_path")).alias("audio_path"), F.lit(config["prompt_template"]).alias("prompt"),
        F.struct(F.lit(int(config["score_min"])).alias("min"), F.lit(int(config["score_max"])).alias("max")).alias("raw_score_scale"),
    )


def pairwise(wide: DataFrame, mode: str, templates: dict[str, str], order: list[str], prefix: str = "pairs") -> DataFrame:
    """Both orders of each pair, times the questions asked.

    ``wide(pair_id, split, transcript, real_path, synthetic_path)``; pairs are
    numbered in ``order``, requests in the order pair, direction, question.
    """
    numbered = dense_ids(wide, order, "pair_index")
    directions = F.array(
        F.struct(F.lit(0).alias("d"), F.lit("real_a_synthetic_b").alias("direction"), F.lit("real").alias("audio_a_label"), F.lit("synthetic").alias("audio_b_label")),
        F.struct(F.lit(1).alias("d"), F.lit("synthetic_a_real_b").alias("direction"), F.lit("synthetic").alias("audio_a_label"), F.lit("real").alias("audio_b_label")),
    )
    asked = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(t).alias("question_target"), F.lit(text).alias("template")) for i, (t, text) in enumerate(templates.items())])
    rows = numbered.select("*", F.explode(directions).alias("x")).select("*", "x.*", F.explode(asked).alias("y")).select("*", "y.*").drop("x", "y")
    several = len(templates) > 1
    rid = F.concat(F.lit(f"{prefix}__"), F.col("split"), F.lit(f"__{mode}__pair-"), X.zero_padded(F.col("pair_index"), 6), F.lit("__"), F.col("direction"))
    first = F.col("audio_a_label") == "real"
    return rows.select(
        (F.concat(rid, F.lit("__ask-"), F.col("question_target")) if several else rid).alias("request_id"),
        (F.col("pair_index") * 2 * len(templates) + F.col("d") * len(templates) + F.col("q")).alias("row_id"), "pair_id", "direction", "question_target", "audio_a_label", "audio_b_label",
        F.array(F.when(first, F.col("real_path")).otherwise(F.col("synthetic_path")), F.when(first, F.col("synthetic_path")).otherwise(F.col("real_path"))).alias("audio_paths"),
        correct_choice(F.col("audio_a_label"), F.col("question_target")).alias("correct_choice"),
        F.replace(F.col("template"), F.lit("{transcript}"), F.col("transcript")).alias("prompt"),
    )


def conditions(items: DataFrame, names: dict[str, str], prompt: Column) -> DataFrame:
    """Each item under each condition with its audio file: ``names`` maps condition to file."""
    pairs = F.array(*[F.struct(F.lit(k).alias("condition"), F.lit(v).alias("file")) for k, v in names.items()])
    rows = items.select("*", F.explode(pairs).alias("x")).select("*", "x.*").drop("x")
    rid = F.concat(F.lit("in_context_asr__row-"), X.zero_padded(F.col("row_id"), 3), F.lit("__"), F.col("condition"))
    return rows.withColumn("request_id", rid).withColumn("prompt", prompt)


def asr_prompt(mode: str, templates: dict, condition: Column, targets: Column, separators: Column) -> Column:
    """The prompt of an item under a condition.

    ``templates[mode]`` is one template for both conditions or one for each;
    {targets} and {separators} stand for the lists joined by ' | ', {fewshot}
    for ``templates['fewshot']``.
    """
    if mode not in templates:
        raise ValueError(f"unknown prompt mode: {mode}")
    fields = {"targets": F.array_join(targets, " | "), "separators": F.array_join(separators, " | "), "fewshot": F.lit(templates.get("fewshot", ""))}
    given = templates[mode]
    if isinstance(given, str):
        return X.filled(given, **fields)
    out = None
    for name, text in given.items():
        out = (F if out is None else out).when(condition == name, X.filled(text, **fields))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown condition: "), condition)))


def asr_requests(items: DataFrame, mode: str, templates: dict, files: dict[str, str], fewshot_audio: str | None = None) -> DataFrame:
    """Both conditions of every item(row_id, folder, targets, separators) with prompt and audio; a few-shot mode puts its example's audio first."""
    shots = mode.endswith("_fewshot") and not mode.endswith("_text_fewshot")
    if shots and fewshot_audio is None:
        raise ValueError(f"an example's audio is required for {mode}")
    rows = conditions(items, files, F.lit(None).cast("string"))
    rows = rows.withColumn("prompt", asr_prompt(mode, templates, F.col("condition"), F.col("targets"), F.col("separators")))
    audio = F.concat_ws("/", "folder", "file")
    rows = rows.withColumn("mode", F.lit(f"in_context_asr_{mode}")).withColumn("target_label", F.get("targets", F.lit(0))).withColumn("audio_path", audio)
    return rows.withColumn("audio_paths", F.array(F.lit(fewshot_audio), audio) if shots else F.array(audio)).drop("file")


def single_clip(rows: DataFrame, key: str, config: dict, order: list[str], limit: int | None = None, root: str = "", prefix: str = "clips") -> DataFrame:
    """One request for each clip(split, label, sample_id, pair_id, text, audio_path), numbered in ``order``; {transcript} stands for the text.

    A config with features asks for a score of each.
    """
    numbered = dense_ids(head(rows, limit, order), order, "row_id")
    features = config.get("features")
    rid = F.concat(F.lit(f"{prefix}__"), F.col("split"), F.lit(f"__{key}__row-"), X.zero_padded(F.col("row_id"), 6), F.lit("__"), F.col("label"))
    return numbered.select(
        rid.alias("request_id"), F.lit(key if features else "one_by_one").alias("mode"), "row_id", absolute(root, F.col("audio_path")).alias("audio_path"),
        F.replace(F.lit(config["prompt_template"]), F.lit("{transcript}"), F.col("text")).alias("prompt"),
        F.struct(F.lit(int(config["score_min"])).alias("min"), F.lit(int(config["score_max"])).alias("max")).alias("raw_score_scale"),
        "split", "label", "sample_id", "pair_id", F.col("text").alias("transcript"), F.lit(key).alias("prompt_mode"),
        (X.named(features) if features else F.lit(None).cast("array<string>")).alias("scored_features"),
    )


def speech_rows(records: DataFrame, root: str) -> DataFrame:
    """What a speech generator is given: id, text, absolute paths, speaker, talk, split."""
    return records.select(
        F.col("utterance_id").alias("id"), "text", *[absolute(root, F.col(f"{k}_audio_path")).alias(f"{k}_wav") for k in ("prompt", "real", "synthetic")],
        F.col("speaker_id").alias("speaker"), "talk_id", "split",
    )


def with_placeholders(prompt: Column, n: int, span: str, chat: tuple[str, str] | None = None) -> Column:
    """A prompt with ``n`` audio spans before it where it names none, in a chat frame if given."""
    marked = F.when(F.contains(prompt, F.lit(span)), prompt).otherwise(F.concat(F.lit((span + "\n") * n), prompt))
    return F.concat(F.lit(chat[0]), marked, F.lit(chat[1])) if chat else marked
