"""Joins and reports of the benchmark families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions import expressions as X
from assayframe.functions import stats
from assayframe.operators import ordered
from assayframe.operators import predictions as P
from assayframe.operators import votes as V
from assayframe.operators.tables import saved, small_batches


def checked_join(predictions: DataFrame, manifest: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions with their manifest rows; a key that the manifest lacks fails the query."""
    both = predictions.join(manifest.withColumn("_there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no manifest row for {key} "), F.col(key).cast("string")))
    return both.where(F.when(F.col("_there").isNull(), missing.cast("boolean")).otherwise(True)).drop("_there")


def valid(predictions: DataFrame, score: str = "raw_parsed_score", error: str = "raw_parse_error") -> DataFrame:
    """Rows without a parse error and with a score."""
    return predictions.where(F.col(error).isNull() & F.col(score).isNotNull())


def emotion_metrics(predictions: DataFrame, vote_rows: DataFrame, error_scale: str = "paper_0_10") -> DataFrame:
    """One row: n, pearson, spearman, mae, mse, rmse, accuracy against majority and rounded mean.

    ``predictions(row_id, score)``, and ``suffix`` where they are not on 0-10;
    votes are on 0-2.  Accuracies compare on the predictions' scale, errors on
    ``error_scale``.
    """
    human = V.majority(vote_rows)
    suffix = F.col("suffix") if "suffix" in predictions.columns else F.lit("0_10")
    rows = predictions.join(human, "row_id").withColumn("_s", P.on_one_scale(F.col("score"), suffix, F.col("mean"), error_scale))
    hit = lambda label: (F.col("score") == P.comparable(label, suffix)).cast("double")
    rows = rows.withColumns({"_em": F.col("_s.error_model"), "_eh": F.col("_s.error_human"), "_model": F.col("_s.model_0_10"), "_human": F.col("_s.human_0_10")})
    extra = {"accuracy_majority": hit(F.col("majority")), "accuracy_rounded": hit(V.rounded(F.col("mean")))}
    return stats.metric_block(rows, "_model", "_human", extra=extra, errors=("_em", "_eh"))


def system_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("system_id").agg(F.avg("model").alias("model"), F.avg("mos").alias("mos"))


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join to a lookup table with unique keys; Spark broadcasts it by its size."""
    return rows.join(table, key, "left")


def with_listeners(rows: DataFrame, listeners: DataFrame, key: str) -> DataFrame:
    """Rows with their sorted listener scores (empty without any), count and mean."""
    per = listeners.groupBy(key).agg(F.sort_array(F.collect_list("score")).alias("listener_scores"), F.avg("score").alias("listener_mean_mos"))
    out = rows.join(per, key, "left").withColumn("listener_scores", F.coalesce("listener_scores", F.array().cast("array<int>")))
    return out.withColumn("n_listeners", F.size("listener_scores"))


def with_audio(rows: DataFrame, index: DataFrame, name: str = "wav_name") -> DataFrame:
    """Rows with the indexed file of their name, or else of their stem."""
    by_name = index.select(F.col("name").alias(name), F.col("path").alias("_p1"))
    by_stem = index.groupBy("stem").agg(F.min("path").alias("_p2"))
    out = rows.join(by_name, name, "left").withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", "")).join(by_stem, "stem", "left")
    return out.withColumn("audio_path", F.coalesce("_p1", "_p2")).drop("_p1", "_p2", "stem")


def nearest_prompts(utterances: DataFrame, least: float = 8.0, ideal: float = 12.0) -> DataFrame:
    """For each utterance another of its talk and speaker to prompt with.

    ``utterances(id, talk, speaker, start, duration)``.  Those of ``least``
    seconds or more come first, then the duration nearest to ``ideal``, then the
    nearest start, then the earlier.  Utterances alone in their group drop out;
    see ``without_prompt``.

    Nobody is compared with a whole group: all but one utterance prompt with one
    of the group's best class (short or not, gap to the ideal), found among
    their neighbours in time; where that class is a single utterance, that one
    takes the nearest of the second class.  Neighbours are found by number: the
    times of a group at which the best class speaks are numbered over ranges
    (see ``ordered``), and each time meets the numbers next to it in a join, so
    a group of any size is split.
    """
    group = ["talk", "speaker"]
    rows = utterances.select("id", *group, "start", F.struct((F.col("duration") < least).alias("short"), F.abs(F.col("duration") - ideal).alias("gap")).alias("kind"))
    kinds = rows.groupBy(*group, "kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one"))
    best = kinds.groupBy(*group).agg(F.min(F.struct("kind", "n", "one")).alias("b"), F.sum("n").alias("of")).select(*group, F.col("b.kind").alias("best"), F.col("b.n").alias("n"), F.col("b.one").alias("one"), "of")
    rows = saved(ordered.shared_out(rows, best, group, "of"))
    alone = F.col("n") == 1
    single = rows.where(alone & (F.col("id") != F.col("one"))).select("id", F.col("one").alias("prompt_id"))
    # the lone best itself: one row a group meets the group's second class
    second = rows.where(alone & (F.col("kind") > F.col("best"))).groupBy(*group, "kind").agg(F.count(F.lit(1)).alias("n")).groupBy(*group).agg(F.min(F.struct("kind", "n")).alias("b"))
    lone = rows.where(alone & (F.col("id") == F.col("one"))).join(second, group).select(*group, F.col("id").alias("_id"), F.col("start").alias("_s"), F.col("b.kind").alias("kind"), F.col("b.n").alias("of"))
    near = ordered.shared_out(rows.where(alone).select(*group, "id", "start", "kind"), lone, [*group, "kind"], "of")
    lone = near.groupBy(F.col("_id").alias("id")).agg(F.min_by("id", F.struct(F.abs(F.col("start") - F.col("_s")), "start", "id")).alias("prompt_id"))
    # several of the best class: the nearest times before and after, or at the same time
    at = [*group, "start"]
    many = rows.where(~alone).select("id", *at, F.when(F.col("kind") == F.col("best"), F.col("id")).alias("mine"))
    times = many.groupBy(*at).agg(F.min("mine").alias("a"), F.count(F.lit(1)).alias("of"), F.count("mine").alias("with"))
    other = ordered.shared_out(many.where("mine IS NOT NULL"), times.where("with > 1").select(*at, "a", "of"), at, "of").where("mine > a").groupBy(*at).agg(F.min("mine").alias("b"))
    times = ordered.running(times.withColumn("w", F.col("a").isNotNull().cast("long")), group, ["start"], "w", "k").join(other, at, "left")
    spoken = times.where("w = 1")
    before = spoken.select(*group, (F.col("k") + 1).alias("k"), F.struct("start", F.col("a").alias("id")).alias("p"))
    after = spoken.select(*group, F.col("k").alias("l"), F.struct("start", F.col("a").alias("id")).alias("q"))
    times = times.withColumn("l", F.col("k") + F.col("w")).join(before, [*group, "k"], "left").join(after, [*group, "l"], "left")
    many = ordered.shared_out(many.select("id", *at), times.select(*at, "a", "b", "p", "q", "of"), at, "of")
    here = F.when(F.col("a").isNotNull() & (F.col("a") != F.col("id")), F.col("a")).otherwise(F.col("b"))
    back, ahead = F.col("start") - F.col("p.start"), F.col("q.start") - F.col("start")
    aside = F.when(F.col("q").isNull() | (F.col("p").isNotNull() & (back <= ahead)), F.col("p.id")).otherwise(F.col("q.id"))
    many = many.select("id", F.coalesce(here, aside).alias("prompt_id"))
    return single.unionByName(lone).unionByName(many)


def require_audio(rows: DataFrame, files: DataFrame, name: str = "audio_path") -> DataFrame:
    """``rows``, unless ``files(path)`` lacks one of their files: then the query fails.

    There are as many files as rows, so their table is never broadcast.
    """
    there = files.select(F.col("path").alias(name)).distinct().withColumn("_there", F.lit(True)).hint("merge")
    missing = F.raise_error(F.concat(F.lit("audio not found: "), F.coalesce(F.col(name), F.lit("null")))).cast("boolean")
    return rows.join(there, name, "left").where(F.when(F.col("_there").isNull(), missing).otherwise(True)).drop("_there")


def of_label_set(manifest: DataFrame, name: str) -> DataFrame:
    """The rows of the official labels, or of all."""
    if name not in ("official40", "all42"):
        raise ValueError(f"unknown label set: {name}")
    return manifest.where("is_official_40") if name == "official40" else manifest


def without_prompt(utterances: DataFrame, chosen: DataFrame) -> DataFrame:
    return utterances.join(chosen, "id", "left_anti").withColumn("reason", F.lit("no_prompt_candidate"))


def word_errors(pairs: DataFrame) -> DataFrame:
    """``pairs(key.., reference, hypothesis)`` with edits, n_reference, n_hypothesis and wer."""
    small_batches(pairs.sparkSession)
    rows = pairs.withColumn("_r", X.words(F.col("reference"))).withColumn("_h", X.words(F.col("hypothesis")))
    rows = rows.withColumn("edits", X.word_distance(F.col("_r"), F.col("_h")).cast("long"))
    return rows.withColumn("n_reference", F.size("_r").cast("long")).withColumn("n_hypothesis", F.size("_h").cast("long")).withColumn("wer", X.error_rate(F.col("edits"), F.col("_r"), F.col("_h"))).drop("_r", "_h")


def by_split(pairs: DataFrame, columns: tuple[str, ...] = ("source", "synthetic", "delta")) -> DataFrame:
    """Per split and for 'all': n, mean and exact median of each column.

    Rows are counted by split and value once, by which 'all' is put together, too.
    """
    per = pairs.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("s", F.sum), ("k", F.count))])
    average = lambda c: F.try_divide(F.sum(f"s_{c}"), F.sum(f"k_{c}").cast("double")).alias(f"mean_{c}")
    out = per.rollup("split").agg(F.grouping("split").cast("int").alias("_all"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[average(c) for c in columns])
    counts = saved(ordered.value_counts(pairs, ["split"], list(columns)))
    every = counts.groupBy(F.lit(1).alias("_all"), F.lit(None).cast("string").alias("split"), "_name", "_v").agg(F.sum("n").alias("n"))
    counts = counts.select(F.lit(0).alias("_all"), "split", "_name", "_v", "n").unionByName(every)
    middle = ordered.counted_medians(counts, ["_all", "split"], list(columns)).select(F.col("_all").alias("_a"), F.col("split").alias("_s"), *[f"median_{c}" for c in columns])
    out = out.join(middle, (F.col("_all") == F.col("_a")) & F.col("split").eqNullSafe(F.col("_s")), "left")
    order = [x for c in columns for x in (f"mean_{c}", f"median_{c}")]
    return out.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("split")).alias("split"), "n", *order)


def hit_rates(rows: DataFrame) -> DataFrame:
    """Per condition: items and percent of transcripts that hold a target (0 without items)."""
    return rows.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits")).withColumn("percent", F.when(F.col("n") > 0, F.col("hits") * 100.0 / F.col("n")).otherwise(0.0))


def mismatches(rows: DataFrame) -> DataFrame:
    """How many stated booleans differ from the transcript's hit; an absent one always does."""
    return rows.agg(F.count_if(~F.col("stated").eqNullSafe(F.col("hit"))).alias("mismatches"), F.count(F.lit(1)).alias("n"))
