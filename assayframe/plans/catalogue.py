"""The engine's queries over the driver's tables.  Each has its SQL in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import expressions as X
from assayframe.functions import stats
from assayframe.operators import benchmarks as B
from assayframe.operators import judge as J
from assayframe.operators import manifests as M
from assayframe.operators import pairs as P
from assayframe.operators import requests as R
from assayframe.operators import rows, vectors
from assayframe.operators import votes as V
from assayframe.operators.tables import saved
from assayframe.plans import fixtures as fx
from assayframe.plans import vocabulary
from assayframe.sources import readers

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(fx.Tables(spark, sf_dir))
    QUERIES[f.__name__].__doc__ = f.__doc__
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles that depend on the order of summation, to a fixed precision."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# votes


@query
def vote_long(t):
    return fx.votes(t)


@query
def vote_summary(t):
    return rounded(V.summary(fx.votes(t)), "mean_score_raw_0_2", "mean_score_0_10", "std_score_0_10")


@query
def majority_vote(t):
    return V.majority(fx.votes(t)).select("row_id", "majority")


@query
def rounded_mean(t):
    return V.summary(fx.votes(t)).select("row_id", V.rounded(F.col("mean_score_raw_0_2")).alias("rounded"))


@query
def label_counts(t):
    return fx.emotion_predictions(t).groupBy("target_label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("score").alias("scores")).orderBy("target_label")


@query
def emotion_metrics(t):
    """The flagship: predictions against human votes."""
    p = B.valid(fx.emotion_predictions(t), "score")
    out = B.emotion_metrics(p, fx.votes(t))
    return rounded(out, "pearson", "spearman", "mae", "mse", "rmse", "accuracy_majority", "accuracy_rounded")


@query
def score_distribution(t):
    return B.valid(fx.emotion_predictions(t), "score").groupBy("score").agg(F.count(F.lit(1)).alias("n"))


@query
def parse_error_counts(t):
    p = fx.emotion_predictions(t)
    return p.groupBy("target_label").agg(F.count(F.lit(1)).alias("considered"), F.count_if(F.col("raw_parse_error").isNull()).alias("parsed"))


@query
def missing_votes(t):
    """Predictions without any vote."""
    return fx.emotion_predictions(t).join(fx.votes(t), "row_id", "left_anti").select("row_id")


@query
def spearman_ranks(t):
    p = fx.emotion_predictions(t).select("row_id", "target_label", "score")
    return stats.average_ranks(p, "score", "rank", ["target_label"]).select("row_id", "rank")


@query
def annotator_pairs(t):
    return stats.annotator_pairs(fx.votes(t)).groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("l") == F.col("r")).alias("equal"))


@query
def pair_agreement(t):
    return rounded(V.agreement(fx.votes(t)), "exact_rows", "pair_agreement", "mean_difference")


@query
def krippendorff(t):
    return rounded(stats.krippendorff(fx.votes(t)), "alpha")


@query
def cohen_kappa(t):
    return rounded(stats.cohen_kappas(fx.votes(t)), "kappa")


@query
def kappa_summary(t):
    return rounded(stats.kappa_summary(fx.votes(t)), "mean_kappa", "weighted_kappa")


@query
def leave_one_out(t):
    return rounded(stats.leave_one_out(fx.votes(t)), "rest_mean")


@query
def loo_metrics(t):
    """Pooled leave-one-out errors of single votes against the others' mean."""
    held = stats.leave_one_out(fx.votes(t)).withColumn("vote", F.col("score").cast("double"))
    return rounded(stats.metric_block(held, "vote", "rest_mean"), "pearson", "spearman", "mae", "mse", "rmse")


@query
def loo_sample_weighted(t):
    return rounded(V.weighted_by_row(stats.leave_one_out(fx.votes(t)), "score", "rest_mean"), "mae", "mse", "rmse")


@query
def split_half_hash(t):
    return rounded(stats.split_half(fx.votes(t), 10), "pearson", "spearman", "reliability")


@query
def split_half_lattice(t):
    """Reliability over 1,000 halvings of each row."""
    return rounded(stats.split_half_lattice(fx.votes(t), 1000), "pearson", "spearman", "reliability")


@query
def split_medians(t):
    """Means and exact medians of prices per return flag, and of all."""
    lines = t.lineitem.select(F.col("l_returnflag").alias("split"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_extendedprice") * F.col("l_discount")).cast("double").alias("cut"))
    return rounded(B.by_split(lines, ("price", "quantity", "cut")), *[f"{k}_{c}" for k in ("mean", "median") for c in ("price", "quantity", "cut")], digits=4)


@query
def stratified_sample(t):
    return V.stratified(t.documents.select("doc_id", "lang"), "lang", "doc_id", 10)


# raw answers


@query
def stratified_shuffle(t):
    """As many documents of each language as Python's own shuffle picks."""
    return V.stratified_exact(t.documents.where("lang IS NOT NULL").select("doc_id", "lang"), "lang", "doc_id", 10)


@query
def parse_first_number(t):
    return fx.answers(t).select("event_id", X.first_number(F.col("raw"), 0, 10).alias("score"))


@query
def parse_final_score(t):
    return fx.answers(t).select("event_id", X.final_score(F.col("raw"), 0, 10).alias("score"))


@query
def parse_json_span(t):
    return fx.answers(t).select("event_id", X.json_span(F.col("raw")).alias("span"))


@query
def parse_choice(t):
    return fx.answers(t).select("event_id", X.choice(F.col("raw")).alias("choice"))


@query
def parse_label_scores(t):
    s = X.label_scores(F.col("raw"), ["joy", "fear"], 0, 10)
    return fx.answers(t).select("event_id", s.alias("s")).select(
        "event_id", F.element_at("s.scores", F.lit("joy")).alias("joy"), F.array_join("s.missing", ",").alias("missing"), F.array_join("s.extra", ",").alias("extra"),
        F.array_join(F.array_sort(F.map_keys("s.invalid")), ",").alias("invalid"), F.col("s.error").alias("error"),
    )


@query
def parse_bool(t):
    words = F.array(F.lit(" Yes "), F.lit("no"), F.upper(F.lit("true")), F.lit("0"), F.col("event_type"), F.lit("N"), (F.floor("value") % 3).cast("string"))
    return t.events.select("event_id", X.boolean(F.element_at(words, (F.col("event_id") % 7 + 1).cast("int"))).alias("flag"))


@query
def text_helpers(t):
    """Slugs, safe ids, snippets, sizes and suffixes over the documents' heads and the parts' types."""
    p = t.part
    return p.select(
        "p_partkey", X.slug(F.concat(F.col("p_type"), F.lit(" / & "), F.col("p_brand"))).alias("slug"), X.safe_id(F.concat(F.lit("_"), F.col("p_name"), F.lit(" #"))).alias("safe"),
        X.snippet(F.concat(F.col("p_name"), F.lit("\nline")), 12).alias("snippet"), X.scale_suffix(F.lit(0), F.col("p_size")).alias("suffix"),
        X.clean_transcript(F.concat(F.col("p_name"), F.lit("  it 's "))).alias("clean"),
    )


@query
def target_hits(t):
    s = fx.spoken(t).withColumn("targets", F.array(F.substring_index("reference", " ", 1)))
    s = s.withColumn("hit", X.target_hit(F.col("hypothesis"), F.col("targets")))
    s = s.withColumn("condition", F.when(F.col("conv_id") % 2 == 0, "with_repeat").otherwise("without_repeat"))
    return rounded(B.hit_rates(s), "percent")


@query
def boolean_mismatches(t):
    s = fx.spoken(t)
    hit = X.target_hit(F.col("hypothesis"), F.array(F.substring_index("reference", " ", 1)))
    stated = F.when(F.col("conv_id") % 3 == 0, None).otherwise(F.col("conv_id") % 3 == 1)
    return B.mismatches(s.select(hit.alias("hit"), stated.alias("stated")))


@query
def separator_split(t):
    s = fx.spoken(t)
    parts = X.split_once(F.col("hypothesis"), F.array(F.lit(" of "), F.lit(" the "), F.lit(" de ")))
    return s.select("conv_id", "turn", parts.alias("p")).select("conv_id", "turn", "p.before", "p.after")


# speech quality


@query
def mos_rescale(t):
    suffix = F.when(F.col("system_id") % 3 == 0, "1_10").when(F.col("system_id") % 3 == 1, "0_10").otherwise("1_5")
    r = fx.mos_rows(t).select("system_id", X.to_mos(F.col("raw"), suffix).alias("mos"))
    return rounded(r.groupBy("system_id").agg(F.avg("mos").alias("mos"), F.count(F.lit(1)).alias("n")), "mos")


def _mos(t):
    return fx.mos_rows(t).withColumn("model", X.to_mos(F.col("raw"), F.lit("1_10")))


@query
def mos_metrics_utterance(t):
    return rounded(stats.metric_block(_mos(t), "model", "mos"), "pearson", "spearman", "mae", "mse", "rmse")


@query
def mos_metrics_system(t):
    s = rounded(B.system_means(_mos(t)), "model", "mos", digits=9)
    return rounded(stats.metric_block(s, "model", "mos"), "pearson", "spearman", "mae", "mse", "rmse")


@query
def system_mean_join(t):
    means = t.supplier.select(F.col("s_suppkey").alias("system_id"), F.col("s_acctbal").alias("system_mean_mos"))
    r = B.lookup(fx.mos_rows(t), means, "system_id")
    return r.groupBy("system_id").agg(F.first("system_mean_mos").alias("system_mean_mos"), F.count(F.lit(1)).alias("n"))


@query
def listener_arrays(t):
    heard = t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("score"))
    r = B.with_listeners(t.part.select(F.col("p_partkey").alias("part")), heard, "part")
    return rounded(r.select("part", F.array_join("listener_scores", ",").alias("scores"), F.col("n_listeners").cast("long").alias("n_listeners"), "listener_mean_mos"), "listener_mean_mos")


@query
def mos_manifest(t):
    """Samples with system means, listener scores and dense row ids."""
    p = t.part
    samples = p.select(F.col("p_brand").alias("split"), F.col("p_partkey").cast("string").alias("name"), (F.col("p_partkey") % 10 + 1).alias("system_id"), (1 + F.col("p_size") / 50 * 4).alias("mos"))
    means = t.supplier.select(F.col("s_suppkey").alias("system_id"), F.col("s_acctbal").alias("system_mean_mos"))
    heard = t.lineitem.select(F.col("l_partkey").cast("string").alias("name"), F.col("l_linenumber").alias("score"))
    out = M.mos_manifest(samples, means, heard)
    return rounded(out.select("row_id", "split", "name", "system_id", "system_mean_mos", F.col("n_listeners").cast("long").alias("n_listeners"), "listener_mean_mos"), "listener_mean_mos")


@query
def canonical_labels(t):
    raw = F.concat(F.lit("  "), F.element_at(F.array(*[F.lit(x) for x in (*vocabulary.ALIASES, "Other   label")]), (F.col("p_partkey") % 10 + 1).cast("int")), F.lit(" "))
    return t.part.select(
        "p_partkey", M.canonical_label(raw, vocabulary.ALIASES).alias("label"), M.system_by_marker(F.concat(F.col("p_brand"), F.lit("-utt7-utt8"))).alias("by_marker"),
        M.system_by_underscore(F.concat_ws("_", "p_brand", "p_partkey")).alias("by_underscore"), M.sentence_by_underscore(F.concat_ws("_", "p_brand", "p_partkey")).alias("sentence"),
    )


@query
def missing_audio_filter(t):
    r = fx.mos_rows(t).where("audio_path IS NOT NULL AND audio_path <> ''").withColumn("path", R.absolute("/data", F.col("audio_path")))
    return r.groupBy("system_id").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


# pairs


@query
def pair_deltas(t):
    return P.deltas(fx.pair_rows(t)).select("pair_id", "real", "synthetic", "delta")


@query
def pair_delta_summary(t):
    return rounded(P.delta_summary(P.deltas(fx.pair_rows(t))), "mean")


@query
def repeat_average(t):
    r = fx.mos_rows(t).select(F.concat(F.lit("r"), (F.col("row_id") % 1000).cast("string")).alias("request_id"), F.col("raw").alias("score"), F.concat_ws("-", "row_id", "line").alias("label"), F.struct("row_id", "line", "raw").alias("ord"))
    return rounded(P.repeat_average(r), "score").select("request_id", "score", "repeats", "label")


@query
def pairwise_accuracy(t):
    return rounded(P.choice_rates(fx.cells(t)), "accuracy", "rate_a", "rate_b", "synthetic_a", "synthetic_b")


@query
def pairwise_by_direction(t):
    return rounded(P.choice_rates_grouped(fx.cells(t)), "accuracy", "rate_a", "rate_b", "synthetic_a", "synthetic_b")


@query
def inferred_synthetic(t):
    c = fx.cells(t)
    return c.select("ord", P.inferred(F.col("choice"), F.col("question")).alias("inferred"))


@query
def complete_pair_scores(t):
    return P.complete_pairs(fx.cells(t))


@query
def correct_histogram(t):
    return P.correct_histogram(P.complete_pairs(fx.cells(t)), 4)


@query
def prompt_choice(t):
    return B.nearest_prompts(fx.utterances(t))


@query
def prompt_skipped(t):
    u = fx.utterances(t)
    return B.without_prompt(u, B.nearest_prompts(u)).select("id", "reason")


@query
def prompt_skipped_by_hour(t):
    """The same with a talk for each hour, in which many speakers are heard once."""
    hours = t.events.select(F.col("event_id").alias("id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH").alias("hour"))
    u = fx.utterances(t).join(hours, "id").drop("talk").withColumnRenamed("hour", "talk")
    return B.without_prompt(u, B.nearest_prompts(u)).select("id", "reason")


@query
def utterance_ids(t):
    u = fx.utterances(t).withColumns({"speaker": F.col("speaker").cast("string"), "from": F.col("id") / 8, "to": F.col("id") / 8 + F.col("speaker") % 50})
    return u.select("id", readers.utterance_id("talk", "speaker", "from", "to").alias("utterance_id"))


@query
def dense_row_ids(t):
    return rows.dense_ids(t.customer.select("c_custkey", "c_nationkey"), ["c_nationkey", "c_custkey"])


@query
def last_row_wins(t):
    e = t.events.select("user_id", "event_id", "event_type")
    return P.last_by(e, "user_id", "event_id")


@query
def merged_predictions(t):
    p = t.orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderstatus").alias("status"))
    q = t.lineitem.groupBy(F.col("l_orderkey").alias("request_id")).agg(F.max("l_linenumber").alias("lines"), F.max("l_returnflag").alias("status"))
    return P.merge_over(p, q)


# requests


@query
def requests_cross(t):
    m = t.orders.select(F.col("o_orderkey").alias("row_id"), F.lit("a.wav").alias("audio_path"), F.col("o_orderpriority").alias("target_label"))
    out = R.one_by_one(m, "one_by_one_contrastive_rubric", vocabulary.CONTRASTIVE, ["Awe", "Jealousy / Envy", "Arousal"], "/data")
    return out.select("request_id", "row_id", "audio_path", "scored_emotion", "prompt", "opposite_emotion")


@query
def requests_all_at_once(t):
    m = t.orders.select(F.col("o_orderkey").alias("row_id"), F.lit("").alias("audio_path"), F.col("o_orderpriority").alias("target_label"))
    config = {"prompt_template": 'Score: {{"scores": {{}}}}\n{emotion_lines}', "score_min": 0, "score_max": 10}
    return R.all_at_once(m, config, ["Awe", "Hope"]).select("request_id", "audio_path", "prompt")


@query
def requests_pairwise(t):
    wide = P.twins(fx.pair_rows(t), "score").select(
        "pair_id", F.lit("dev").alias("split"), F.concat(F.lit("text "), F.col("pair_id").cast("string")).alias("transcript"),
        F.concat(F.lit("r"), F.col("pair_id").cast("string")).alias("real_path"), F.concat(F.lit("s"), F.col("pair_id").cast("string")).alias("synthetic_path"),
    )
    out = R.pairwise(wide, "balanced", vocabulary.PAIR_QUESTIONS, ["pair_id"])
    return out.select("request_id", "row_id", "pair_id", "direction", "question_target", F.array_join("audio_paths", ",").alias("audio_paths"), "correct_choice", "prompt")


@query
def unpivot_pairs(t):
    wide = P.twins(fx.pair_rows(t), "score").select("pair_id", F.concat(F.lit("r"), F.col("pair_id").cast("string")).alias("real_path"), F.concat(F.lit("s"), F.col("pair_id").cast("string")).alias("synthetic_path"))
    return P.unpivot(wide)


@query
def requests_repeats(t):
    r = t.part.select(F.format_string("p%08d", "p_partkey").alias("request_id"))
    return J.with_repeats(r, 3, 100)


# words


@query
def wer_rows(t):
    return rounded(B.word_errors(fx.spoken(t)).select("conv_id", "turn", "edits", "n_reference", "n_hypothesis", "wer"), "wer")


@query
def wer_by_split(t):
    """Word error rates of replies, and of the references themselves read without their word 'e...', both against the references."""
    s = fx.spoken(t)
    w = B.word_errors(s).where("NOT isnan(wer)").select("conv_id", "turn", F.col("wer").alias("synthetic"))
    heard = s.withColumn("hypothesis", F.regexp_replace("reference", r"\be\w*", "x"))
    own = B.word_errors(heard).where("NOT isnan(wer)").select("conv_id", "turn", F.col("wer").alias("source"))
    pairs = w.join(own, ["conv_id", "turn"]).withColumn("split", F.when(F.col("conv_id") % 2 == 0, "dev").otherwise("test")).withColumn("delta", F.col("synthetic") - F.col("source"))
    pairs = saved(pairs.select("split", "source", "synthetic", "delta"))  # texts are compared once
    return rounded(B.by_split(pairs), "mean_source", "median_source", "mean_synthetic", "median_synthetic", "mean_delta", "median_delta")


# vectors


@query
def pair_cosine_features(t):
    p = fx.vector_pairs(t).select("k", vectors.normalised(F.col("a")).alias("a"), vectors.normalised(F.col("b")).alias("b"))
    f = vectors.qe_features(F.col("a"), F.col("b"))
    return rounded(p.select("k", vectors.dot(F.col("a"), F.col("b")).alias("cosine"), F.aggregate(f, F.lit(0.0), lambda s, x: s + x).alias("total"), F.size(f).cast("long").alias("dims")), "cosine", "total", digits=4)


@query
def masked_mean_pool(t):
    e = t.embeddings.select(F.col("label").alias("id"), F.col("vec_id").alias("t"), F.col("embedding").alias("vector"), (F.col("vec_id") % 3 != 0).alias("mask"))
    pooled = vectors.masked_mean(e)
    return rounded(pooled.select("id", F.posexplode("vector").alias("dim", "x")).select("id", F.col("dim").cast("long").alias("dim"), "x"), "x", digits=5)


@query
def autopcp_linear_head(t):
    p = fx.vector_pairs(t)
    weights = [((i * 37) % 11 - 5) / 10 for i in range(256)]
    s = vectors.comparator_score(F.col("a"), F.col("b"), [([weights], [0.5])])
    return rounded(p.select("k", s.alias("score")), "score", digits=4)


@query
def content_hash(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["emotion_metrics"](spark, sf_dir)
