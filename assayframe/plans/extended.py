"""More queries of the catalogue: score selection, typed answers, request builders, checks, sources by round trip."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import assayframe
from assayframe.functions import expressions as X
from assayframe.functions import stats
from assayframe.operators import benchmarks as B
from assayframe.operators import judge as J
from assayframe.operators import manifests as M
from assayframe.operators import pairs as P
from assayframe.operators import predictions as Y
from assayframe.operators import requests as R
from assayframe.operators import rows, speech, vectors
from assayframe.operators import votes as V
from assayframe.plans import fixtures as fx
from assayframe.plans import vocabulary
from assayframe.plans.catalogue import query, rounded
from assayframe.operators.tables import saved, scratch, temporary
from assayframe.sources import answers, readers, writers

ASKED = ["Awe", "Hope"]


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# scores on one scale


@query
def score_selection(t):
    """The score field and scale of predictions that carry different fields."""
    p = fx.scored_predictions(t)
    return p.select("row_id", Y.scale_of(F.col("keys"), F.col("raw_score_scale"), "emotion").alias("suffix"), Y.selected_score(p, F.col("keys"), "emotion").alias("score"), Y.scale_of(F.col("keys"), F.col("raw_score_scale"), "mos").alias("mos_suffix"), Y.selected_score(p, F.col("keys"), "mos").alias("mos_score"))


@query
def score_selection_by_key(t):
    p = fx.scored_predictions(t)
    key = "raw_parsed_score_0_2"
    return p.select("row_id", Y.scale_of(F.col("keys"), F.col("raw_score_scale"), "emotion", key).alias("suffix"), Y.selected_score(p, F.col("keys"), "emotion", key).alias("score"), Y.scale_of(F.col("keys"), F.col("raw_score_scale"), "pair", "x_1_10").alias("pair_suffix"))


@query
def emotion_metrics_raw(t):
    """Predictions on 0-2, errors on 0-2."""
    p = B.valid(fx.emotion_predictions(t), "score").withColumn("score", F.floor(F.col("score") / 5).cast("double")).withColumn("suffix", F.lit("0_2"))
    return rounded(B.emotion_metrics(Y.one_scale(p), fx.votes(t), "raw_0_2"), "pearson", "spearman", "mae", "mse", "rmse", "accuracy_majority", "accuracy_rounded")


@query
def request_join_counts(t):
    """Parse counts with predictions whose request is missing."""
    p = t.orders.select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 11).cast("double").alias("score"), F.when(F.col("o_orderkey") % 50 == 0, F.lit("no number")).alias("raw_parse_error"))
    q = t.lineitem.groupBy(F.col("l_orderkey").alias("request_id")).agg(F.min("l_returnflag").alias("split"), F.min("l_linestatus").alias("prompt_mode"))
    rows_ = Y.with_requests(p, q, prompt_mode="F")
    return Y.parse_counts(rows_.withColumn("split", F.coalesce("split", F.lit("none"))), ["split"])


@query
def prediction_filters(t):
    p = t.lineitem.select(F.col("l_linestatus").alias("prompt_mode"), F.col("l_returnflag").alias("split"), F.when(F.col("l_linenumber") > 1, F.when(F.col("l_linenumber") % 2 == 0, "real").otherwise("synthetic")).alias("question_target"))
    return Y.filtered(p, "F", None, "synthetic").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query
def checked_manifest_join(t):
    """Each order's customer; a missing one would fail the query."""
    m = t.customer.select(F.col("c_custkey").alias("row_id"), "c_mktsegment")
    return B.checked_join(t.orders.select("o_orderkey", F.col("o_custkey").alias("row_id")), m).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


# typed answers


@query
def typed_predictions(t):
    """Answers of all modes, each parsed by its own."""
    return Y.typed(fx.typed_answers(t)).select(
        "request_id", "mode", "scale", "raw_parsed_score", "raw_parsed_emotion_score", "raw_parsed_opposite_score", F.element_at("raw_parsed_scores", F.lit("joy")).alias("joy"),
        F.array_join("raw_missing", ",").alias("missing"), F.array_join("raw_extra", ",").alias("extra"), "raw_structure_warning", "raw_parsed_choice", "is_correct", "raw_parse_error",
    )


@query
def parse_contrastive(t):
    s = X.contrastive_scores(F.col("raw"), 0, 10)
    raw = _text('{"emotion_score": ', F.floor("value") % 13, ', "opposite_score": ', F.when(F.col("event_id") % 3 == 0, "true").otherwise("4"), "}")
    return t.events.select("event_id", raw.alias("raw")).select("event_id", s.alias("s")).select("event_id", "s.*")


@query
def parse_features(t):
    raw = _text('{"observations": {"clear": "fine"}, "scores": {"clear": ', F.floor("value") % 13, ', "even": 3}, "overall_score": ', F.col("event_id") % 9, ', "overall_reason": "so"', F.when(F.col("event_id") % 2 == 0, ', "more": 1').otherwise(""), "}")
    s = X.feature_scores(F.col("raw"), ["clear", "even"], 0, 10)
    return t.events.select("event_id", raw.alias("raw")).select("event_id", s.alias("s")).select(
        "event_id", F.element_at("s.scores", F.lit("clear")).alias("clear"), "s.overall_score", F.array_join("s.missing", ",").alias("missing"), F.array_join("s.extra", ",").alias("extra"), "s.error", "s.warning",
    )


@query
def parse_probe(t):
    raw = F.when(F.col("event_id") % 3 == 0, _text('{"target_present": ', F.when(F.col("event_id") % 2 == 0, '"yes"').otherwise("false"), ', "transcript": "t"}')).when(F.col("event_id") % 3 == 1, _text("Target_before_repeat: no; target_after_repeat = ", F.when(F.col("event_id") % 2 == 0, "true").otherwise("maybe"))).otherwise("nothing")
    condition = F.when(F.col("event_id") % 3 == 0, "without_repeat").otherwise("with_repeat")
    s = X.probe(raw, condition)
    return t.events.select("event_id", s.alias("s")).select("event_id", "s.target_present", "s.target_before_repeat", "s.target_after_repeat", "s.transcript", "s.error")


@query
def parse_votes(t):
    """Votes out of their list text."""
    raw = _text("[{'a1': {'Awe': ", F.col("p_size") % 3, "}}, {'a2': {'Awe': ", F.col("p_partkey") % 3, "}}]")
    m = M.emotion_manifest(t.part.select(F.col("p_partkey").alias("row_id"), raw.alias("label")), vocabulary.ALIASES, vocabulary.OFFICIAL)
    return m.select("row_id", "target_label", "is_official_40", F.element_at("annotator_scores_raw_0_2", F.lit("a1")).alias("a1"), F.element_at("annotator_scores_0_10", F.lit("a2")).alias("a2"), "mean_score_0_10", "median_score_0_10")


@query
def transcript_fallback(t):
    keys = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("transcript"))).otherwise(F.array().cast("array<string>"))
    said = F.when(F.col("event_id") % 4 == 0, F.lit("said"))
    return t.events.select("event_id", Y.transcript_of(keys, said, F.col("event_type")).alias("transcript"))


@query
def asr_normalised(t):
    return speech.normalised(t.conversations.select("conv_id", "turn", "text"), "text", "normal").select("conv_id", "turn", "normal")


@query
def file_names(t):
    """Sizes, file names and padded numbers."""
    return t.part.select("p_partkey", X.human_bytes(F.col("p_partkey") * 7919).alias("size"), X.audio_name(F.col("p_partkey"), _text(F.col("p_type"), " / & x"), F.lit(".wav")).alias("audio"), X.output_name(F.col("p_partkey"), F.when(F.col("p_size") % 2 == 0, _text("..", F.col("p_name"), "!")).otherwise("??")).alias("output"))


# votes


@query
def loo_all_annotators(t):
    return rounded(stats.leave_one_out(fx.votes(t), "all_annotators"), "rest_mean")


@query
def rotation_report(t):
    return rounded(stats.rotations(fx.votes(t)), "pooled_majority", "pooled_rounded", "pooled_mae", "pooled_rmse", "row_majority", "row_rounded", "row_mae", "row_rmse")


@query
def rotation_report_all(t):
    return rounded(stats.rotations(fx.votes(t), "all_annotators"), "pooled_majority", "pooled_rounded", "pooled_mae", "pooled_rmse", "row_majority", "row_rounded", "row_mae", "row_rmse")


@query
def distribution_text(t):
    """Counts of scores as one line."""
    p = B.valid(fx.emotion_predictions(t), "score").withColumn("score", F.col("score") / 2)
    return writers.distribution(p.groupBy("score").agg(F.count(F.lit(1)).alias("n")), "score")


@query
def global_vote_mean(t):
    return rounded(writers.mean_score(fx.votes(t).select((F.col("score") * 5).alias("score"))), "mean")


@query
def official_labels(t):
    m = t.part.select("p_partkey", (F.col("p_size") % 2 == 0).alias("is_official_40"))
    return rows.union_all({"official40": B.of_label_set(m, "official40"), "all42": B.of_label_set(m, "all42")}).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# pairs


@query
def pair_score(t):
    cells = [(d, q) for d in ("real_a", "synthetic_a") for q in ("real", "synthetic")]
    return rounded(P.pair_score(P.complete_pairs(fx.cells(t), cells)), "pair_score")


@query
def scored_audio_pairs(t):
    """Real rows with both files; a missing file would fail the query."""
    wide = t.part.select(F.col("p_partkey").alias("pair_id"), _text("r", F.col("p_partkey")).alias("real_path"), _text("s", F.col("p_partkey")).alias("synthetic_path"))
    files = P.unpivot(wide).select(F.col("audio_path").alias("path"))
    return P.scored_pairs(B.require_audio(P.unpivot(wide), files).withColumn("split", F.lit("dev")), files)


@query
def zip_rows(t):
    a = t.customer.select("c_custkey")
    b = t.customer.select(F.col("c_custkey").alias("other"), F.col("c_acctbal"))
    return rows.zipped(a, b, ["c_custkey"], ["c_acctbal", "other"]).select("ordinal", "c_custkey", "other")


@query
def dense_ids_payload(t):
    """Row numbers of wide rows over a skewed order."""
    out = rows.dense_ids(t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"), ["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.count_distinct("row_id").alias("kinds"), F.sum("l_partkey").alias("parts"))


@query
def first_rows(t):
    """Heads of one order, before and after a condition, and text snippets."""
    e = fx.answers(t)
    a = rows.head(e, 7, ["event_id"]).select(F.lit("head").alias("what"), "event_id", F.lit(None).cast("string").alias("snippet"))
    b = rows.head_where(e, F.col("event_type") == "click", 5, ["event_id"]).select(F.lit("where").alias("what"), "event_id", F.lit(None).cast("string").alias("snippet"))
    c = rows.snippets(e, 4, ["event_id"], "raw", "event_id").select(F.lit("snippet").alias("what"), "event_id", "snippet")
    return a.unionByName(b).unionByName(c)


# requests


def _items(t):
    return t.part.select(F.col("p_partkey").alias("row_id"), _text("/items/", F.col("p_partkey")).alias("folder"), F.split("p_type", " ").alias("targets"), F.array(F.col("p_brand"), F.lit("again")).alias("separators"))


@query
def asr_requests_probe(t):
    return R.asr_requests(_items(t), "probe", vocabulary.ASR_PROMPTS, vocabulary.PROBE_FILES).select("request_id", "mode", "target_label", "audio_path", "prompt")


@query
def asr_requests_fewshot(t):
    out = R.asr_requests(_items(t), "transcription_fewshot", vocabulary.ASR_PROMPTS, vocabulary.PROBE_FILES, "/shot.wav")
    return out.select("request_id", F.array_join("audio_paths", ",").alias("audio_paths"), "prompt")


@query
def asr_prompts(t):
    """The prompt of every mode."""
    modes = [m for m in vocabulary.ASR_PROMPTS if m != "fewshot"]
    i = _items(t).withColumn("condition", F.lit("without_repeat"))
    one = lambda m: R.asr_prompt(m, vocabulary.ASR_PROMPTS, F.col("condition"), F.col("targets"), F.col("separators")).alias(m)
    return i.select("row_id", *[one(m) for m in modes])


def _clips(t):
    return P.unpivot(t.supplier.select(F.col("s_suppkey").alias("pair_id"), _text("r", F.col("s_suppkey")).alias("real_path"), _text("s", F.col("s_suppkey")).alias("synthetic_path"))).withColumn("split", F.lit("dev")).withColumn("text", _text("text ", F.col("pair_id")))


@query
def requests_single_clip(t):
    out = R.single_clip(_clips(t), "plain", {"prompt_template": "Rate {transcript}", "score_min": 1, "score_max": 10}, ["pair_id", "label"], root="/data")
    return out.select("request_id", "mode", "row_id", "audio_path", "prompt", F.col("raw_score_scale.max").alias("top"))


@query
def requests_features(t):
    out = R.single_clip(_clips(t), "quality_features_1_10", {"prompt_template": "Rate", "score_min": 1, "score_max": 10, "features": vocabulary.FEATURES}, ["pair_id", "label"])
    return out.select("request_id", "mode", "row_id", F.array_join("scored_features", ",").alias("features"))


@query
def requests_mos(t):
    m = t.part.select(F.col("p_partkey").alias("row_id"), _text(F.col("p_partkey"), ".wav").alias("audio_path"))
    return R.mos_requests(m, "plain", {"prompt_template": "Rate it", "score_min": 1, "score_max": 5}, "mos", "/data").select("request_id", "audio_path", "prompt", F.col("raw_score_scale.min").alias("low"))


@query
def requests_by_mode(t):
    """Modes and label sets dispatched: the manifest's own labels, and each row's own."""
    m = t.orders.select(F.col("o_orderkey").alias("row_id"), F.lit("a.wav").alias("audio_path"), F.col("o_orderpriority").alias("target_label"))
    config = {"one_by_one": {"prompt_template": "Score {emotion}", "score_min": 0, "score_max": 10}, "all_at_once": {"prompt_template": "All:\n{emotion_lines}", "score_min": 0, "score_max": 10}}
    own = R.build(m, "one_by_one", config, R.label_set("target", vocabulary.OFFICIAL, vocabulary.EXTRA)).select("request_id", "mode", "prompt")
    every = R.build(m, "all_at_once", config, R.label_set("manifest", vocabulary.OFFICIAL, vocabulary.EXTRA, m)).select("request_id", "mode", "prompt")
    return own.unionByName(every)


@query
def chat_prompts(t):
    marked = R.with_placeholders(F.when(F.col("p_size") % 2 == 0, F.lit("Say <|audio|> now")).otherwise("Rate it"), 2, "<|audio|>", ("<u>", "</u>"))
    return t.part.select("p_partkey", marked.alias("prompt"))


@query
def speech_jobs(t):
    r = t.part.select(F.col("p_name").alias("utterance_id"), F.col("p_type").alias("text"), *[_text(k, "/", F.col("p_partkey"), ".wav").alias(f"{k}_audio_path") for k in ("prompt", "real", "synthetic")], F.col("p_brand").alias("speaker_id"), F.lit("talk").alias("talk_id"), F.lit("dev").alias("split"))
    return R.speech_rows(r, "/data")


@query
def judged_repeats(t):
    """A stub judge's answers, parsed."""
    r = J.with_repeats(t.supplier.select(_text("s", X.zero_padded(F.col("s_suppkey"), 6)).alias("request_id"), F.lit("p").alias("prompt")), 2, 7)
    return J.parsed(J.run(r, J.StubJudge), 0, 10).select("request_id", "repeat_index", "raw_parsed_score", "raw_parse_error")


@query
def transcribed(t):
    return speech.transcripts(t.supplier.select(F.col("s_suppkey").alias("utterance_id"), F.col("s_name").alias("audio_path")), "stub")


# vectors


@query
def comet_features(t):
    p = fx.vector_pairs(t)
    f = vectors.comet_features(F.col("a"), F.col("b"), F.reverse("a"))
    return rounded(p.select("k", F.aggregate(f, F.lit(0.0), lambda s, x: s + x).alias("total"), F.size(f).cast("long").alias("dims")), "total", digits=4)


@query
def attention_pooling(t):
    e = t.embeddings.select(F.col("label").alias("id"), F.col("vec_id").alias("t"), F.col("embedding").alias("vector"), (F.col("vec_id") % 3 != 0).alias("mask"))
    pooled = vectors.attention_pool(e, [0.5] * 8 + [0.0] * 56)
    return rounded(pooled.select("id", F.posexplode("vector").alias("dim", "x")).select("id", F.col("dim").cast("long").alias("dim"), "x"), "x", digits=5)


@query
def two_layer_head(t):
    e = t.embeddings
    layers = [([[((i * 7 + j) % 5 - 2) / 4 for i in range(64)] for j in range(3)], [0.1, 0.0, -0.1]), ([[1.0, -0.5, 0.25]], [0.2])]
    return rounded(e.select("vec_id", F.get(vectors.mlp(F.col("embedding"), layers), F.lit(0)).alias("tanh"), F.get(vectors.mlp(F.col("embedding"), layers, "relu", True), F.lit(0)).alias("relu")), "tanh", "relu", digits=4)


# sources and sinks by round trip


@query
def read_json_lines(t):
    place = fx.place(t)
    writers.json_lines(t.supplier.select(F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("name")), place)
    return readers.json_lines(t.spark, place, "name string, row_id long")


@query
def read_json_heads(t):
    """Raw-line and row limits over a file with blank lines."""
    place = fx.place(t)
    line = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(_text('{"row_id": ', F.col("s_suppkey"), "}"))
    t.supplier.orderBy("s_suppkey").coalesce(1).select(line.alias("value")).write.text(place)
    raw = rows.json_head(t.spark, place, "row_id long", raw=10).withColumn("what", F.lit("raw"))
    parsed = rows.json_head(t.spark, place, "row_id long", parsed=10).withColumn("what", F.lit("parsed"))
    return raw.unionByName(parsed).unionByName(rows.json_head(t.spark, place, "row_id long", parsed=0).withColumn("what", F.lit("zero")))


@query
def read_key_values(t):
    place = fx.place(t)
    writers.delimited(t.supplier.select(F.col("s_name").alias("systemId"), F.col("s_acctbal").alias("mean")), place, ["systemId", "mean"])
    return readers.key_value(t.spark, place, "systemId")


@query
def read_listeners(t):
    place = fx.place(t)
    heard = t.part.select(F.col("p_name").alias("utteranceId"), F.when(F.col("p_size") % 5 == 0, "x").otherwise((F.col("p_size") % 5).cast("string")).alias("choice"), (F.col("p_size") % 2).cast("string").alias("clean"))
    writers.delimited(heard, place, ["utteranceId", "choice", "clean"], sep="\t")
    return readers.listener_tsv(t.spark, place, clean_only=True)


@query
def read_listener_lists(t):
    place = fx.place(t)
    line = F.when(F.col("p_size") % 7 == 0, "alone").otherwise(_text("s,", F.col("p_partkey"), ",", F.when(F.col("p_size") % 5 == 0, "bad").otherwise((F.col("p_size") % 5).cast("string"))))
    t.part.select(line.alias("value")).write.text(place)
    return readers.listener_csv(t.spark, place)


@query
def read_mos_lists(t):
    a, b = fx.place(t), fx.place(t)
    m = t.part.select(F.col("p_partkey").cast("string").alias("name"), F.col("p_size").alias("mos"))
    writers.delimited(m, a, ["name", "mos"])
    m.select(F.concat_ws(",", "name", "mos").alias("value")).write.text(b)
    lists = [readers.mos_list(t.spark, a, True, "train"), readers.mos_list(t.spark, b, False, "dev"), readers.mos_list(t.spark, b, False, "unlabeled")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("mos").alias("total"))


@query
def read_utterances(t):
    """STM lines: gaps and empty intervals go, ids carry the interval."""
    place = fx.place(t)
    kind = F.col("s_suppkey") % 5
    line = F.when(kind == 0, _text("talk 1 inter_segment_gap 1 2 <o> ignore_time_segment_in_scoring")).when(kind == 1, _text("t", F.col("s_suppkey"), " 1 spk 5 5 <o> nothing")).otherwise(_text("t", F.col("s_suppkey"), " 1 spk 0.5 ", F.col("s_suppkey") + 1, " <o,f0>  it 's  said"))
    t.supplier.select(line.alias("value")).write.text(place)
    return readers.utterance_lines(t.spark, place).select("talk_id", "duration_s", "text", "utterance_id")


@query
def read_pair_lists(t):
    place = fx.place(t)
    wide = t.supplier.select(F.col("s_suppkey").alias("pair_id"), F.lit("dev").alias("split"), _text("r", F.col("s_suppkey")).alias("src_audio"), _text("s", F.col("s_suppkey")).alias("tgt_audio"))
    writers.delimited(wide, place, ["pair_id", "split", "src_audio", "tgt_audio"], sep="\t")
    return readers.pair_tsv(t.spark, place).select("pair_id", "split", "src_audio", "tgt_audio")


@query
def read_folders(t):
    """Numbered folders with a text file each, written by a partitioned sink."""
    place = fx.place(t)
    body = _text("full: whole text ", F.col("n_nationkey"), "\ntarget: ", F.col("n_name"), " | other\nseparators: again, ", F.col("n_name"))
    fx.write_folders(t.nation.select(F.col("n_nationkey").cast("string").alias("name"), body.alias("text")), place)
    return readers.probe_items(t.spark, place).select("row_id", "full_text", F.array_join("targets", "|").alias("targets"), F.array_join("separators", "|").alias("separators"))


@query
def read_audio_index(t):
    """Files found by name or stem, with their sizes."""
    place = fx.place(t)
    samples = t.nation.select(_text(F.col("n_regionkey"), "/n", F.col("n_nationkey"), ".wav").alias("name"), _text("RIFF", F.col("n_name")).cast("binary").alias("content"))
    made = writers.audio_files(samples, place.removeprefix("file://"))
    made.write.format("noop").mode("overwrite").save()
    index = readers.audio_index(t.spark, place)
    wanted = t.nation.select("n_nationkey", _text("n", F.col("n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, ".wav").otherwise(".flac")).alias("wav_name"))
    found = B.with_audio(wanted, index).withColumn("path", F.element_at(F.split("audio_path", "/"), -1))
    facts = readers.with_file_facts(found, readers.content_hashes(t.spark, place))
    return facts.select("n_nationkey", "path", "audio_exists", "audio_num_bytes", "audio_sha256")


@query
def split_outputs(t):
    """One folder a split and one of all."""
    place = fx.place(t)
    writers.by_split(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("split")), place)
    both = [writers.read_split(t.spark, place, k).agg(F.lit(k).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")) for k in ("all", "F")]
    return both[0].unionByName(both[1])


@query
def score_file(t):
    """Scores as lines of eight decimals, in order."""
    place = fx.place(t)
    writers.score_lines(t.supplier.select("s_suppkey", F.col("s_acctbal").alias("score")), place, "score", "s_suppkey")
    return t.spark.read.text(place).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query
def published_manifest(t):
    place = fx.place(t)
    writers.publish(t.nation.select(F.col("n_nationkey").alias("row_id"), F.col("n_name").alias("name")), place)
    return readers.json_lines(t.spark, place, "name string, row_id long")


@query
def audio_extensions(t):
    path = F.when(F.col("n_nationkey") % 3 == 0, "x.FLAC").otherwise("x")
    content = F.when(F.col("n_nationkey") % 2 == 0, F.lit("RIFF1").cast("binary")).otherwise(F.lit("ID3a").cast("binary"))
    return t.nation.select("n_nationkey", readers.audio_extension(path, content).alias("extension"))


@query
def ordered_labels(t):
    """Rows in the orders that reports use."""
    return V.long_votes(t.part.select(F.col("p_partkey").alias("row_id"), F.create_map(F.lit("a1"), F.col("p_size") % 3, F.lit("a2"), (F.col("p_partkey") % 3).cast("int")).alias("votes")), "votes").orderBy("row_id", "annotator")


# answers of models, logged one by one


class Recorded:
    """A judge whose answers stand in the requests' own rows."""

    def answer(self, batch):
        return list(batch["raw"])


@query
def answer_log(t):
    """Every answer twice, logged in two runs of which the second goes on behind the first."""
    spark = t.events.sparkSession
    asked = fx.answers(t).select(F.col("event_id").cast("string").alias("request_id"), "raw")
    asked = asked.withColumn("repeat_index", F.explode(F.array(F.lit(0), F.lit(1))))
    with temporary(spark) as keep:
        folder = scratch(spark)
        answers.append(asked.where("raw LIKE 'Score%'"), Recorded, folder, together=100)
        answers.append(asked, Recorded, folder, together=100)
        return keep(saved(answers.read(spark, folder)))


# settings, refusals, reports, the scorer's class


@query
def read_values_by_sample(t):
    """A lookup with another key column."""
    place = fx.place(t)
    writers.delimited(t.customer.select(F.col("c_name").alias("sampleId"), F.col("c_acctbal").alias("mean")), place, ["sampleId", "mean"])
    return readers.key_value(t.spark, place, "sampleId")


@query
def read_under_configured_root(t):
    """A lookup below the root that a configuration names."""
    root = fx.place(t)
    writers.delimited(t.part.select(F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("mean")), f"{root}/values", ["name", "mean"])
    writers.json_lines(t.spark.range(1).select(F.lit(root).alias("data_root")), f"{root}/config", files=1)
    config = readers.load_config(f"{root}/config", t.spark)
    return readers.key_value(t.spark, f"{readers.resolve_root(None, 'ASSAYFRAME_ROOT_THAT_NOBODY_SETS', config)}/values", "name")


@query
def refused_overwrite(t):
    """What stands in a place after a write that was refused, and after one that was allowed."""
    place = fx.place(t)
    first, second = (t.nation.select(F.col("n_name").alias("name"), F.lit(n).alias("n")) for n in (1, 2))
    writers.delimited(first, place, ["name", "n"])
    try:
        writers.delimited(second, place, ["name", "n"])
        refused = False
    except AnalysisException as e:
        refused = e.getCondition() == "PATH_ALREADY_EXISTS"
    kept = saved(t.spark.read.option("header", True).csv(place).withColumn("write", F.lit("refused" if refused else "not refused")))
    writers.delimited(second, place, ["name", "n"], overwrite=True)
    return kept.unionByName(t.spark.read.option("header", True).csv(place).withColumn("write", F.lit("allowed")))


@query
def dataset_metadata(t):
    """Counts per value of two columns, out of the JSON text."""
    text = writers.metadata(t.orders, ["o_orderpriority", "o_orderstatus"])
    row = t.spark.range(1).select(F.from_json(F.lit(text), "rows long, o_orderpriority map<string,long>, o_orderstatus map<string,long>").alias("m")).select("m.*")
    each = [row.select(F.lit(c).alias("column"), F.explode(c).alias("value", "n")) for c in ("o_orderpriority", "o_orderstatus")]
    return each[0].unionByName(each[1]).unionByName(row.select(F.lit("rows").alias("column"), F.lit("all").alias("value"), F.col("rows").alias("n")))


@query
def metric_report(t):
    """Metrics as the lines of a report."""
    m = t.lineitem.agg(F.count(F.lit(1)).alias("rows"), F.avg("l_quantity").alias("mean"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"), F.max("l_discount").cast("double").alias("top"), F.lit(float("nan")).alias("none"))
    text = writers.report(m, {"returned": "%.1%", "top": "%g"})
    return t.spark.range(1).select(F.posexplode(F.split(F.lit(text), "\n")).alias("place", "line"))


class Given:
    """An encoder of sources that are vectors already."""

    def encode(self, sources):
        return np.array([np.asarray(s, dtype=np.float64) for s in sources])


@query
def pair_scorer(t):
    """Scores of pairs by the library's exported class: batches, first output, both directions."""
    weights = [((i * 37) % 11 - 5) / 10 for i in range(256)]
    scorer = assayframe.AutoPCP(Given, [([weights, weights[::-1]], [0.5, 0.0])], batch=16)
    return rounded(scorer.score(fx.vector_pairs(t), key="k", source="a", target="b"), "score", digits=4)
