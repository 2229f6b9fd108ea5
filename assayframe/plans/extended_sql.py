"""SQL of the extended catalogue, for DuckDB over the same tables."""

from __future__ import annotations

from assayframe.plans import oracle, vocabulary
from assayframe.plans.oracle import CELLS, MAJ, PAIRS, PRED, VOTES, _block, _q

V13 = "CAST(floor(value) AS BIGINT) % 13"
SCORED = """k AS (SELECT o_orderkey AS row_id, o_orderkey % 6 AS k, CAST(o_custkey % 11 AS DOUBLE) AS v, o_orderkey % 4 = 0 AS scaled, o_orderkey % 7 <> 0 AS there FROM orders),
sp AS (SELECT *, k = 0 AS h0, k IN (0, 1) AS h1, k IN (1, 2) AS h2, k IN (2, 3) AS h3, k IN (3, 4) AS h4 FROM k)"""
_own = lambda h, i: f"WHEN {h} THEN CASE WHEN there THEN v + {i} END"
_plain = "CASE WHEN h4 AND there THEN v + 4 END"


def _without(text: str) -> str:
    return text.replace("{{", "{").replace("}}", "}")


def _prompt(mode: str, condition: str = "") -> str:
    text = vocabulary.ASR_PROMPTS[mode]
    text = _q(_without(text if isinstance(text, str) else text[condition]))
    text = text.replace("\n", "' || chr(10) || '").replace("{fewshot}", _q(vocabulary.ASR_PROMPTS["fewshot"]))
    return "('" + text.replace("{targets}", "' || replace(p_type, ' ', ' | ') || '").replace("{separators}", "' || p_brand || ' | again' || '") + "')"


ROT = """held AS (SELECT row_id, annotator, score, rest_mean, rest_majority FROM ({src})),
h AS (SELECT row_id, abs(score - rest_mean) * 5 AS mae, ((score - rest_mean) * 5) ** 2 AS mse, CASE WHEN score = rest_majority THEN 1.0 ELSE 0.0 END AS majority, CASE WHEN score = round_even(rest_mean, 0) THEN 1.0 ELSE 0.0 END AS rounded FROM held),
r AS (SELECT row_id, count(*) AS k, avg(mae) AS mae, avg(mse) AS mse, avg(majority) AS majority, avg(rounded) AS rounded FROM h GROUP BY row_id)
SELECT (SELECT count(*) FROM r) AS rows, count(*) AS votes, round(avg(majority), 6) AS pooled_majority, round(avg(rounded), 6) AS pooled_rounded, round(avg(mae), 6) AS pooled_mae, round(sqrt(avg(mse)), 6) AS pooled_rmse,
(SELECT round(avg(majority), 6) FROM r) AS row_majority, (SELECT round(avg(rounded), 6) FROM r) AS row_rounded, (SELECT round(avg(mae), 6) FROM r) AS row_mae, (SELECT round(sqrt(avg(mse)), 6) FROM r) AS row_rmse FROM h"""
_loo = """SELECT h.row_id, h.annotator, h.score, h.rest_mean, c.s AS rest_majority FROM (SELECT *, CAST(sum(score) OVER w - score AS DOUBLE) / (count(*) OVER w - 1) AS rest_mean FROM votes WINDOW w AS (PARTITION BY row_id) QUALIFY count(*) OVER w >= 2) h,
LATERAL (SELECT v.score AS s FROM votes v WHERE v.row_id = h.row_id AND v.annotator <> h.annotator GROUP BY v.score ORDER BY count(*) DESC, abs(v.score - h.rest_mean), v.score LIMIT 1) c"""
_all = """SELECT v.row_id, annotator, score, mean AS rest_mean, majority AS rest_majority FROM votes v JOIN maj USING (row_id) WHERE row_id IN (SELECT row_id FROM votes GROUP BY row_id HAVING count(*) >= 2)"""
CLIPS = """cl AS (SELECT s_suppkey AS pair_id, label, CASE WHEN label = 'real' THEN 'r' ELSE 's' END || s_suppkey AS audio_path, row_number() OVER (ORDER BY s_suppkey, label) - 1 AS row_id
  FROM supplier CROSS JOIN (SELECT unnest(['real', 'synthetic']) AS label))"""
_p = "(SELECT event_id, event_type, CAST(floor(value) AS BIGINT) AS f FROM events)"

ORACLES = {
    "read_values_by_sample": 'SELECT c_name AS "sampleId", CAST(c_acctbal AS DOUBLE) AS mean FROM customer',
    "read_under_configured_root": "SELECT CAST(p_partkey AS VARCHAR) AS name, CAST(p_retailprice AS DOUBLE) AS mean FROM part",
    "refused_overwrite": "SELECT n_name AS name, CAST(n AS VARCHAR) AS n, w AS write FROM nation CROSS JOIN (VALUES (1, 'refused'), (2, 'allowed')) AS t(n, w)",
    "dataset_metadata": """SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2
      UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'rows', 'all', count(*) FROM orders""",
    "metric_report": """SELECT CAST(place AS INT) AS place, line FROM (SELECT unnest(range(0, 5)) AS place, unnest(['rows: ' || count(*), format('mean: {:.3f}', avg(CAST(l_quantity AS DOUBLE))),
      format('returned: {:.1f}%', 100 * avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END)), format('top: {:g}', max(CAST(l_discount AS DOUBLE))), 'none: nan']) AS line FROM lineitem)""",
    "pair_scorer": oracle.ORACLES["autopcp_linear_head"],
    "answer_log": f"""WITH {oracle.ANSWERS} SELECT CAST(event_id AS VARCHAR) AS request_id, CAST(r AS INT) AS repeat_index, raw AS raw_response_text FROM ans, unnest(range(0, 2)) AS t(r)""",
    "score_selection": f"""WITH {SCORED} SELECT row_id, CASE WHEN scaled THEN '1_10' WHEN h0 THEN '0_10' ELSE '0_2' END AS suffix,
      CASE {_own('h0', 0)} {_own('h1', 1)} ELSE {_plain} END AS score,
      CASE WHEN scaled THEN '1_10' WHEN h2 THEN '1_5' WHEN h3 THEN '1_10' WHEN h0 THEN '0_10' ELSE '1_5' END AS mos_suffix, CASE {_own('h2', 2)} {_own('h0', 0)} {_own('h3', 3)} ELSE {_plain} END AS mos_score FROM sp""",
    "score_selection_by_key": "SELECT o_orderkey AS row_id, '0_2' AS suffix, CAST(NULL AS DOUBLE) AS score, '1_10' AS pair_suffix FROM orders",
    "emotion_metrics_raw": f"""WITH {VOTES}, {PRED}, {MAJ}, j AS (SELECT floor(p.score / 5) * 5 AS m10, m.mean * 5 AS h10, floor(p.score / 5) AS score, m.majority, m.mean FROM pred p JOIN maj m USING (row_id) WHERE err IS NULL),
      b AS ({_block('j', 'm10', 'h10')})
      SELECT n, pearson, spearman, (SELECT round(avg(abs(score - mean)), 6) FROM j) AS mae, (SELECT round(avg((score - mean) ** 2), 6) FROM j) AS mse, (SELECT round(sqrt(avg((score - mean) ** 2)), 6) FROM j) AS rmse,
      (SELECT round(avg(CASE WHEN score = majority THEN 1.0 ELSE 0.0 END), 6) FROM j) AS accuracy_majority, (SELECT round(avg(CASE WHEN score = round_even(mean, 0) THEN 1.0 ELSE 0.0 END), 6) FROM j) AS accuracy_rounded FROM b""",
    "request_join_counts": """WITH q AS (SELECT l_orderkey AS k, min(l_returnflag) AS split, min(l_linestatus) AS mode FROM lineitem GROUP BY l_orderkey),
      x AS (SELECT coalesce(q.split, 'none') AS split, q.k IS NOT NULL AND o_orderkey % 50 <> 0 AS parsed FROM orders LEFT JOIN q ON q.k = o_orderkey WHERE q.k IS NULL OR q.mode = 'F')
      SELECT split, count(*) AS considered, count(*) FILTER (parsed) AS parsed, count(*) FILTER (NOT parsed) AS parse_failures FROM x GROUP BY split""",
    "prediction_filters": "SELECT l_returnflag AS split, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber % 2 = 1 GROUP BY l_returnflag",
    "checked_manifest_join": "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "typed_predictions": """WITH e AS (SELECT event_id AS request_id, event_id % 6 AS k, CAST(floor(value) AS BIGINT) % 14 AS v, event_type, CASE WHEN event_id % 4 = 0 THEN 'A' ELSE 'B' END AS truth FROM events),
      x AS (SELECT *, CASE WHEN v <= 10 THEN CAST(v AS DOUBLE) END AS s FROM e)
      SELECT request_id, ['one_by_one', 'one_by_one_paper_0_10_thinking', 'one_by_one_contrastive_rubric', 'quality_features_1_10', 'pairwise_real_vs_synthetic', 'all_at_once'][k + 1] AS mode,
      CASE WHEN k <> 4 THEN '0_10' END AS scale, CASE k WHEN 0 THEN s WHEN 1 THEN coalesce(s, 3) WHEN 3 THEN 5 END AS raw_parsed_score, CASE WHEN k = 2 THEN s END AS raw_parsed_emotion_score, CASE WHEN k = 2 THEN CAST(2 AS DOUBLE) END AS raw_parsed_opposite_score,
      CASE WHEN k IN (3, 5) THEN s END AS joy, CASE WHEN k IN (3, 5) THEN CASE WHEN s IS NULL THEN 'joy' ELSE '' END END AS missing, CASE k WHEN 3 THEN '' WHEN 5 THEN 'awe' END AS extra,
      CAST(NULL AS VARCHAR) AS raw_structure_warning, CASE WHEN k = 4 AND event_type <> 'click' THEN 'A' END AS raw_parsed_choice, CASE WHEN k = 4 AND event_type <> 'click' THEN truth = 'A' END AS is_correct,
      CASE WHEN k = 0 AND s IS NULL THEN 'no numeric score within scale' WHEN k = 2 AND s IS NULL THEN 'JSON did not contain numeric emotion_score and opposite_score within scale'
        WHEN k = 3 AND s IS NULL THEN 'JSON did not contain every expected numeric score within scale' WHEN k = 4 AND event_type = 'click' THEN 'no A/B choice parsed'
        WHEN k = 5 THEN 'JSON scores did not exactly match expected emotions and numeric scale' END AS raw_parse_error FROM x""",
    "parse_contrastive": f"""WITH x AS (SELECT event_id, CASE WHEN {V13} <= 10 THEN CAST({V13} AS DOUBLE) END AS a, CASE WHEN event_id % 3 <> 0 THEN CAST(4 AS DOUBLE) END AS b FROM events)
      SELECT event_id, a AS emotion_score, b AS opposite_score, CASE WHEN a IS NULL OR b IS NULL THEN 'JSON did not contain numeric emotion_score and opposite_score within scale' END AS error FROM x""",
    "parse_features": f"""WITH x AS (SELECT event_id, CASE WHEN {V13} <= 10 THEN CAST({V13} AS DOUBLE) END AS c FROM events)
      SELECT event_id, c AS clear, CAST(event_id % 9 AS DOUBLE) AS overall_score, CASE WHEN c IS NULL THEN 'clear,observations.even' ELSE 'observations.even' END AS missing, CASE WHEN event_id % 2 = 0 THEN 'more' ELSE '' END AS extra,
      CASE WHEN c IS NULL THEN 'JSON did not contain every expected numeric score within scale' END AS error, 'JSON evidence fields did not exactly match the requested structure' AS warning FROM x""",
    "parse_probe": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 END AS target_present, CASE WHEN event_id % 3 = 1 THEN false END AS target_before_repeat, CASE WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN true END AS target_after_repeat,
      CASE WHEN event_id % 3 = 0 THEN 't' END AS transcript, CASE WHEN event_id % 3 = 2 OR event_id % 3 = 1 AND event_id % 2 = 1 THEN 'response did not contain a JSON object' END AS error FROM events""",
    "parse_votes": """SELECT p_partkey AS row_id, 'Awe' AS target_label, true AS is_official_40, CAST(p_size % 3 AS INT) AS a1, CAST(p_partkey % 3 * 5 AS INT) AS a2, CAST((p_size % 3 + p_partkey % 3) * 2.5 AS DOUBLE) AS mean_score_0_10, CAST((p_size % 3 + p_partkey % 3) * 2.5 AS DOUBLE) AS median_score_0_10 FROM part""",
    "transcript_fallback": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'said' ELSE event_type END AS transcript FROM events",
    "asr_normalised": "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS normal FROM conversations",
    "file_names": """SELECT p_partkey, CASE WHEN p_partkey * 7919 >= 1073741824 THEN format('{:.1f} GiB', p_partkey * 7919 / 1073741824) WHEN p_partkey * 7919 >= 1048576 THEN format('{:.1f} MiB', p_partkey * 7919 / 1048576) WHEN p_partkey * 7919 >= 1024 THEN format('{:.1f} KiB', p_partkey * 7919 / 1024) ELSE p_partkey * 7919 || ' B' END AS size,
      lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(6, length(CAST(p_partkey AS VARCHAR))) AS INT), '0') || '_' || replace(lower(p_type), ' ', '-') || '-and-x.wav' AS audio,
      lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(4, length(CAST(p_partkey AS VARCHAR))) AS INT), '0') || '_' || CASE WHEN p_size % 2 = 0 THEN regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g') ELSE 'item_' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(4, length(CAST(p_partkey AS VARCHAR))) AS INT), '0') END || '.wav' AS output FROM part""",
    "loo_all_annotators": f"WITH {VOTES}, {MAJ} SELECT row_id, annotator, score, round(rest_mean, 6) AS rest_mean, rest_majority FROM ({_all})",
    "rotation_report": f"WITH {VOTES}, " + ROT.format(src=_loo),
    "rotation_report_all": f"WITH {VOTES}, {MAJ}, " + ROT.format(src=_all),
    "distribution_text": f"""WITH {PRED}, c AS (SELECT score / 2 AS s, count(*) AS n FROM pred WHERE err IS NULL GROUP BY 1)
      SELECT string_agg(CASE WHEN s = floor(s) THEN CAST(CAST(s AS BIGINT) AS VARCHAR) ELSE CAST(s AS VARCHAR) END || '=' || n, ', ' ORDER BY s) AS text FROM c""",
    "global_vote_mean": f"WITH {VOTES} SELECT count(*) AS rows, round(avg(score * 5), 6) AS mean FROM votes",
    "official_labels": "SELECT 'official40' AS split, count(*) AS n FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'all42', count(*) FROM part",
    "pair_score": f"""WITH {CELLS}, p AS (SELECT pair_id, count(*) FILTER (choice = correct) AS c FROM cells WHERE choice IS NOT NULL GROUP BY pair_id HAVING count(*) = 4) SELECT count(*) AS complete_pairs, round(avg(c / 4), 6) AS pair_score FROM p""",
    "scored_audio_pairs": "SELECT p_partkey AS pair_id, 'dev' AS split, 'r' || p_partkey AS src_audio, 's' || p_partkey AS tgt_audio FROM part",
    "zip_rows": "SELECT ordinal, c_custkey, other FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal FROM customer) JOIN (SELECT c_custkey AS other, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS ordinal FROM customer) USING (ordinal)",
    "dense_ids_payload": """WITH c AS (SELECT l_returnflag, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY l_returnflag)
      SELECT l_returnflag, n, CAST(sum(n) OVER (ORDER BY l_returnflag) - n AS BIGINT) AS "first", CAST(sum(n) OVER (ORDER BY l_returnflag) - 1 AS BIGINT) AS "last", n AS kinds, parts FROM c""",
    "first_rows": f"""WITH {oracle.ANSWERS} SELECT * FROM (SELECT 'head' AS what, event_id, CAST(NULL AS VARCHAR) AS snippet FROM ans ORDER BY event_id LIMIT 7) UNION ALL SELECT * FROM (SELECT 'where', event_id, NULL FROM ans WHERE event_type = 'click' ORDER BY event_id LIMIT 5)
      UNION ALL SELECT * FROM (SELECT 'snippet', event_id, replace(raw, chr(10), '\\n') FROM ans ORDER BY event_id LIMIT 4)""",
    "asr_requests_probe": f"""SELECT 'in_context_asr__row-' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(3, length(CAST(p_partkey AS VARCHAR))) AS INT), '0') || '__' || c AS request_id, 'in_context_asr_probe' AS mode, string_split(p_type, ' ')[1] AS target_label,
      '/items/' || p_partkey || '/sentence_' || c || '.wav' AS audio_path, CASE c WHEN 'without_repeat' THEN {_prompt('probe', 'without_repeat')} ELSE {_prompt('probe', 'with_repeat')} END AS prompt FROM part CROSS JOIN (SELECT unnest(['without_repeat', 'with_repeat']) AS c)""",
    "asr_requests_fewshot": f"""SELECT 'in_context_asr__row-' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(3, length(CAST(p_partkey AS VARCHAR))) AS INT), '0') || '__' || c AS request_id,
      '/shot.wav,/items/' || p_partkey || '/sentence_' || c || '.wav' AS audio_paths, {_prompt('transcription_fewshot')} AS prompt FROM part CROSS JOIN (SELECT unnest(['without_repeat', 'with_repeat']) AS c)""",
    "asr_prompts": "SELECT p_partkey AS row_id, " + ", ".join(f"{_prompt(m, 'without_repeat')} AS {m}" for m in vocabulary.ASR_PROMPTS if m != "fewshot") + " FROM part",
    "requests_single_clip": f"""WITH {CLIPS} SELECT 'clips__dev__plain__row-' || lpad(CAST(row_id AS VARCHAR), CAST(greatest(6, length(CAST(row_id AS VARCHAR))) AS INT), '0') || '__' || label AS request_id, 'one_by_one' AS mode, row_id, '/data/' || audio_path AS audio_path, 'Rate text ' || pair_id AS prompt, 10 AS top FROM cl""",
    "requests_features": f"""WITH {CLIPS} SELECT 'clips__dev__quality_features_1_10__row-' || lpad(CAST(row_id AS VARCHAR), CAST(greatest(6, length(CAST(row_id AS VARCHAR))) AS INT), '0') || '__' || label AS request_id, 'quality_features_1_10' AS mode, row_id, '{",".join(vocabulary.FEATURES)}' AS features FROM cl""",
    "requests_mos": "SELECT 'mos__plain__row-' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(6, length(CAST(p_partkey AS VARCHAR))) AS INT), '0') AS request_id, '/data/' || p_partkey || '.wav' AS audio_path, 'Rate it' AS prompt, 1 AS low FROM part",
    "requests_by_mode": """WITH o AS (SELECT 'row-' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR))) AS INT), '0') AS id, o_orderpriority AS p FROM orders)
      SELECT id || '__emotion-' || regexp_replace(replace(lower(p), '/', '-'), '\\s+', '-', 'g') AS request_id, 'one_by_one' AS mode, 'Score ' || p AS prompt FROM o
      UNION ALL SELECT id || '__all-emotions', 'all_at_once', 'All:' || (SELECT string_agg(chr(10) || '- ' || p, '' ORDER BY p) FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)) FROM o""",
    "chat_prompts": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '<u>Say <|audio|> now</u>' ELSE '<u><|audio|>' || chr(10) || '<|audio|>' || chr(10) || 'Rate it</u>' END AS prompt FROM part",
    "speech_jobs": "SELECT p_name AS id, p_type AS text, '/data/prompt/' || p_partkey || '.wav' AS prompt_wav, '/data/real/' || p_partkey || '.wav' AS real_wav, '/data/synthetic/' || p_partkey || '.wav' AS synthetic_wav, p_brand AS speaker, 'talk' AS talk_id, 'dev' AS split FROM part",
    "judged_repeats": """WITH r AS (SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(s_suppkey AS VARCHAR))) AS INT), '0') AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier),
      x AS (SELECT id, r, CAST(('0x' || substr(md5(id || ':' || (7 + i * 2 + r)), 1, 8)) AS BIGINT) AS n FROM r CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INT) AS r))
      SELECT id AS request_id, r AS repeat_index, CASE WHEN n % 4 < 3 THEN CAST(n % 11 AS DOUBLE) END AS raw_parsed_score, CASE WHEN n % 4 = 3 THEN 'response did not contain a numeric score within scale' END AS raw_parse_error FROM x""",
    "transcribed": "SELECT s_suppkey AS utterance_id, 'transcript of ' || s_name AS transcript FROM supplier",
    "comet_features": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.vec_id // 2 AS k, a.v AS s, b.v AS m, list_reverse(a.v) AS r FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)
      SELECT k, round(list_sum(r) + list_sum(m) + list_dot_product(s, m) + list_dot_product(r, m) + list_sum(list_transform(list_zip(s, m), lambda z: abs(z[2] - z[1]))) + list_sum(list_transform(list_zip(r, m), lambda z: abs(z[2] - z[1]))), 4) AS total, CAST(6 * len(s) AS BIGINT) AS dims FROM p""",
    "attention_pooling": """WITH e AS (SELECT label AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 3 <> 0), s AS (SELECT id, v, exp(list_sum(v[1:8]) * 0.5) AS w FROM e),
      c AS (SELECT id, w, unnest(v) AS x, unnest(range(len(v))) AS dim FROM s) SELECT id, dim, round(sum(x * w) / sum(w), 5) AS x FROM c GROUP BY id, dim""",
    "two_layer_head": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), h AS (SELECT vec_id, "
    + ", ".join(f"list_dot_product(v, list_transform(range(64), lambda i: ((i * 7 + {j}) % 5 - 2) / 4)) + {b} AS h{j}" for j, b in enumerate((0.1, 0.0, -0.1)))
    + " FROM e) SELECT vec_id, round(tanh(h0) - 0.5 * tanh(h1) + 0.25 * tanh(h2) + 0.2, 4) AS tanh, round(tanh(greatest(h0, 0) - 0.5 * greatest(h1, 0) + 0.25 * greatest(h2, 0) + 0.2), 4) AS relu FROM h",
    "read_json_lines": "SELECT s_name AS name, s_suppkey AS row_id FROM supplier",
    "read_json_heads": """WITH l AS (SELECT s_suppkey AS row_id, row_number() OVER (ORDER BY s_suppkey) AS i, s_suppkey % 4 <> 0 AS there FROM supplier), p AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS k FROM l WHERE there)
      SELECT row_id, 'raw' AS what FROM l WHERE i <= 10 AND there UNION ALL SELECT row_id, 'parsed' FROM p WHERE k <= 10 UNION ALL SELECT row_id, 'zero' FROM p WHERE k = 1""",
    "read_key_values": 'SELECT s_name AS "systemId", s_acctbal AS mean FROM supplier',
    "read_listeners": 'SELECT p_name AS "utteranceId", CAST(p_size % 5 AS INT) AS score FROM part WHERE p_size % 2 = 1 AND p_size % 5 <> 0',
    "read_listener_lists": "SELECT CAST(p_partkey AS VARCHAR) AS file, CAST(p_size % 5 AS INT) AS score FROM part WHERE p_size % 7 <> 0 AND p_size % 5 <> 0",
    "read_mos_lists": "SELECT s AS split, count(*) AS n, CASE WHEN s <> 'unlabeled' THEN CAST(sum(p_size) AS DOUBLE) END AS total FROM part CROSS JOIN (SELECT unnest(['train', 'dev', 'unlabeled']) AS s) GROUP BY s",
    "read_utterances": "SELECT 't' || s_suppkey AS talk_id, CAST(s_suppkey + 0.5 AS DOUBLE) AS duration_s, 'it''s said' AS text, 't' || s_suppkey || '__spk__0.500_' || (s_suppkey + 1) || '.000' AS utterance_id FROM supplier WHERE s_suppkey % 5 > 1",
    "read_pair_lists": "SELECT CAST(s_suppkey AS VARCHAR) AS pair_id, 'dev' AS split, 'r' || s_suppkey AS src_audio, 's' || s_suppkey AS tgt_audio FROM supplier",
    "read_folders": "SELECT n_nationkey AS row_id, 'whole text ' || n_nationkey AS full_text, n_name || '|other' AS targets, 'again|' || n_name AS separators FROM nation",
    "read_audio_index": """SELECT n_nationkey, 'n' || n_nationkey || '.wav' AS path, true AS audio_exists, CAST(4 + length(n_name) AS BIGINT) AS audio_num_bytes, sha256('RIFF' || n_name) AS audio_sha256 FROM nation""",
    "split_outputs": "SELECT 'all' AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders UNION ALL SELECT 'F', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderstatus = 'F'",
    "score_file": "SELECT format('{:.8f}', s_acctbal) AS value, count(*) AS n FROM supplier GROUP BY 1",
    "published_manifest": "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS row_id FROM nation",
    "audio_extensions": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '.flac' WHEN n_nationkey % 2 = 0 THEN '.wav' ELSE '.mp3' END AS extension FROM nation",
    "ordered_labels": "SELECT p_partkey AS row_id, a AS annotator, CAST(CASE a WHEN 'a1' THEN p_size % 3 ELSE p_partkey % 3 END AS INT) AS score FROM part CROSS JOIN (SELECT unnest(['a1', 'a2']) AS a)",
}
