"""SQL of the catalogue's queries, for DuckDB over the same tables."""

from __future__ import annotations

from assayframe.plans import vocabulary

NUM = r"[-+]?(?:\d+\.\d+|\d+)"


def _q(text: str) -> str:
    return text.replace("'", "''")


VOTES = """votes AS (SELECT l_orderkey AS row_id, 'a' || l_linenumber AS annotator, CAST(floor(max(l_quantity)) AS INT) % 3 AS score
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
PRED = """pred AS (SELECT o_orderkey AS row_id, o_orderpriority AS target_label, CAST(o_custkey % 11 AS DOUBLE) AS score,
  CASE WHEN o_orderkey % 50 = 0 THEN 'no number' END AS err FROM orders)"""
MAJ = """mean AS (SELECT row_id, avg(score) AS mean FROM votes GROUP BY row_id),
cnt AS (SELECT row_id, score, count(*) AS n FROM votes GROUP BY row_id, score),
maj AS (SELECT row_id, score AS majority, mean FROM (SELECT c.*, m.mean, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, abs(score - m.mean), score) AS k
  FROM cnt c JOIN mean m USING (row_id)) WHERE k = 1)"""
MOS = """mos AS (SELECT l_orderkey AS row_id, l_linenumber AS line, l_suppkey AS system_id, 1 + 40 * l_discount AS mos, 1 + (l_quantity - 1) * 9 / 49 AS raw,
  CASE WHEN l_tax <> 0 THEN 'wav/' || l_orderkey || '.wav' END AS audio_path FROM lineitem)"""
PAIRS = """pr AS (SELECT l_orderkey AS pair_id, CASE WHEN l_linestatus = 'F' THEN 'real' ELSE 'synthetic' END AS label, max(l_quantity) AS score
  FROM lineitem GROUP BY 1, 2),
tw AS (SELECT pair_id, max(score) FILTER (label = 'real') AS "real", max(score) FILTER (label = 'synthetic') AS synthetic FROM pr GROUP BY pair_id
  HAVING count(DISTINCT label) = 2)"""
CELLS = """cells AS (SELECT event_id // 4 AS pair_id, CASE WHEN event_id % 2 = 0 THEN 'real_a' ELSE 'synthetic_a' END AS direction,
  CASE WHEN (event_id // 2) % 2 = 0 THEN 'synthetic' ELSE 'real' END AS question,
  CASE WHEN event_type IN ('view', 'signup') THEN 'A' WHEN event_type IN ('click', 'purchase') THEN 'B' END AS choice,
  CASE WHEN (event_id % 2 = 0) = ((event_id // 2) % 2 = 1) THEN 'A' ELSE 'B' END AS correct, event_id AS ord FROM events)"""
ANSWERS = """ans AS (SELECT event_id, event_type, v, CASE event_type
  WHEN 'view' THEN 'Score: ' || v % 23 || '/10'
  WHEN 'click' THEN '```json' || chr(10) || '{"score": ' || v % 13 || ', "extra": ' || props || '}' || chr(10) || '```'
  WHEN 'purchase' THEN 'The clip {a} is fine. Final score: ' || v % 17 || ', final score: ' || v % 29
  WHEN 'signup' THEN 'B is the synthetic one, -' || v % 7 || ' or so'
  ELSE '{"choice": "a", "scores": {"joy": ' || v % 14 || ', "fear": true}} trailing' END AS raw
  FROM (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM events))"""
SPOKEN = """norm AS (SELECT conv_id, turn, role, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM conversations),
spoken AS (SELECT u.conv_id, u.turn, u.t AS reference, a.t AS hypothesis FROM norm u JOIN norm a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
UTT = "utt AS (SELECT event_id AS id, event_type AS talk, user_id AS speaker, epoch_us(ts) / 1e6 AS start, value AS duration FROM events)"
# a row (pair, i, j, v): the edit distance of the first j reference words to the first i others; a step of the recursion is a row of the table
EDITS = """p AS (SELECT k.*, list_filter(string_split(reference, ' '), lambda w: w <> '') AS r, list_filter(string_split(hypothesis, ' '), lambda w: w <> '') AS h FROM said k),
d AS (SELECT conv_id, turn, kind, 0 AS i, j, j AS v FROM p, unnest(range(0, len(r) + 1)) AS t(j)
  UNION ALL
  SELECT conv_id, turn, kind, i + 1, j, CAST(min(t - j) OVER (PARTITION BY conv_id, turn, kind ORDER BY j) + j AS BIGINT) FROM (
    SELECT d.conv_id, d.turn, d.kind, d.i, d.j, least(v + 1, coalesce(lag(v) OVER (PARTITION BY d.conv_id, d.turn, d.kind ORDER BY d.j) + CASE WHEN p.r[d.j] = p.h[d.i + 1] THEN 0 ELSE 1 END, v + 1)) AS t
    FROM d JOIN p ON p.conv_id = d.conv_id AND p.turn = d.turn AND p.kind = d.kind AND d.i < len(p.h))),
e AS (SELECT conv_id, turn, kind, v AS edits, len(r) AS n_reference, len(h) AS n_hypothesis,
  CASE WHEN len(r) > 0 THEN v / len(r) WHEN len(h) = 0 THEN 0.0 ELSE CAST('nan' AS DOUBLE) END AS wer FROM d JOIN p USING (conv_id, turn, kind) WHERE i = len(h) AND j = len(r))"""
LOO = f"""{VOTES},
tot AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS n, sum(score) OVER (PARTITION BY row_id) AS s FROM votes),
held AS (SELECT row_id, annotator, score, CAST(s - score AS DOUBLE) / (n - 1) AS rest_mean FROM tot WHERE n >= 2)"""


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN count(*) < 2 OR var_pop({x}) * var_pop({y}) <= 0 THEN CAST('nan' AS DOUBLE) ELSE covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"


def _block(source: str, m: str, h: str, by: str = "", digits: int = 6) -> str:
    """n, pearson, spearman, mae, mse, rmse of two columns of a table."""
    part = f"PARTITION BY {by} " if by else ""
    over = f"PARTITION BY {by}, " if by else "PARTITION BY "
    lead, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    r = lambda c: f"rank() OVER ({part}ORDER BY {c}) + (count(*) OVER ({over}{c}) - 1) / 2.0"
    return f"""SELECT {lead}count(*) AS n, round({_corr(m, h)}, {digits}) AS pearson, round({_corr('rm', 'rh')}, {digits}) AS spearman,
      round(avg(abs({m} - {h})), {digits}) AS mae, round(avg(({m} - {h}) ** 2), {digits}) AS mse, round(sqrt(avg(({m} - {h}) ** 2)), {digits}) AS rmse
      FROM (SELECT *, {r(m)} AS rm, {r(h)} AS rh FROM {source}){tail}"""


KRIPP = f"""{VOTES},
c AS (SELECT row_id, score, count(*) AS n, sum(count(*)) OVER (PARTITION BY row_id) AS m FROM votes GROUP BY row_id, score),
o AS (SELECT a.score AS c, b.score AS k, sum(a.n * (b.n - CASE WHEN a.score = b.score THEN 1 ELSE 0 END) / (a.m - 1.0)) AS o FROM c a JOIN c b USING (row_id) WHERE a.m >= 2 GROUP BY 1, 2),
g AS (SELECT x.c, y.k, coalesce(o.o, 0) AS o FROM (SELECT unnest([0, 1, 2]) AS c) x CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) y LEFT JOIN o ON o.c = x.c AND o.k = y.k),
m AS (SELECT c, sum(o) AS n FROM g GROUP BY c), t AS (SELECT sum(n) AS t FROM m),
d AS (SELECT g.c, g.k, g.o, a.n AS nc, b.n AS nk, t.t, (SELECT sum(n) FROM m WHERE m.c BETWEEN least(g.c, g.k) AND greatest(g.c, g.k)) - (a.n + b.n) / 2 AS mid
  FROM g JOIN m a ON a.c = g.c JOIN m b ON b.c = g.k CROSS JOIN t),
e AS (SELECT *, CASE WHEN c = k THEN 0 ELSE 1 END AS nominal, CASE WHEN c = k THEN 0 ELSE mid ** 2 END AS ordinal, (c - k) ** 2 AS "interval" FROM d)
""" + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(1 - (sum(o * \"{m}\") / max(t)) / (sum(nc * nk * \"{m}\") / (max(t) * (max(t) - 1))), 6) AS alpha FROM e" for m in ("nominal", "ordinal", "interval"))

KAPPA = f"""{VOTES},
p AS (SELECT a.annotator AS "left", b.annotator AS "right", a.score AS l, b.score AS r, count(*) AS o FROM votes a JOIN votes b ON a.row_id = b.row_id AND a.annotator < b.annotator GROUP BY ALL),
s AS (SELECT "left", "right", sum(o) AS support FROM p GROUP BY ALL HAVING sum(o) >= 2),
nl AS (SELECT "left", "right", l, sum(o) AS nl FROM p GROUP BY ALL), nr AS (SELECT "left", "right", r, sum(o) AS nr FROM p GROUP BY ALL),
x AS (SELECT "left", "right", l, r, nl, nr, coalesce(o, 0) AS o, support FROM nl JOIN nr USING ("left", "right") LEFT JOIN p USING ("left", "right", l, r) JOIN s USING ("left", "right")),
w AS (SELECT 'none' AS weights, *, CASE WHEN l = r THEN 0.0 ELSE 1.0 END AS w FROM x UNION ALL SELECT 'linear', *, abs(l - r) / 2.0 FROM x UNION ALL SELECT 'quadratic', *, (abs(l - r) / 2.0) ** 2 FROM x),
k AS (SELECT weights, "left", "right", CAST(max(support) AS BIGINT) AS support, 1 - sum(w * o) / nullif(sum(w * nl * nr) / max(support), 0) AS kappa FROM w GROUP BY weights, "left", "right")"""

HALF = f"""{VOTES},
it AS (SELECT v.*, i.iteration, count(*) OVER (PARTITION BY iteration, row_id) AS n,
  row_number() OVER (PARTITION BY iteration, row_id ORDER BY md5('13:' || iteration || ':' || row_id || ':' || annotator), annotator) AS k
  FROM votes v CROSS JOIN (SELECT unnest(range(10)) AS iteration) i),
h AS (SELECT iteration, row_id, avg(score) FILTER (k <= n // 2) AS x, avg(score) FILTER (k > n // 2) AS y FROM it WHERE n >= 2 GROUP BY iteration, row_id),
b AS ({_block('h', 'x', 'y', 'iteration', 12)})"""

SPAN = f"""{ANSWERS},
sp AS (SELECT event_id, event_type, v, raw, CASE event_type WHEN 'click' THEN '{{"score": ' || v % 13 || ', "extra": ' || (SELECT props FROM events e WHERE e.event_id = ans.event_id) || '}}'
  WHEN 'purchase' THEN '{{a}}' WHEN 'view' THEN NULL WHEN 'signup' THEN NULL ELSE '{{"choice": "a", "scores": {{"joy": ' || v % 14 || ', "fear": true}}}}' END AS span FROM ans)"""

_first = f"TRY_CAST(nullif(regexp_extract(raw, '({NUM})', 1), '') AS DOUBLE)"
_on = lambda x: f"CASE WHEN {x} BETWEEN 0 AND 10 THEN {x} END"
_last = lambda p: f"list_filter(list_transform(regexp_extract_all(raw, '(?i){p}\\s*[:=]\\s*({NUM})', 1), lambda x: CAST(x AS DOUBLE)), lambda x: x BETWEEN 0 AND 10)[-1]"
_one = vocabulary.CONTRASTIVE["prompt_template"].replace("{{", "{").replace("}}", "}")
_opp = f"CASE e WHEN 'Awe' THEN '{vocabulary.OPPOSITES['Awe']}' WHEN 'Jealousy / Envy' THEN '{vocabulary.OPPOSITES['Jealousy / Envy']}' ELSE 'absence of ' || e END"

_shown = "CASE WHEN question = 'real' THEN CASE choice WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' END ELSE choice END"
RATES = "count(*) - count(choice) AS parse_failures, round(count(*) FILTER (choice = 'B') / count(choice), 6) AS rate_b, " + ", ".join(f"round(count(*) FILTER ({_shown} = '{x.upper()}') / count(choice), 6) AS synthetic_{x}" for x in "ab")

ORACLES = {
    "vote_long": f"WITH {VOTES} SELECT * FROM votes",
    "vote_summary": f"""WITH {VOTES} SELECT row_id, count(*) AS n_annotators, round(avg(score), 6) AS mean_score_raw_0_2, round(avg(score * 5), 6) AS mean_score_0_10,
      CAST(median(score * 5) AS DOUBLE) AS median_score_0_10, round(coalesce(stddev_samp(score * 5), 0), 6) AS std_score_0_10 FROM votes GROUP BY row_id""",
    "majority_vote": f"WITH {VOTES}, {MAJ} SELECT row_id, majority FROM maj",
    "rounded_mean": f"WITH {VOTES} SELECT row_id, CAST(round_even(avg(score), 0) AS INT) AS rounded FROM votes GROUP BY row_id",
    "label_counts": f"WITH {PRED} SELECT target_label, count(*) AS n, count(DISTINCT score) AS scores FROM pred GROUP BY target_label",
    "emotion_metrics": f"""WITH {VOTES}, {PRED}, {MAJ}, j AS (SELECT p.score, m.mean * 5 AS human, m.majority, m.mean FROM pred p JOIN maj m USING (row_id) WHERE err IS NULL)
      SELECT b.*, (SELECT round(avg(CASE WHEN score = majority * 5 THEN 1.0 ELSE 0.0 END), 6) FROM j) AS accuracy_majority,
      (SELECT round(avg(CASE WHEN score = round_even(mean, 0) * 5 THEN 1.0 ELSE 0.0 END), 6) FROM j) AS accuracy_rounded FROM ({_block('j', 'score', 'human')}) b""",
    "score_distribution": f"WITH {PRED} SELECT score, count(*) AS n FROM pred WHERE err IS NULL GROUP BY score",
    "parse_error_counts": f"WITH {PRED} SELECT target_label, count(*) AS considered, count(*) FILTER (err IS NULL) AS parsed FROM pred GROUP BY target_label",
    "missing_votes": f"WITH {VOTES}, {PRED} SELECT row_id FROM pred WHERE row_id NOT IN (SELECT row_id FROM votes)",
    "spearman_ranks": f"""WITH {PRED} SELECT row_id, rank() OVER (PARTITION BY target_label ORDER BY score) + (count(*) OVER (PARTITION BY target_label, score) - 1) / 2.0 AS rank FROM pred""",
    "annotator_pairs": f"""WITH {VOTES} SELECT a.annotator AS "left", b.annotator AS "right", count(*) AS shared, count(*) FILTER (a.score = b.score) AS equal
      FROM votes a JOIN votes b ON a.row_id = b.row_id AND a.annotator < b.annotator GROUP BY 1, 2""",
    "pair_agreement": f"""WITH {VOTES}, r AS (SELECT row_id, count(DISTINCT score) AS k FROM votes GROUP BY row_id HAVING count(*) >= 2),
      p AS (SELECT a.score AS l, b.score AS r FROM votes a JOIN votes b ON a.row_id = b.row_id AND a.annotator < b.annotator)
      SELECT (SELECT count(*) FROM r) AS rows, (SELECT round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END), 6) FROM r) AS exact_rows, count(*) AS pairs,
      round(avg(CASE WHEN l = r THEN 1.0 ELSE 0.0 END), 6) AS pair_agreement, round(avg(abs(l - r)), 6) AS mean_difference FROM p""",
    "krippendorff": f"WITH {KRIPP}",
    "cohen_kappa": f'WITH {KAPPA} SELECT weights, "left", "right", support, round(kappa, 6) AS kappa FROM k',
    "kappa_summary": f"WITH {KAPPA} SELECT weights, count(*) AS pairs, round(avg(kappa), 6) AS mean_kappa, round(sum(kappa * support) / sum(support), 6) AS weighted_kappa FROM k WHERE kappa IS NOT NULL GROUP BY weights",
    "leave_one_out": f"""WITH {LOO}, rc AS (SELECT h.row_id, h.annotator, h.score, h.rest_mean, v.score AS s, count(*) AS n FROM held h JOIN votes v ON v.row_id = h.row_id AND v.annotator <> h.annotator GROUP BY ALL)
      SELECT row_id, annotator, score, round(rest_mean, 6) AS rest_mean, s AS rest_majority
      FROM (SELECT *, row_number() OVER (PARTITION BY row_id, annotator ORDER BY n DESC, abs(s - rest_mean), s) AS k FROM rc) WHERE k = 1""",
    "loo_metrics": f"WITH {LOO}, hv AS (SELECT CAST(score AS DOUBLE) AS vote, rest_mean FROM held) {_block('hv', 'vote', 'rest_mean')}",
    "loo_sample_weighted": f"""WITH {LOO}, r AS (SELECT row_id, avg(abs(score - rest_mean)) AS mae, avg((score - rest_mean) ** 2) AS mse FROM held GROUP BY row_id)
      SELECT count(*) AS rows, round(avg(mae), 6) AS mae, round(avg(mse), 6) AS mse, round(sqrt(avg(mse)), 6) AS rmse FROM r""",
    "split_half_lattice": f"""WITH {VOTES},
v AS (SELECT row_id, list(score ORDER BY annotator) AS s, count(*) AS n FROM votes GROUP BY row_id HAVING count(*) >= 2),
mask AS (SELECT n, m, row_number() OVER (PARTITION BY n ORDER BY m) - 1 AS k, count(*) OVER (PARTITION BY n) AS c
  FROM (SELECT unnest(range(2, 11)) AS n), (SELECT unnest(range(0, 1024)) AS m) WHERE m < 2 ** n AND bit_count(m) = n // 2),
d AS (SELECT iteration, s, v.n, CAST('0x' || substr(md5('13:' || iteration // 4 || ':' || row_id), 1 + 8 * (iteration % 4), 8) AS BIGINT) % c AS k, count(*) AS w
  FROM v JOIN (SELECT DISTINCT n, c FROM mask) USING (n), (SELECT unnest(range(0, 1000)) AS iteration) GROUP BY ALL),
xy AS (SELECT iteration, list_avg(list_filter(s, lambda a, i: (m >> (i - 1)) & 1 = 1)) AS x, list_avg(list_filter(s, lambda a, i: (m >> (i - 1)) & 1 = 0)) AS y, w FROM d JOIN mask USING (n, k)),
g AS (SELECT iteration, x, y, sum(w) AS w FROM xy GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY iteration ORDER BY x) - (sum(w) OVER (PARTITION BY iteration, x) - 1) / 2 AS p, sum(w) OVER (PARTITION BY iteration ORDER BY y) - (sum(w) OVER (PARTITION BY iteration, y) - 1) / 2 AS q FROM g),
z AS (SELECT iteration, sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, (sum(w) + 1) / 2 AS mr FROM r GROUP BY iteration),
b AS (SELECT iteration, CAST(any_value(n) AS BIGINT) AS n, sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) ** 2) * sum(w * (y - my) ** 2)) AS pearson,
  sum(w * (p - mr) * (q - mr)) / sqrt(sum(w * (p - mr) ** 2) * sum(w * (q - mr) ** 2)) AS spearman FROM r JOIN z USING (iteration) GROUP BY iteration)
SELECT iteration, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(2 * pearson / (1 + pearson), 6) AS reliability FROM b""",
    "split_medians": "SELECT coalesce(split, 'all') AS split, n, " + ", ".join(f"round({k}_{c}, 4) AS {k}_{c}" for c in ("price", "quantity", "cut") for k in ("mean", "median")) + """ FROM (
  SELECT split, count(*) AS n, """ + ", ".join(f"avg({c}) AS mean_{c}, median({c}) AS median_{c}" for c in ("price", "quantity", "cut")) + """
  FROM (SELECT l_returnflag AS split, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice * l_discount AS DOUBLE) AS cut FROM lineitem) GROUP BY ROLLUP (split))""",
    "split_half_hash": f"WITH {HALF} SELECT iteration, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(2 * pearson / (1 + pearson), 6) AS reliability FROM b",
    "stratified_sample": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('13:' || lang || ':' || doc_id), doc_id) AS k FROM documents) WHERE k <= 10",
    "parse_first_number": f"WITH {ANSWERS} SELECT event_id, {_on(_first)} AS score FROM ans",
    "parse_final_score": f"""WITH {ANSWERS} SELECT event_id, coalesce(CASE WHEN event_type = 'click' AND v % 13 BETWEEN 0 AND 10 THEN CAST(v % 13 AS DOUBLE) END,
      {_last('final\\s*score')}, {_last('score')}, {_on(_first)}) AS score FROM ans""",
    "parse_json_span": f"WITH {SPAN} SELECT event_id, span FROM sp",
    "parse_choice": f"""WITH {ANSWERS} SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN NULL WHEN event_type = 'purchase' THEN 'A' WHEN event_type = 'signup' THEN 'B' ELSE 'A' END AS choice FROM ans""",
    "parse_label_scores": f"""WITH {ANSWERS} SELECT event_id,
      CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') AND v % 14 <= 10 THEN CAST(v % 14 AS DOUBLE) END AS joy,
      CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') AND v % 14 <= 10 THEN 'fear' ELSE 'joy,fear' END AS missing,
      CASE WHEN event_type = 'click' THEN 'extra,score' ELSE '' END AS extra,
      CASE WHEN event_type IN ('view', 'click', 'purchase', 'signup') THEN '' WHEN v % 14 <= 10 THEN 'fear' ELSE 'fear,joy' END AS invalid,
      CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN 'response did not contain a JSON object' ELSE 'JSON scores did not exactly match expected emotions and numeric scale' END AS error FROM ans""",
    "parse_bool": "SELECT event_id, CASE event_id % 7 WHEN 6 THEN [false, true, NULL][CAST(floor(value) AS BIGINT) % 3 + 1] WHEN 4 THEN NULL ELSE [true, false, true, false, NULL, false][event_id % 7 + 1] END AS flag FROM events",
    "text_helpers": """SELECT p_partkey, regexp_replace(trim(replace(replace(lower(p_type || ' / & ' || p_brand), '/', '-'), '&', 'and')), '\\s+', '-', 'g') AS slug,
      regexp_replace(regexp_replace('_' || p_name || ' #', '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS safe,
      CASE WHEN length(p_name || '\\nline') > 12 THEN left(p_name || '\\nline', 9) || '...' ELSE p_name || '\\nline' END AS snippet,
      '0_' || p_size AS suffix, trim(regexp_replace(replace(p_name || '  it ''s ', ' ''', ''''), '\\s+', ' ', 'g')) AS clean FROM part""",
    "target_hits": f"""WITH {SPOKEN}, h AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'with_repeat' ELSE 'without_repeat' END AS condition, contains(hypothesis, string_split(reference, ' ')[1]) AS hit FROM spoken)
      SELECT condition, count(*) AS n, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) * 100.0 / count(*), 6) AS percent FROM h GROUP BY condition""",
    "boolean_mismatches": f"""WITH {SPOKEN}, h AS (SELECT CASE WHEN conv_id % 3 = 0 THEN NULL ELSE conv_id % 3 = 1 END AS stated, contains(hypothesis, string_split(reference, ' ')[1]) AS hit FROM spoken)
      SELECT count(*) FILTER (stated IS DISTINCT FROM hit) AS mismatches, count(*) AS n FROM h""",
    "separator_split": f"""WITH {SPOKEN}, x AS (SELECT *, CASE WHEN contains(hypothesis, ' of ') THEN ' of ' WHEN contains(hypothesis, ' the ') THEN ' the ' WHEN contains(hypothesis, ' de ') THEN ' de ' END AS sep FROM spoken)
      SELECT conv_id, turn, CASE WHEN sep IS NULL THEN hypothesis ELSE left(hypothesis, instr(hypothesis, sep) - 1) END AS before,
      CASE WHEN sep IS NOT NULL THEN substr(hypothesis, instr(hypothesis, sep) + length(sep)) END AS after FROM x""",
    "mos_rescale": f"""WITH {MOS} SELECT system_id, round(avg(CASE system_id % 3 WHEN 0 THEN 1 + (raw - 1) / 9 * 4 WHEN 1 THEN 1 + raw / 10 * 4 ELSE raw END), 6) AS mos, count(*) AS n FROM mos GROUP BY system_id""",
    "mos_metrics_utterance": f"WITH {MOS}, u AS (SELECT 1 + (raw - 1) / 9 * 4 AS model, mos FROM mos) {_block('u', 'model', 'mos')}",
    "mos_metrics_system": f"WITH {MOS}, s AS (SELECT round(avg(1 + (raw - 1) / 9 * 4), 9) AS model, round(avg(mos), 9) AS mos FROM mos GROUP BY system_id) {_block('s', 'model', 'mos')}",
    "system_mean_join": f"WITH {MOS} SELECT system_id, first(s_acctbal) AS system_mean_mos, count(*) AS n FROM mos LEFT JOIN supplier ON s_suppkey = system_id GROUP BY system_id",
    "listener_arrays": """SELECT p_partkey AS part, coalesce(s, '') AS scores, coalesce(n, 0) AS n_listeners, round(m, 6) AS listener_mean_mos FROM part LEFT JOIN
      (SELECT l_partkey, array_to_string(list(l_linenumber ORDER BY l_linenumber), ',') AS s, count(*) AS n, avg(l_linenumber) AS m FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey""",
    "mos_manifest": """SELECT row_number() OVER (ORDER BY p_brand, CAST(p_partkey AS VARCHAR)) - 1 AS row_id, p_brand AS split, CAST(p_partkey AS VARCHAR) AS name, p_partkey % 10 + 1 AS system_id,
      s_acctbal AS system_mean_mos, coalesce(n, 0) AS n_listeners, round(m, 6) AS listener_mean_mos FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 10 + 1
      LEFT JOIN (SELECT l_partkey, count(*) AS n, avg(l_linenumber) AS m FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey""",
    "canonical_labels": f"""SELECT p_partkey, [{', '.join("'" + v + "'" for v in (*vocabulary.ALIASES.values(), 'Other label'))}][p_partkey % 10 + 1] AS label, p_brand AS by_marker,
      CAST(p_partkey AS VARCHAR) AS by_underscore, p_brand AS sentence FROM part""",
    "missing_audio_filter": f"WITH {MOS} SELECT system_id, count(*) AS n, min('/data/' || audio_path) AS first_path FROM mos WHERE audio_path IS NOT NULL GROUP BY system_id",
    "pair_deltas": f'WITH {PAIRS} SELECT pair_id, "real", synthetic, synthetic - "real" AS delta FROM tw',
    "pair_delta_summary": f"""WITH {PAIRS}, d AS (SELECT synthetic - "real" AS delta FROM tw) SELECT count(*) AS n, round(avg(delta), 6) AS mean, min(delta) AS low, max(delta) AS high,
      count(*) FILTER (delta < 0) AS negative, count(*) FILTER (delta = 0) AS zero, count(*) FILTER (delta > 0) AS positive FROM d""",
    "repeat_average": f"""WITH {MOS}, r AS (SELECT 'r' || row_id % 1000 AS request_id, raw, row_id, line, row_id || '-' || line AS label FROM mos)
      SELECT request_id, round(avg(raw), 6) AS score, count(*) AS repeats, arg_min(label, (row_id, line, raw)) AS label FROM r GROUP BY request_id""",
    "pairwise_accuracy": f"""WITH {CELLS} SELECT count(*) AS considered, count(choice) AS parsed, {RATES}, round(count(*) FILTER (choice = correct) / count(choice), 6) AS accuracy,
      round(count(*) FILTER (choice = 'A') / count(choice), 6) AS rate_a FROM cells""",
    "pairwise_by_direction": f"""WITH {CELLS} SELECT coalesce(direction, 'all') AS direction, coalesce(question, 'all') AS question, count(*) AS considered, count(choice) AS parsed, {RATES},
      round(count(*) FILTER (choice = correct) / count(choice), 6) AS accuracy, round(count(*) FILTER (choice = 'A') / count(choice), 6) AS rate_a
      FROM cells GROUP BY GROUPING SETS ((direction), (question), ())""",
    "inferred_synthetic": f"WITH {CELLS} SELECT ord, CASE WHEN choice IS NULL THEN NULL WHEN question = 'real' THEN CASE WHEN choice = 'A' THEN 'B' ELSE 'A' END ELSE choice END AS inferred FROM cells",
    "complete_pair_scores": f"""WITH {CELLS} SELECT pair_id, count(*) AS cells, CAST(count(*) FILTER (choice = correct) AS BIGINT) AS correct FROM cells WHERE choice IS NOT NULL GROUP BY pair_id
      HAVING count(DISTINCT (direction, question)) = (SELECT count(DISTINCT (direction, question)) FROM cells)""",
    "correct_histogram": f"""WITH {CELLS}, p AS (SELECT pair_id, count(*) FILTER (choice = correct) AS correct FROM cells WHERE choice IS NOT NULL GROUP BY pair_id HAVING count(*) = 4)
      SELECT g.correct, count(p.pair_id) AS pairs FROM (SELECT unnest(range(5)) AS correct) g LEFT JOIN p USING (correct) GROUP BY g.correct""",
    "prompt_choice": f"""WITH {UTT} SELECT id, pid AS prompt_id FROM (SELECT a.id, b.id AS pid, row_number() OVER (PARTITION BY a.id
      ORDER BY b.duration < 8, abs(b.duration - 12), abs(b.start - a.start), b.start, b.id) AS k FROM utt a JOIN utt b ON a.talk = b.talk AND a.speaker = b.speaker AND a.id <> b.id) WHERE k = 1""",
    "prompt_skipped_by_hour": """WITH u AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H') AS talk, user_id AS speaker FROM events)
      SELECT id, 'no_prompt_candidate' AS reason FROM (SELECT id, count(*) OVER (PARTITION BY talk, speaker) AS n FROM u) WHERE n = 1""",
    "prompt_skipped": f"""WITH {UTT}, u AS (SELECT * FROM utt) SELECT id, 'no_prompt_candidate' AS reason FROM u a
      WHERE NOT EXISTS (SELECT 1 FROM u b WHERE a.talk = b.talk AND a.speaker = b.speaker AND a.id <> b.id)""",
    "utterance_ids": f"WITH {UTT} SELECT id, talk || '__' || speaker || '__' || format('{{:.3f}}', id / 8) || '_' || format('{{:.3f}}', id / 8 + speaker % 50) AS utterance_id FROM utt",
    "dense_row_ids": "SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS row_id FROM customer",
    "last_row_wins": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "merged_predictions": """SELECT o_orderkey AS request_id, o_orderstatus AS status, lines FROM orders LEFT JOIN
      (SELECT l_orderkey, max(l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "requests_cross": f"""SELECT 'row-' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR))) AS INT), '0') || '__emotion-' || array_to_string(list_filter(string_split(replace(lower(e), '/', '-'), ' '), lambda x: x <> ''), '-') AS request_id,
      o_orderkey AS row_id, '/data/a.wav' AS audio_path, e AS scored_emotion, replace(replace('{_q(_one)}', '{{emotion}}', e), '{{opposite_emotion}}', {_opp}) AS prompt, {_opp} AS opposite_emotion
      FROM orders CROSS JOIN (SELECT unnest(['Awe', 'Jealousy / Envy', 'Arousal']) AS e)""",
    "requests_all_at_once": """SELECT 'row-' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR))) AS INT), '0') || '__all-emotions' AS request_id, CAST(NULL AS VARCHAR) AS audio_path,
      'Score: {"scores": {}}' || chr(10) || '- Awe' || chr(10) || '- Hope' AS prompt FROM orders""",
    "requests_pairwise": f"""WITH {PAIRS}, n AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS i FROM tw),
      x AS (SELECT n.*, d.d, d.direction, q.q, q.question FROM n CROSS JOIN (VALUES (0, 'real_a_synthetic_b'), (1, 'synthetic_a_real_b')) d(d, direction) CROSS JOIN (VALUES (0, 'synthetic'), (1, 'real')) q(q, question))
      SELECT 'pairs__dev__balanced__pair-' || lpad(CAST(i AS VARCHAR), CAST(greatest(6, length(CAST(i AS VARCHAR))) AS INT), '0') || '__' || direction || '__ask-' || question AS request_id, i * 4 + d * 2 + q AS row_id, pair_id, direction, question AS question_target,
      CASE WHEN d = 0 THEN 'r' || pair_id || ',s' || pair_id ELSE 's' || pair_id || ',r' || pair_id END AS audio_paths, CASE WHEN (d = 0) = (question = 'real') THEN 'A' ELSE 'B' END AS correct_choice,
      'Both say: text ' || pair_id || chr(10) || CASE question WHEN 'real' THEN 'Which one is the person?' ELSE 'Which one is the machine?' END AS prompt FROM x""",
    "unpivot_pairs": f"""WITH {PAIRS} SELECT pair_id, label, CASE WHEN label = 'real' THEN 'r' ELSE 's' END || pair_id AS audio_path, CASE WHEN label = 'real' THEN 's' ELSE 'r' END || pair_id AS other_audio_path,
      pair_id || '__' || label AS sample_id FROM tw CROSS JOIN (SELECT unnest(['real', 'synthetic']) AS label)""",
    "requests_repeats": """SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS request_id, r AS repeat_index, 3 AS repeat_count,
      CAST(100 + (row_number() OVER (PARTITION BY r ORDER BY p_partkey) - 1) * 3 + r AS BIGINT) AS generation_seed FROM part CROSS JOIN (SELECT CAST(unnest(range(3)) AS INT) AS r)""",
    "wer_rows": f"""WITH RECURSIVE {SPOKEN}, said AS (SELECT *, 'reply' AS kind FROM spoken), {EDITS}
SELECT conv_id, turn, edits, n_reference, n_hypothesis, round(wer, 6) AS wer FROM e""",
    "wer_by_split": f"""WITH RECURSIVE {SPOKEN}, said AS (SELECT *, 'reply' AS kind FROM spoken UNION ALL SELECT * REPLACE (regexp_replace(reference, '\\be\\w*', 'x', 'g') AS hypothesis), 'own' FROM spoken), {EDITS},
w AS (SELECT a.conv_id, CASE WHEN a.conv_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, b.wer AS source, a.wer AS synthetic, a.wer - b.wer AS delta
  FROM e a JOIN e b USING (conv_id, turn) WHERE a.kind = 'reply' AND b.kind = 'own' AND NOT isnan(a.wer) AND NOT isnan(b.wer))
SELECT coalesce(split, 'all') AS split, count(*) AS n, """ + ", ".join(f"round({f}({c}), 6) AS {k}_{c}" for c in ("source", "synthetic", "delta") for k, f in (("mean", "avg"), ("median", "median"))) + " FROM w GROUP BY ROLLUP (split)",
    "pair_cosine_features": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM e),
      p AS (SELECT a.vec_id // 2 AS k, a.v AS a, b.v AS b FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)
      SELECT k, round(list_dot_product(a, b), 4) AS cosine, round(list_sum(a) + list_sum(b) + list_dot_product(a, b) + list_sum(list_transform(list_zip(a, b), lambda z: abs(z[2] - z[1]))), 4) AS total, CAST(4 * len(a) AS BIGINT) AS dims FROM p""",
    "masked_mean_pool": """WITH e AS (SELECT label AS id, CAST(vec_id % 3 <> 0 AS INT) AS w, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings)
      SELECT id, dim, round(sum(CAST(x AS DOUBLE) * w) / greatest(sum(w), 1), 5) AS x FROM e GROUP BY id, dim""",
    "autopcp_linear_head": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
      p AS (SELECT a.vec_id // 2 AS k, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
      w AS (SELECT list_transform(range(256), lambda i: ((i * 37) % 11 - 5) / 10) AS w),
      f AS (SELECT k, a, b, list_transform(list_zip(a, b), lambda z: z[1] * z[2]) AS m, list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])) AS d FROM p)
      SELECT k, round((list_dot_product(list_concat(list_concat(a, b), list_concat(m, d)), w) + list_dot_product(list_concat(list_concat(b, a), list_concat(m, d)), w)) / 2 + 0.5, 4) AS score FROM f, w""",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
}
