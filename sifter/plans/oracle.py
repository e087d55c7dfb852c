"""DuckDB oracle SQL for the registered queries (same column names and rounding).

Constants are cast to DOUBLE: bare decimals are DECIMAL in SQL and would make
the two engines round differently.
"""

from __future__ import annotations

SQL: dict[str, str] = {}


def D(x) -> str:
    """A DOUBLE literal."""
    return f"CAST({x} AS DOUBLE)"


from sifter.functions.text import WS  # noqa: E402  (same whitespace class as Spark)


def TOK(expr: str) -> str:
    """H1 tokenizer as a DuckDB list expression."""
    return (f"list_filter(regexp_split_to_array(regexp_replace(lower({expr}), "
            f"'[^\\p{{L}}\\p{{N}}_{WS}]', '', 'g'), '[{WS}]+'), lambda x: x <> '')")


def THASH(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT)"


# Common table expressions for the document index and the question side.
def _bm25_ctes(k1=1.5, b=0.75, eps=0.25, qsrc="benchmark") -> str:
    return f"""
dt AS (SELECT doc_id, {TOK('text')} AS toks FROM documents),
dl AS (SELECT doc_id, CAST(len(toks) AS DOUBLE) AS dl FROM dt),
post AS (SELECT doc_id, term, count(*) AS tf
         FROM (SELECT doc_id, unnest(toks) AS term FROM dt) GROUP BY doc_id, term),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, avg(dl) AS avgdl FROM dl),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
rawidf AS (SELECT term, df, ln(n_docs - df + {D(0.5)}) - ln(df + {D(0.5)}) AS raw FROM dfs, stats),
flo AS (SELECT {D(eps)} * avg(raw) AS eps_idf FROM rawidf),
idf AS (SELECT term, CASE WHEN raw < 0 THEN eps_idf ELSE raw END AS idf FROM rawidf, flo),
qtok AS (SELECT item_id AS query_id, {TOK('text')} AS qtoks FROM {qsrc}),
qt AS (SELECT query_id, term, count(*) AS qtf
       FROM (SELECT query_id, unnest(qtoks) AS term FROM qtok) GROUP BY query_id, term),
qw AS (SELECT query_id, term, qtf * idf AS w FROM qt JOIN idf USING (term)),
bm_hit AS (SELECT q.query_id, p.doc_id,
                  sum(q.w * (p.tf * {D(k1 + 1)}) / (p.tf + {D(k1)} * ({D(1 - b)} + {D(b)} * d.dl / s.avgdl))) AS bm25
           FROM qw q JOIN post p USING (term) JOIN dl d ON d.doc_id = p.doc_id CROSS JOIN stats s
           GROUP BY q.query_id, p.doc_id),
bm_all AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(h.bm25, {D(0)}) AS bm25
           FROM {qsrc} b CROSS JOIN dl d
           LEFT JOIN bm_hit h ON h.query_id = b.item_id AND h.doc_id = d.doc_id)"""


def _hash_ctes() -> str:
    """Hashed vectors (integer counts per dim) of documents and questions, and all cosines."""
    return f"""
dh AS (SELECT doc_id, h % 64 AS dim, CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END AS sg
       FROM (SELECT doc_id, {THASH('t')} AS h FROM (SELECT doc_id, unnest(toks) AS t FROM dt))),
dv AS (SELECT doc_id, dim, CAST(sum(sg) AS DOUBLE) AS w FROM dh GROUP BY doc_id, dim),
dn AS (SELECT d.doc_id, sqrt(coalesce(sum(v.w * v.w), 0)) AS nrm
       FROM dl d LEFT JOIN dv v USING (doc_id) GROUP BY d.doc_id),
qh AS (SELECT query_id, h % 64 AS dim, CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END AS sg
       FROM (SELECT query_id, {THASH('t')} AS h FROM (SELECT query_id, unnest(qtoks) AS t FROM qtok))),
qv AS (SELECT query_id, dim, CAST(sum(sg) AS DOUBLE) AS w FROM qh GROUP BY query_id, dim),
qn AS (SELECT q.query_id, sqrt(coalesce(sum(v.w * v.w), 0)) AS nrm
       FROM qtok q LEFT JOIN qv v USING (query_id) GROUP BY q.query_id),
dotp AS (SELECT q.query_id, d.doc_id, sum(q.w * d.w) AS dp FROM qv q JOIN dv d USING (dim)
         GROUP BY q.query_id, d.doc_id),
sem_all AS (SELECT qn.query_id, dn.doc_id,
                   CASE WHEN qn.nrm = 0 OR dn.nrm = 0 THEN {D(0)}
                        ELSE coalesce(dotp.dp, {D(0)}) / (qn.nrm * dn.nrm) END AS semantic
            FROM qn CROSS JOIN dn
            LEFT JOIN dotp ON dotp.query_id = qn.query_id AND dotp.doc_id = dn.doc_id)"""


def _topk(src: str, k: int, score: str = "score", part: str = "query_id", oid: str = "doc_id") -> str:
    return f"""
SELECT {part}, CAST(rank AS INTEGER) AS rank, {oid}, score FROM (
  SELECT {part}, {oid}, round({score}, 6) AS score,
         row_number() OVER (PARTITION BY {part} ORDER BY round({score}, 6) DESC, {oid}) AS rank
  FROM {src}) WHERE rank <= {k}"""


def _hybrid(alpha: float) -> str:
    return f"""
ranges AS (SELECT b.query_id, min(b.bm25) AS bmin, max(b.bm25) AS bmax,
                  min(s.semantic) AS smin, max(s.semantic) AS smax
           FROM bm_all b JOIN sem_all s USING (query_id, doc_id) GROUP BY b.query_id),
hy AS (SELECT b.query_id, b.doc_id,
              {D(1 - alpha)} * (b.bm25 - r.bmin) / (r.bmax - r.bmin + {D(1e-8)})
              + {D(alpha)} * (s.semantic - r.smin) / (r.smax - r.smin + {D(1e-8)}) AS score
       FROM bm_all b JOIN sem_all s USING (query_id, doc_id) JOIN ranges r USING (query_id))"""


SQL["tokenize_docs"] = f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {TOK('text')} AS t FROM documents)"""

SQL["corpus_stats"] = f"""
WITH {_bm25_ctes()}
SELECT CAST(s.n_docs AS BIGINT) AS n_docs, round(s.avgdl, 6) AS avgdl, round(f.eps_idf, 6) AS eps_idf,
       CAST(v.n_terms AS BIGINT) AS n_terms, CAST(v.n_postings AS BIGINT) AS n_postings
FROM stats s, flo f, (SELECT count(*) AS n_terms, sum(df) AS n_postings FROM dfs) v"""

# Every text is split once; only the vocabulary's counts go on.
SQL["term_df"] = f"""
WITH seen AS (SELECT unnest(list_distinct({TOK('text')})) AS term FROM documents),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM seen GROUP BY term),
nd AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs FROM documents),
rawidf AS MATERIALIZED (
  SELECT term, df, ln(n_docs - df + {D(0.5)}) - ln(df + {D(0.5)}) AS raw FROM dfs, nd),
flo AS (SELECT {D(0.25)} * avg(raw) AS eps_idf FROM rawidf)
SELECT term, CAST(df AS BIGINT) AS df, round(CASE WHEN raw < 0 THEN eps_idf ELSE raw END, 6) AS idf
FROM rawidf, flo"""

SQL["bm25_topk"] = f"""
WITH {_bm25_ctes()}
{_topk('(SELECT query_id, doc_id, bm25 AS score FROM bm_all)', 5)}"""

SQL["hashed_vectors"] = f"""
WITH {_bm25_ctes()}, {_hash_ctes()}
SELECT v.doc_id, CAST(v.dim AS INTEGER) AS dim, round(v.w / n.nrm, 6) AS w
FROM dv v JOIN dn n USING (doc_id) WHERE v.w <> 0"""

SQL["hashed_vector_topk"] = f"""
WITH {_bm25_ctes()}, {_hash_ctes()}
{_topk('(SELECT query_id, doc_id, semantic AS score FROM sem_all)', 5)}"""

SQL["vector_topk_dense"] = f"""
WITH el AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos,
                   CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cen AS (SELECT label AS qlabel, pos, avg(x) AS c FROM el GROUP BY label, pos),
cn AS (SELECT qlabel, sqrt(sum(c * c)) AS nrm FROM cen GROUP BY qlabel),
en AS (SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM el GROUP BY vec_id),
dp AS (SELECT c.qlabel, e.vec_id, sum(c.c * e.x) AS dp FROM cen c JOIN el e USING (pos)
       GROUP BY c.qlabel, e.vec_id),
sc AS (SELECT dp.qlabel AS label, dp.vec_id,
              CASE WHEN cn.nrm = 0 OR en.nrm = 0 THEN {D(0)} ELSE dp.dp / (cn.nrm * en.nrm) END AS score
       FROM dp JOIN cn USING (qlabel) JOIN en USING (vec_id))
{_topk('sc', 5, part='label', oid='vec_id')}"""

for _name, _alpha in (("hybrid_topk", 0.5), ("hybrid_alpha0", 0.0), ("hybrid_alpha1", 1.0)):
    SQL[_name] = f"""
WITH {_bm25_ctes()}, {_hash_ctes()}, {_hybrid(_alpha)}
{_topk('hy', 5)}"""

SQL["hybrid_rerank_topk"] = f"""
WITH {_bm25_ctes()}, {_hash_ctes()}, {_hybrid(0.5)},
first AS ({_topk('hy', 20)}),
qd AS (SELECT query_id, list_distinct(qtoks) AS qd FROM qtok),
rr AS (SELECT f.query_id, f.doc_id, f.rank AS rank1,
              round(CASE WHEN len(qd.qd) = 0 THEN {D(0)} ELSE
                    CAST(len(list_intersect(qd.qd, list_distinct({TOK('d.text')}))) AS DOUBLE) / len(qd.qd) END, 6) AS score
       FROM first f JOIN qd USING (query_id) JOIN documents d ON d.doc_id = f.doc_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT query_id, doc_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank1) AS rank FROM rr)
WHERE rank <= 5"""


def SENTS(expr: str) -> str:
    """H2 sentence split as a DuckDB list expression."""
    return (f"list_filter(list_transform(regexp_split_to_array({expr}, '[.!?]+'), "
            f"lambda x: regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda x: x <> '')")


SQL["split_sentences"] = f"""
SELECT doc_id, CAST(sent_ord - 1 AS INTEGER) AS sent_ord, sentence FROM (
  SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS sent_ord
  FROM (SELECT doc_id, {SENTS('text')} AS s FROM documents))"""

SQL["chunk_token_window"] = f"""
WITH t AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '[{WS}]+'), lambda x: x <> '') AS toks
           FROM documents),
w AS (SELECT doc_id, source, toks,
             unnest(generate_series(0, CAST(greatest(0, ceil((len(toks) - 512) / CAST(462 AS DOUBLE))) * 462 AS BIGINT), 462)) AS st
      FROM t WHERE len(toks) > 0)
SELECT source AS kb_name, CAST(doc_id AS BIGINT) AS doc_id, CAST(st // 462 AS INTEGER) AS chunk_ord,
       CAST(doc_id AS VARCHAR) || '#' || CAST(st // 462 AS VARCHAR) AS chunk_id,
       array_to_string(toks[st + 1 : st + 512], ' ') AS text,
       CAST(length(array_to_string(toks[st + 1 : st + 512], ' ')) AS INTEGER) AS chunk_size,
       'token' AS chunk_strategy
FROM w"""

SQL["chunk_semantic"] = f"""
WITH RECURSIVE
s AS (SELECT doc_id, source, text, {SENTS('text')} AS sents FROM documents),
single AS (SELECT doc_id, source, 0 AS chunk_no, text AS chunk_text FROM s WHERE len(sents) <= 1 AND text <> ''),
multi AS (SELECT doc_id, source, unnest(sents) AS sentence, generate_subscripts(sents, 1) AS i
          FROM s WHERE len(sents) > 1),
sh AS (SELECT doc_id, i, h % 64 AS dim, CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END AS sg
       FROM (SELECT doc_id, i, {THASH('t')} AS h
             FROM (SELECT doc_id, i, unnest({TOK('sentence')}) AS t FROM multi))),
sv AS (SELECT doc_id, i, dim, CAST(sum(sg) AS DOUBLE) AS w FROM sh GROUP BY doc_id, i, dim),
sn AS (SELECT m.doc_id, m.i, sqrt(coalesce(sum(v.w * v.w), 0)) AS nrm
       FROM multi m LEFT JOIN sv v ON v.doc_id = m.doc_id AND v.i = m.i GROUP BY m.doc_id, m.i),
sd AS (SELECT a.doc_id, b.i, sum(a.w * b.w) AS dp FROM sv a JOIN sv b
       ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.dim = b.dim GROUP BY a.doc_id, b.i),
step AS (SELECT m.doc_id, m.i, length(m.sentence) AS len,
                CASE WHEN p.nrm = 0 OR c.nrm = 0 THEN {D(0)} ELSE coalesce(sd.dp, {D(0)}) / (p.nrm * c.nrm) END AS sim
         FROM multi m JOIN sn c ON c.doc_id = m.doc_id AND c.i = m.i
         LEFT JOIN sn p ON p.doc_id = m.doc_id AND p.i = m.i - 1
         LEFT JOIN sd ON sd.doc_id = m.doc_id AND sd.i = m.i),
walk AS (
  SELECT doc_id, i, len AS size, 0 AS chunk_no FROM step WHERE i = 1
  UNION ALL
  SELECT w.doc_id, st.i,
         CASE WHEN (st.sim < {D(0.8)} OR w.size + st.len > 1024) AND w.size >= 256 THEN st.len ELSE w.size + st.len END,
         CASE WHEN (st.sim < {D(0.8)} OR w.size + st.len > 1024) AND w.size >= 256 THEN w.chunk_no + 1 ELSE w.chunk_no END
  FROM walk w JOIN step st ON st.doc_id = w.doc_id AND st.i = w.i + 1),
chunks AS (SELECT m.doc_id, m.source, w.chunk_no, string_agg(m.sentence, ' ' ORDER BY m.i) AS chunk_text
           FROM multi m JOIN walk w ON w.doc_id = m.doc_id AND w.i = m.i
           GROUP BY m.doc_id, m.source, w.chunk_no),
allc AS (SELECT * FROM chunks UNION ALL SELECT * FROM single)
SELECT source AS kb_name, CAST(doc_id AS BIGINT) AS doc_id, CAST(chunk_no AS INTEGER) AS chunk_ord,
       CAST(doc_id AS VARCHAR) || '#' || CAST(chunk_no AS VARCHAR) AS chunk_id, chunk_text AS text,
       CAST(length(chunk_text) AS INTEGER) AS chunk_size, 'semantic' AS chunk_strategy
FROM allc"""


NL = "chr(10)"
NL2 = "(chr(10) || chr(10))"


def STRIP(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{WS}]+|[{WS}]+$', '', 'g')"


_PAIRS = """
pairs AS (SELECT u.conv_id, u.turn, u.role, u.text, n.role AS next_role, n.text AS next_text, s.system_text
  FROM conversations u JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 1
  LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS system_text FROM conversations WHERE role = 'system' GROUP BY conv_id) s
    ON s.conv_id = u.conv_id
  WHERE u.role = 'user' AND n.role = 'assistant')"""

SQL["format_instruction"] = f"""
WITH {_PAIRS}
SELECT conv_id, turn,
  CASE WHEN system_text IS NOT NULL AND system_text <> ''
       THEN '### Instruction:' || {NL} || text || {NL2} || '### Input:' || {NL} || system_text || {NL2} || '### Response:' || {NL} || coalesce(next_text, '')
       ELSE '### Instruction:' || {NL} || text || {NL2} || '### Response:' || {NL} || coalesce(next_text, '') END AS text
FROM pairs"""

SQL["format_completion"] = f"""
WITH {_PAIRS}
SELECT conv_id, turn, coalesce(text, '') || coalesce(next_text, '') AS text FROM pairs"""

SQL["format_chat"] = f"""
SELECT conv_id, {STRIP(
    "coalesce(string_agg(CASE WHEN role = 'system' THEN 'System: ' || text || " + NL2 + " END, '' ORDER BY turn DESC), '')"
    " || coalesce(string_agg(CASE WHEN role = 'user' THEN 'Human: ' || text || " + NL2 +
    " WHEN role = 'assistant' THEN 'Assistant: ' || text || " + NL2 + " END, '' ORDER BY turn), '')")} AS text
FROM conversations GROUP BY conv_id"""

SQL["chat_prompt"] = f"""
SELECT conv_id,
  coalesce(string_agg(CASE WHEN role = 'system' THEN 'System: ' || text WHEN role = 'user' THEN 'Human: ' || text
                           WHEN role = 'assistant' THEN 'Assistant: ' || text END, {NL2} ORDER BY turn) || {NL2}, '')
  || 'Assistant:' AS prompt
FROM conversations GROUP BY conv_id"""

SQL["format_classification"] = f"""
SELECT d.doc_id, 'Text: ' || d.text || {NL} || 'Label: ' || CAST(l.quality AS VARCHAR) AS text
FROM documents d JOIN labels l USING (doc_id)"""

SQL["validate_training_set"] = """
SELECT true AS ok, CAST(NULL AS VARCHAR) AS reason, CAST(count(*) AS BIGINT) AS rows
FROM documents d JOIN labels l USING (doc_id)"""

_SPLIT = """
ranked AS (SELECT doc_id, row_number() OVER (
             ORDER BY CAST(('0x' || substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT), doc_id) AS r
           FROM documents),
k AS (SELECT round(count(*) * CAST(0.9 AS DOUBLE)) AS k FROM documents)"""

SQL["train_split"] = f"WITH {_SPLIT} SELECT doc_id FROM ranked, k WHERE r <= k.k"
SQL["eval_split"] = f"WITH {_SPLIT} SELECT doc_id FROM ranked, k WHERE r > k.k"

SQL["pad_truncate"] = f"""
WITH ids AS (SELECT doc_id, list_transform({TOK('text')}, lambda t: CAST(1 + {THASH('t')} % 31999 AS INTEGER)) AS ids
             FROM documents),
p AS (SELECT doc_id, least(len(ids), 128) AS n, list_resize(ids[1:128], 128, 0) AS padded FROM ids)
SELECT doc_id, CAST(n AS INTEGER) AS n_real, array_to_string(padded, ',') AS input_ids,
       array_to_string(list_transform(range(1, 129), lambda i: CASE WHEN i <= n THEN 1 ELSE 0 END), ',') AS attention_mask,
       array_to_string(list_transform(range(1, 129), lambda i: CASE WHEN i <= n THEN padded[i] ELSE -100 END), ',') AS labels
FROM p"""

SQL["calibration_sample"] = f"""
SELECT doc_id, text FROM (
  SELECT doc_id, {STRIP('text')} AS text FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 128))
WHERE text IS NOT NULL AND text <> ''"""


def _case_map(mapping: dict, col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


_EVENT_TASK = {"click": "hellaswag", "view": "arc_easy", "purchase": "gsm8k", "signup": "mmlu",
               "error": "error_rate"}
_EVENT_LOG_KEY = {"click": "train_loss", "view": "eval_accuracy", "purchase": "eval_f1_macro",
                  "signup": "train_runtime", "error": "eval_loss"}

_EV = f"""
ev AS (SELECT event_id, ts, user_id, event_type, value, props,
              'org/model_' || CAST(user_id % 4 AS VARCHAR) AS model,
              {_case_map(_EVENT_TASK, 'event_type')} AS task,
              CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events),
pt AS (SELECT model, task, avg(value) AS value_mean, avg(k) AS k_mean FROM ev GROUP BY model, task),
lng AS (SELECT model, task, 'value_mean' AS metric, value_mean AS value FROM pt
        UNION ALL SELECT model, task, 'k_mean', k_mean FROM pt)"""

SQL["results_flatten"] = f"WITH {_EV} SELECT model, task, metric, round(value, 6) AS value FROM lng"

SQL["results_pivot"] = f"""WITH {_EV}
SELECT model, task, round(k_mean, 6) AS k_mean, round(value_mean, 6) AS value_mean FROM pt"""

SQL["best_performer"] = f"""WITH {_EV}
SELECT task || '_' || metric AS task_metric, split_part(arg_min(model, (-value, model)), '/', -1) AS best_model,
       round(arg_min(value, (-value, model)), 6) AS value
FROM lng GROUP BY task, metric"""

SQL["model_compare"] = f"""WITH {_EV}
SELECT model,
""" + ",\n".join(
    f"  round(max(CASE WHEN task = '{t}' THEN {m} END), 6) AS {t}_{m}"
    for t in ["hellaswag", "arc_easy", "gsm8k", "mmlu"] for m in ["k_mean", "value_mean"]) + """
FROM pt GROUP BY model"""

SQL["results_report"] = f"""WITH {_EV}
SELECT model, task AS Task, metric AS Metric, printf('%.4f', value) AS Value FROM lng"""

SQL["task_categories"] = f"""WITH {_EV}
SELECT DISTINCT task, CASE WHEN task IN ('hellaswag', 'arc_easy', 'arc_challenge', 'winogrande', 'piqa') THEN 'standard'
                  WHEN task IN ('mathqa', 'gsm8k') THEN 'reasoning'
                  WHEN task IN ('mmlu', 'truthfulqa_mc1', 'truthfulqa_mc2') THEN 'knowledge'
                  ELSE 'other' END AS category
FROM pt"""

_SUITES = {
    "standard": ["hellaswag", "arc_easy", "arc_challenge", "winogrande", "piqa"],
    "reasoning": ["hellaswag", "arc_challenge", "winogrande", "mathqa", "gsm8k"],
    "knowledge": ["arc_easy", "arc_challenge", "mmlu", "truthfulqa_mc1", "truthfulqa_mc2"],
    "comprehensive": ["hellaswag", "arc_easy", "arc_challenge", "winogrande", "piqa", "mmlu",
                      "truthfulqa_mc1", "gsm8k"],
}
SQL["suite_expand"] = f"""WITH {_EV},
s(suite, pos, task) AS (VALUES """ + ", ".join(
    f"('{s}', {i}, '{t}')" for s, ts in _SUITES.items() for i, t in enumerate(ts)) + """)
SELECT s.suite, CAST(s.pos AS INTEGER) AS pos, s.task,
       EXISTS (SELECT 1 FROM pt WHERE pt.task = s.task) AS has_results
FROM s"""

SQL["metric_last_value"] = """
SELECT user_id, event_type, value AS last_value, event_id AS last_event_id FROM (
  SELECT user_id, event_type, value, event_id,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r
  FROM events) WHERE r = 1"""

SQL["run_duration"] = """
SELECT user_id, round(epoch(max(ts)) - epoch(min(ts)), 6) AS duration_sec, count(*) AS n_values,
       arg_max(value, (ts, event_id)) AS final_value
FROM events GROUP BY user_id"""

SQL["latency_stats"] = f"""WITH {_EV}
SELECT model, round(avg(value), 6) AS avg_time, round(min(value), 6) AS min_time, round(max(value), 6) AS max_time,
       round(avg(CASE WHEN value > 0 THEN k / value ELSE {D(0)} END), 6) AS avg_tokens_per_second,
       CAST(count(*) AS BIGINT) AS runs
FROM ev GROUP BY model"""

SQL["log_regex_metrics"] = f"""
WITH l AS (SELECT user_id AS run, ts, event_id,
                  '{{''' || {_case_map(_EVENT_LOG_KEY, 'event_type')} || ''': ' || CAST(value AS VARCHAR)
                  || ', ''step'': ' || CAST(event_id AS VARCHAR) || '}}' AS line FROM events),
x AS (SELECT run, ts, event_id, """ + ", ".join(
    f"CAST(nullif(regexp_extract(line, '''{m}'':\\s*([\\d.]+)', 1), '') AS DOUBLE) AS {m}"
    for m in ["train_loss", "train_runtime", "eval_accuracy", "eval_f1_macro", "eval_loss"]) + """ FROM l)
SELECT run,
  arg_min(train_loss, (ts, event_id)) FILTER (WHERE train_loss IS NOT NULL) AS final_train_loss,
  arg_min(train_runtime, (ts, event_id)) FILTER (WHERE train_runtime IS NOT NULL) AS train_runtime,
  arg_max(eval_accuracy, (ts, event_id)) FILTER (WHERE eval_accuracy IS NOT NULL) AS eval_accuracy,
  arg_max(eval_f1_macro, (ts, event_id)) FILTER (WHERE eval_f1_macro IS NOT NULL) AS eval_f1_macro,
  arg_max(eval_loss, (ts, event_id)) FILTER (WHERE eval_loss IS NOT NULL) AS eval_loss
FROM x GROUP BY run"""


# ------------------------------------------------------------- evaluation

def JUDGE(stmt: str, refset: str) -> str:
    toks = f"list_distinct({TOK(stmt)})"
    return (f"(CASE WHEN len({toks}) = 0 THEN NULL ELSE "
            f"CAST(len(list_intersect({toks}, {refset})) AS DOUBLE) / len({toks}) >= {D(0.5)} END)")


def MEANBOOL(lst: str) -> str:
    return (f"list_avg(list_transform(list_filter({lst}, lambda b: b IS NOT NULL), "
            f"lambda b: CASE WHEN b THEN {D(1)} ELSE {D(0)} END))")


CTXSET = f"list_distinct(flatten(list_transform(contexts, lambda c: {TOK('c')})))"
GTTEXT = "(CASE WHEN len(gts) > 0 THEN array_to_string(gts, ' ') END)"


def _cos_ctes(prefix: str, src: str, keys: list[str], a: str, b: str) -> str:
    """Hashed-vector cosine of two text columns of ``src`` per key."""
    k = ", ".join(keys)
    parts = []
    for side, col in (("a", a), ("b", b)):
        parts.append(f"""
{prefix}{side}h AS (SELECT {k}, h % 64 AS dim, CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END AS sg
    FROM (SELECT {k}, {THASH('t')} AS h FROM (SELECT {k}, unnest({TOK(col)}) AS t FROM {src}))),
{prefix}{side}v AS (SELECT {k}, dim, CAST(sum(sg) AS DOUBLE) AS w FROM {prefix}{side}h GROUP BY {k}, dim),
{prefix}{side}n AS (SELECT {", ".join('s.' + x for x in keys)}, sqrt(coalesce(sum(v.w * v.w), 0)) AS nrm
    FROM {src} s LEFT JOIN {prefix}{side}v v USING ({k}) GROUP BY {", ".join('s.' + x for x in keys)})""")
    on = " AND ".join(f"x.{c} = y.{c}" for c in keys)
    parts.append(f"""
{prefix}dp AS (SELECT {", ".join('x.' + c for c in keys)}, sum(x.w * y.w) AS dp
    FROM {prefix}av x JOIN {prefix}bv y ON {on} AND x.dim = y.dim GROUP BY {", ".join('x.' + c for c in keys)}),
{prefix} AS (SELECT {", ".join('x.' + c for c in keys)},
    CASE WHEN x.nrm = 0 OR y.nrm = 0 THEN {D(0)} ELSE coalesce(d.dp, {D(0)}) / (x.nrm * y.nrm) END AS cos
    FROM {prefix}an x JOIN {prefix}bn y ON {on} LEFT JOIN {prefix}dp d ON {on.replace('y.', 'd.')})""")
    return ",".join(parts)


def _eval_rows_ctes(grouped: bool) -> str:
    part = "d.source, s.query_id" if grouped else "s.query_id"
    kb_sel = "r.source AS kb_name, " if grouped else ""
    kb_grp = "r.source, " if grouped else ""
    grid = ("(SELECT DISTINCT source AS kb_name FROM documents) g CROSS JOIN benchmark b "
            "LEFT JOIN ctx c ON c.kb_name = g.kb_name AND c.query_id = b.item_id") if grouped else \
        "benchmark b LEFT JOIN ctx c ON c.query_id = b.item_id"
    return f"""{_bm25_ctes()}, {_hash_ctes()},
sem_rank AS (SELECT {part.replace('s.', '').replace('d.', '')}, doc_id, rank FROM (
    SELECT {part}, s.doc_id, row_number() OVER (PARTITION BY {part} ORDER BY round(s.semantic, 6) DESC, s.doc_id) AS rank
    FROM sem_all s JOIN documents d ON d.doc_id = s.doc_id) WHERE rank <= 5),
ctx AS (SELECT {kb_sel}r.query_id, list(d.text ORDER BY r.rank) AS contexts
        FROM sem_rank r JOIN documents d ON d.doc_id = r.doc_id GROUP BY {kb_grp}r.query_id),
rows AS (SELECT {'g.kb_name, ' if grouped else ''}b.item_id AS question_id, b.text AS question,
         CASE WHEN c.contexts IS NULL THEN 'Error generating answer'
              ELSE 'Based on the context: ' || substr(c.contexts[1], 1, 200) || '...' END AS answer,
         coalesce(c.contexts, ['No context retrieved']) AS contexts, [b.text] AS gts
         FROM {grid})"""


_M_FAITH = MEANBOOL(f"list_transform({SENTS('answer')}, lambda s: {JUDGE('s', CTXSET)})")
_M_RECALL = f"(CASE WHEN {GTTEXT} IS NULL THEN NULL ELSE {MEANBOOL(f'list_transform({SENTS(GTTEXT)}, lambda s: {JUDGE(chr(115), CTXSET)})')} END)"
_RT = f"list_distinct({TOK(f'coalesce({GTTEXT}, answer)')})"
_HITS = (f"list_transform(contexts, lambda c: CASE WHEN coalesce(CASE WHEN len({_RT}) = 0 THEN NULL ELSE "
         f"CAST(len(list_intersect({_RT}, list_distinct({TOK('c')}))) AS DOUBLE) / len({_RT}) END >= {D(0.5)}, false) "
         f"THEN {D(1)} ELSE {D(0)} END)")
_M_PREC = (f"(SELECT CASE WHEN list_sum(hh) = 0 THEN {D(0)} ELSE list_sum(list_transform(generate_series(1, len(hh)), "
           f"lambda i: hh[i] * list_sum(hh[1:i]) / i)) / list_sum(hh) END FROM (SELECT {_HITS} AS hh))")


def _correct_f1() -> str:
    ans_set = f"list_distinct({TOK('answer')})"
    gt_set = f"list_distinct({TOK(GTTEXT)})"
    claims = f"list_filter(list_transform({SENTS('answer')}, lambda s: {JUDGE('s', gt_set)}), lambda b: b IS NOT NULL)"
    stmts = f"list_filter(list_transform({SENTS(GTTEXT)}, lambda s: {JUDGE('s', ans_set)}), lambda b: b IS NOT NULL)"
    return f"""(SELECT CASE WHEN tp + {D(0.5)} * (fp + fn) = 0 THEN {D(0)} ELSE tp / (tp + {D(0.5)} * (fp + fn)) END
     FROM (SELECT len(list_filter(cl, lambda b: b)) AS tp, len(cl) - len(list_filter(cl, lambda b: b)) AS fp,
                  len(list_filter(st, lambda b: NOT b)) AS fn
           FROM (SELECT {claims} AS cl, {stmts} AS st)))"""


def _metric_sql(metric: str, grouped: bool = False) -> str:
    keys = (["kb_name"] if grouped else []) + ["question_id"]
    base = f"WITH {_eval_rows_ctes(grouped)}"
    sel_keys = ", ".join(f"r.{k}" for k in keys)
    if metric in ("faithfulness", "context_recall", "context_precision"):
        expr = {"faithfulness": _M_FAITH, "context_recall": _M_RECALL, "context_precision": _M_PREC}[metric]
        return f"{base}\nSELECT {sel_keys}, {expr} AS value FROM rows r"
    if metric == "answer_relevancy":
        return f"""{base}, {_cos_ctes('rel', 'rows', keys, 'question', 'answer')}
SELECT {sel_keys}, c.cos AS value FROM rows r JOIN rel c USING ({", ".join(keys)})"""
    sim = f"{base}, {_cos_ctes('sim', 'rows', keys, 'answer', GTTEXT)}"
    if metric == "answer_similarity":
        return f"""{sim}
SELECT {sel_keys}, CASE WHEN {GTTEXT.replace('gts', 'r.gts')} IS NULL THEN NULL ELSE c.cos END AS value
FROM rows r JOIN sim c USING ({", ".join(keys)})"""
    # answer_correctness
    return f"""{sim}
SELECT {sel_keys}, CASE WHEN {GTTEXT} IS NULL THEN NULL
       ELSE {D(0.75)} * {_correct_f1()} + {D(0.25)} * c.cos END AS value
FROM rows r JOIN sim c USING ({", ".join(keys)})"""


for _m in ["faithfulness", "context_precision", "context_recall", "answer_similarity",
           "answer_relevancy", "answer_correctness"]:
    SQL[_m] = f"SELECT question_id, round(value, 6) AS {_m} FROM ({_metric_sql(_m)})"

SQL["eval_dataset"] = f"""WITH {_eval_rows_ctes(False)}
SELECT question_id, answer, CAST(len(contexts) AS INTEGER) AS n_contexts,
       array_to_string(contexts, {NL2}) AS contexts FROM rows"""

_CMP = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]
def EXACT_MEAN(v: str) -> str:
    """Order-independent mean rounded half-up to 6 places (integer arithmetic)."""
    q = f"CAST(round({v} * CAST(1000000000000 AS DOUBLE)) AS BIGINT)"
    num = f"(sum({q}) * 2 + count({q}) * 1000000)"
    den = f"(count({q}) * 2000000)"
    return (f"(CASE WHEN count({q}) > 0 THEN CAST(({num} - ((({num}) % {den}) + {den}) % {den}) // {den} AS DOUBLE)"
            f" / CAST(1000000 AS DOUBLE) END)")


_KB_MEANS = "kbm AS (" + " UNION ALL ".join(
    f"SELECT kb_name, '{m}' AS metric, {EXACT_MEAN('CASE WHEN isnan(value) THEN NULL ELSE value END')} AS score "
    f"FROM ({_metric_sql(m, True)}) GROUP BY kb_name" for m in _CMP) + ")"

SQL["kb_compare_pivot"] = f"WITH {_KB_MEANS}\nSELECT kb_name, " + ", ".join(
    f"round(max(CASE WHEN metric = '{m}' THEN score END), 3) AS {m}" for m in _CMP) + " FROM kbm GROUP BY kb_name"

SQL["kb_best_per_metric"] = f"""WITH {_KB_MEANS}
SELECT metric, arg_min(kb_name, (-score, kb_name)) AS best_kb, round(max(score), 6) AS best_score
FROM kbm GROUP BY metric"""

SQL["kb_overall_best"] = f"""WITH {_KB_MEANS},
rm AS (SELECT kb_name, {EXACT_MEAN('score')} AS mean_score FROM kbm GROUP BY kb_name)
SELECT arg_min(kb_name, (-mean_score, kb_name)) AS best_kb, round(max(mean_score), 6) AS best_mean FROM rm"""


def LABEL(x: str) -> str:
    return (f"CASE WHEN {x} >= {D(0.9)} THEN '🟢 Excellent' WHEN {x} >= {D(0.8)} THEN '🟡 Good' "
            f"WHEN {x} >= {D(0.7)} THEN '🟠 Fair' ELSE '🔴 Needs Improvement' END")


_MORD = "mo(metric, metric_ord) AS (VALUES " + ", ".join(f"('{m}', {i})" for i, m in enumerate(_CMP)) + ")"
SQL["eval_summary"] = f"""WITH {_KB_MEANS}, {_MORD}
SELECT kb_name, round({EXACT_MEAN('score')}, 6) AS avg_score, {LABEL(EXACT_MEAN('score'))} AS overall_label,
       arg_min(metric, (-score, metric_ord)) AS best_metric, round(max(score), 6) AS best_score,
       arg_min(metric, (score, metric_ord)) AS worst_metric, round(min(score), 6) AS worst_score
FROM kbm JOIN mo USING (metric) GROUP BY kb_name"""

_INTERP = {
    "context_precision": "Signal-to-noise ratio of retrieved context",
    "context_recall": "Coverage of relevant information in retrieved context",
    "faithfulness": "Factual accuracy of generated answers",
    "answer_relevancy": "Relevance of answers to questions",
    "answer_correctness": "Overall correctness of answers",
    "answer_similarity": "Semantic similarity to ground truth",
}
SQL["eval_labels"] = f"""WITH {_KB_MEANS}
SELECT kb_name, metric, round(score, 6) AS score, {LABEL('score')} AS label,
       CASE """ + " ".join(f"WHEN metric = '{m}' THEN '{' '.join(w.capitalize() for w in m.split('_'))}'"
                           for m in _CMP) + """ END AS title,
       CASE """ + " ".join(f"WHEN metric = '{m}' THEN '{v}'" for m, v in _INTERP.items()) + """ ELSE '' END AS description
FROM kbm"""

_RECS = [
    ("context_precision", 0.7, "🔍 **Improve Retrieval Precision**: Consider tuning chunk size, using hybrid search, or improving query preprocessing"),
    ("context_recall", 0.7, "📚 **Improve Context Coverage**: Increase retrieved documents count or improve chunking strategy"),
    ("faithfulness", 0.8, "✅ **Improve Answer Faithfulness**: Fine-tune LLM prompts or use better instruction-following models"),
    ("answer_relevancy", 0.8, "🎯 **Improve Answer Relevancy**: Optimize prompts to ensure answers directly address questions"),
]
SQL["eval_recommendations"] = f"""WITH {_KB_MEANS},
w AS (SELECT kb_name, """ + ", ".join(
    f"max(CASE WHEN metric = '{m}' THEN score END) AS {m}" for m in _CMP) + """ FROM kbm GROUP BY kb_name),
r AS (SELECT kb_name, list_filter([""" + ", ".join(
    f"CASE WHEN coalesce({m}, {D(1)}) < {D(t)} THEN '{txt}' END" for m, t, txt in _RECS) + """], lambda x: x IS NOT NULL) AS recs FROM w)
SELECT kb_name, CASE WHEN len(recs) = 0 THEN '🎉 **Excellent Performance**: Your RAG pipeline is performing well across all metrics!'
       ELSE array_to_string(recs, chr(10)) END AS recommendations FROM r"""

SQL["retrieval_hit_mrr_ndcg"] = f"""
WITH el AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos,
                   CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cen AS (SELECT label AS qlabel, pos, avg(x) AS c FROM el GROUP BY label, pos),
cn AS (SELECT qlabel, sqrt(sum(c * c)) AS nrm FROM cen GROUP BY qlabel),
en AS (SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM el GROUP BY vec_id),
dp AS (SELECT c.qlabel, e.vec_id, sum(c.c * e.x) AS dp FROM cen c JOIN el e USING (pos) GROUP BY c.qlabel, e.vec_id),
sc AS (SELECT dp.qlabel AS label, dp.vec_id,
              CASE WHEN cn.nrm = 0 OR en.nrm = 0 THEN {D(0)} ELSE dp.dp / (cn.nrm * en.nrm) END AS score
       FROM dp JOIN cn USING (qlabel) JOIN en USING (vec_id)),
rk AS ({_topk('sc', 10, part='label', oid='vec_id')}),
fl AS (SELECT rk.label, rk.rank, CASE WHEN e.label = rk.label THEN 1 ELSE 0 END AS rel
       FROM rk JOIN embeddings e ON e.vec_id = rk.vec_id),
nr AS (SELECT label, count(*) AS n_rel FROM embeddings GROUP BY label),
pq AS (SELECT label, max(rel) AS hit, coalesce(max(CASE WHEN rel = 1 THEN {D(1)} / rank END), {D(0)}) AS rr,
              sum(rel / log2(rank + 1)) AS dcg, sum(rel) AS n_hit FROM fl GROUP BY label)
SELECT pq.label, round(CAST(hit AS DOUBLE), 6) AS hit_at_k, round(rr, 6) AS mrr,
       round(CASE WHEN coalesce(n_rel, 0) = 0 THEN {D(0)} ELSE dcg / (SELECT sum({D(1)} / log2(i + 1)) FROM range(1, least(n_rel, 10) + 1) t(i)) END, 6) AS ndcg_at_k,
       round(CASE WHEN coalesce(n_rel, 0) = 0 THEN {D(0)} ELSE CAST(n_hit AS DOUBLE) / n_rel END, 6) AS recall_at_k
FROM pq LEFT JOIN nr USING (label)"""


# ---------------------------------------------------------------- clean-up

S_ = f"[{WS}]"


def UNESC(x: str) -> str:
    for a, b in (("\\n", "chr(10)"), ("\\r", "chr(13)"), ("\\t", "chr(9)"), ('\\"', "'\"'"),
                 ("\\'", "''''"), ("\\\\", "chr(92)")):
        x = f"replace({x}, '{a.replace(chr(39), chr(39) * 2)}', {b})"
    return f"regexp_replace({x}, '\\\\([^\\n])', '\\1', 'g')"


def RR(x: str, pat: str, rep: str) -> str:
    return f"regexp_replace({x}, '{pat}', {rep}, 'g')"


SQL["clean_flat"] = f"""
SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN '' ELSE
  {STRIP(RR(RR(UNESC('html'), S_ + '+', "' '"), '\\n' + S_ + '*\\n' + S_ + '*\\n+', NL2))} END AS text FROM pages"""

SQL["clean_lines"] = f"""
SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN '' ELSE
  {STRIP(RR(RR(UNESC('text'), ' +', "' '"), '\\n' + S_ + '*\\n' + S_ + '*\\n+', NL2))} END AS text FROM documents"""

SQL["strip_code"] = f"""
SELECT page_id, {STRIP(RR("replace(" + RR('html', '(?s)```.*?```', "''") + ", '`', '')", '\\n' + S_ + '*\\n', NL2))} AS text FROM pages"""

_R = RR('text', '(?s)<think>.*?</think>', "''")
_R = RR(_R, '(?s)```.*?```', "''")
_R = f"replace({_R}, '`', '')"
_R = RR(_R, '(?s)Begin! This is VERY important.*?depends on it!', "''")
_R = RR(_R, 'Thought:[^\\n]*?\\n', "''")
_R = RR(_R, '\\n' + S_ + '*\\n', NL2)
SQL["strip_reasoning"] = f"SELECT doc_id, {STRIP(_R)} AS text FROM documents"

SQL["cut_at_marker"] = f"""
SELECT doc_id, CASE WHEN contains(text, 'Character count:') THEN
  {STRIP("array_to_string(CASE WHEN coalesce(list_position(list_transform(string_split(text, chr(10)), lambda l: contains(l, 'Character count:') OR contains(l, '---')), true), 0) = 0 THEN string_split(text, chr(10)) ELSE string_split(text, chr(10))[1:list_position(list_transform(string_split(text, chr(10)), lambda l: contains(l, 'Character count:') OR contains(l, '---')), true) - 1] END, chr(10))")}
  ELSE text END AS text FROM documents"""

_P = "c"
for _a in ("# ", "## ", "### ", "* ", "- ", "1. ", "2. ", "3. "):
    _P = f"replace({_P}, '{_a}', chr(10) || '{_a}')"
_P = f"replace({_P}, '```', chr(10) || '```' || chr(10))"
_P = RR(_P, '(\\p{Nd}+\\.' + S_ + ')', "chr(10) || '\\1'")
_P = RR(_P, '(\\.' + S_ + '+)([A-Z])', "'\\1' || chr(10) || '\\2'")
_P = RR(_P, '\\n' + S_ + '*\\n' + S_ + '*\\n', NL2)
_P = RR(_P, '^\\n+', "''")
SQL["paragraphise"] = f"""
SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'No content'
  WHEN contains(c, chr(10)) AND len(string_split(c, chr(10))) > 3 THEN c ELSE {_P} END AS text
FROM (SELECT doc_id, text, {STRIP('text')} AS c FROM documents)"""


def _links(x: str) -> str:
    x = RR(x, '<a name="[^"]*"></a> \\[([^\\]]+)\\]\\([^)]+\\)', "'\\1'")
    return RR(x, '\\[([^\\]]+)\\]\\([^)]+\\)', "'\\1'")


_CELLS0 = f"list_transform(string_split({_links('l')}, '|'), lambda z: {STRIP('z')})"
_CELLS1 = f"(CASE WHEN ({_CELLS0})[1] = '' THEN ({_CELLS0})[2:] ELSE {_CELLS0} END)"
_CELLS = f"(CASE WHEN len({_CELLS1}) > 0 AND ({_CELLS1})[-1] = '' THEN ({_CELLS1})[1:len({_CELLS1}) - 1] ELSE {_CELLS1} END)"
_IS_TABLE = "(contains(l, '|') AND length(l) - length(replace(l, '|', '')) >= 2)"

SQL["markdown_table_rows"] = f"""
WITH lines AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS l
               FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda y: {STRIP('y')}) AS ls FROM documents)),
c AS (SELECT doc_id, line_no, {_CELLS} AS cells FROM lines WHERE {_IS_TABLE}),
r AS (SELECT doc_id, line_no, cells[1] AS name,
             {STRIP("array_to_string(cells[2:greatest(len(cells), 1)], ' ')")} AS description, len(cells) AS n FROM c)
SELECT doc_id, line_no, name, description, lower(name) IN ('name', 'description', 'type', 'default', 'required') AS is_header
FROM r WHERE n >= 2 AND NOT starts_with(name, '---') AND NOT starts_with(description, '---')"""


def _fmt_line(l: str) -> str:
    cells = _CELLS
    desc = STRIP(f"array_to_string(({cells})[2:greatest(len({cells}), 1)], ' ')")
    name = f"({cells})[1]"
    return f"""(CASE WHEN {l} = '' THEN ''
  WHEN {_IS_TABLE} THEN (CASE WHEN len({cells}) >= 2 AND NOT starts_with({name}, '---') AND NOT starts_with({desc}, '---')
      THEN CASE WHEN lower({name}) IN ('name', 'description', 'type', 'default', 'required')
                THEN '**' || {name} || '** | **' || {desc} || '**'
                ELSE '• **' || {name} || '**: ' || {desc} END END)
  WHEN starts_with({l}, '## ') THEN chr(10) || '🔷 **' || {l}[4:] || '**'
  WHEN starts_with({l}, '### ') THEN chr(10) || '📋 **' || {l}[5:] || '**'
  WHEN starts_with({l}, '# ') THEN chr(10) || '🏗️ **' || {l}[3:] || '**'
  WHEN starts_with({l}, '- ') OR starts_with({l}, '* ') OR regexp_matches({l}, '^\\p{{Nd}}+\\. ') THEN '  ' || {l}
  WHEN starts_with({l}, 'moduleID:') OR starts_with({l}, 'Name:') OR starts_with({l}, 'Description:') THEN '**' || {l} || '**'
  WHEN starts_with({l}, 'Downloads:') OR starts_with({l}, 'Published:') OR starts_with({l}, 'Verified:') THEN '  📊 ' || {l}
  WHEN starts_with({l}, 'Source:') OR starts_with({l}, 'Version:') THEN '  🔗 ' || {l}
  WHEN starts_with({l}, '```') THEN {l}
  ELSE {_links(l)} END)"""


SQL["markdown_format"] = f"""
WITH p AS (SELECT doc_id, text, replace(replace({STRIP('text')}, '\\n', chr(10)), '\\t', '  ') AS c FROM documents),
f AS (SELECT doc_id, text, list_filter(list_transform(list_transform(string_split(c, chr(10)), lambda y: {STRIP('y')}),
             lambda l: {_fmt_line('l')}), lambda x: x IS NOT NULL) AS out FROM p),
j AS (SELECT doc_id, text, string_split({RR("array_to_string(out, chr(10))", '\\n' + S_ + '*\\n' + S_ + '*\\n+', NL2)}, chr(10)) AS al FROM f)
SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'No content available'
  WHEN len(al) > 100 THEN array_to_string(al[1:100] || [chr(10) || '... (output truncated for readability)',
       '📊 Total: ' || CAST(len(al) AS VARCHAR) || ' lines, showing first 100'], chr(10))
  ELSE array_to_string(al, chr(10)) END AS text FROM j"""

SQL["json_props_flatten"] = """
SELECT event_id, CASE WHEN json_valid(props) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
       CASE WHEN json_valid(props) THEN NULL ELSE props END AS raw_text FROM events"""

SQL["summarise_json"] = """
SELECT event_id, CASE WHEN len(ks) <= 3 THEN array_to_string(list_transform(ks, lambda kk: kk || ': ' || json_extract_string(props, '$.' || kk)), ' | ')
  ELSE NULL END AS summary
FROM (SELECT event_id, props, json_keys(props) AS ks FROM events)"""

_ISO = "strftime(ts, '%Y-%m-%d')"
SQL["repo_flatten"] = f"""
SELECT event_id, 1 AS total_count, 1 AS item_no, 'org/repo_' || CAST(event_id AS VARCHAR) AS name,
  CASE WHEN event_type = 'error' THEN 'No description' ELSE 'Event ' || event_type END AS description,
  CASE WHEN event_type = 'view' THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS stars,
  CAST(user_id AS INTEGER) AS forks, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS language,
  {_ISO} AS updated, event_type <> 'view' AS has_details, 'https://example.com/' || CAST(event_id AS VARCHAR) AS url
FROM events"""

SQL["issue_flatten"] = f"""
SELECT event_id, CAST(event_id AS VARCHAR) AS number, 'Issue ' || CAST(event_id AS VARCHAR) AS title,
  CASE WHEN value <= 100 THEN 'open' ELSE 'closed' END AS state, 'user' || CAST(user_id AS VARCHAR) AS user,
  {_ISO} AS created, 'https://example.com/i/' || CAST(event_id AS VARCHAR) AS url, value <= 100 AS is_open
FROM events"""

SQL["pr_flatten"] = f"""
SELECT event_id, CAST(event_id AS VARCHAR) AS number, 'Issue ' || CAST(event_id AS VARCHAR) AS title,
  CASE WHEN event_type = 'signup' THEN 'unknown' WHEN value < 100 THEN 'open' ELSE 'closed' END AS state,
  'user' || CAST(user_id AS VARCHAR) AS user, {_ISO} AS created, event_type AS head, 'main' AS base,
  event_type = 'view' AS draft,
  CASE WHEN event_type = 'signup' THEN 'unknown' WHEN value < 100 THEN (CASE WHEN event_type = 'view' THEN 'draft' ELSE 'open' END)
       ELSE (CASE WHEN event_type = 'purchase' THEN 'merged' ELSE 'closed' END) END AS status
FROM events"""


# ------------------------------------------------------ query answers, KBs

_RERANKED = f"""WITH {_bm25_ctes()}, {_hash_ctes()}, {_hybrid(0.5)},
first AS ({_topk('hy', 20)}),
qd AS (SELECT query_id, list_distinct(qtoks) AS qd FROM qtok),
rr AS (SELECT f.query_id, f.doc_id, f.rank AS rank1,
              round(CASE WHEN len(qd.qd) = 0 THEN {D(0)} ELSE
                    CAST(len(list_intersect(qd.qd, list_distinct({TOK('d.text')}))) AS DOUBLE) / len(qd.qd) END, 6) AS score
       FROM first f JOIN qd USING (query_id) JOIN documents d ON d.doc_id = f.doc_id),
top AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank1) AS rank FROM rr)
  WHERE rank <= 5),
ans AS (SELECT t.query_id AS question_id, t.rank, t.doc_id, t.score AS relevance_score, d.text AS content
        FROM top t JOIN documents d ON d.doc_id = t.doc_id)"""

SQL["query_result_nested"] = f"""{_RERANKED}
SELECT question_id, rank, doc_id, relevance_score, content, 'all' AS kb_name, 5 AS top_k,
       'Hybrid Search (α=0.5) + Cross-Encoder Reranking (cross-encoder/ms-marco-MiniLM-L-12-v2)' AS search_method
FROM ans"""

SQL["rag_prompt"] = f"""{_RERANKED},
pc AS (SELECT question_id, list(content ORDER BY rank) AS ctx FROM ans GROUP BY question_id)
SELECT pc.question_id,
  'Based on the following context, answer the question.' || {NL2} || 'Context:' || {NL} || array_to_string(ctx, {NL2})
  || {NL2} || 'Question: ' || b.text || {NL2} || 'Answer:' AS prompt,
  substr(ctx[1], 1, 200) || '...' AS answer
FROM pc JOIN benchmark b ON b.item_id = pc.question_id"""

_TOKCHUNKS = f"""tc AS (SELECT doc_id, source AS kb_name, len(toks) AS n,
  CASE WHEN len(toks) = 0 THEN 0 ELSE CAST(greatest(0, ceil((len(toks) - 512) / CAST(462 AS DOUBLE))) AS BIGINT) + 1 END AS n_chunks
  FROM (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '[{WS}]+'), lambda x: x <> '') AS toks FROM documents))"""

SQL["ingest_counts"] = f"""WITH {_TOKCHUNKS}
SELECT kb_name, CAST(count(*) AS BIGINT) AS documents_processed, CAST(sum(n_chunks) AS BIGINT) AS chunks_created,
       CAST(count(DISTINCT CASE WHEN n_chunks > 0 THEN doc_id END) AS BIGINT) AS total_documents
FROM tc GROUP BY kb_name"""

SQL["kb_stats"] = f"""WITH {_TOKCHUNKS}
SELECT kb_name AS name, 'sentence-transformers/all-MiniLM-L6-v2' AS embedding_model, CAST(512 AS INTEGER) AS chunk_size,
       CAST(50 AS INTEGER) AS chunk_overlap, 'token' AS chunking_strategy, 'chroma' AS vector_store,
       CAST(count(DISTINCT CASE WHEN n_chunks > 0 THEN doc_id END) AS BIGINT) AS document_count,
       CAST(sum(n_chunks) AS BIGINT) AS chunk_count
FROM tc GROUP BY kb_name"""


SQL["retrieval_compare"] = f"""WITH {_bm25_ctes()}, {_hash_ctes()},
a AS ({_topk('(SELECT query_id, doc_id, bm25 AS score FROM bm_all)', 5)}),
b AS ({_topk('(SELECT query_id, doc_id, semantic AS score FROM sem_all)', 5)}),
j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.rank AS rank_a, b.rank AS rank_b
      FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id)
SELECT query_id, CAST(sum(CASE WHEN rank_a IS NOT NULL AND rank_b IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS overlap,
       round(CAST(sum(CASE WHEN rank_a IS NOT NULL AND rank_b IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS jaccard,
       round(avg(CASE WHEN rank_a IS NOT NULL AND rank_b IS NOT NULL THEN abs(rank_a - rank_b) END), 6) AS mean_rank_delta
FROM j GROUP BY query_id"""

_DEFQ = "(SELECT CAST(item_id AS BIGINT) AS item_id, text FROM (VALUES " + ", ".join(
    "({}, '{}')".format(i, q.replace("'", "''")) for i, q in enumerate([
        "What is the main topic discussed in the documents?",
        "What are the key features mentioned?",
        "How does this work?",
        "What are the benefits?",
        "What are the requirements?",
        "How do you get started?",
        "What are the best practices?",
        "What should you avoid?",
        "Who is the target audience?",
        "What are the next steps?"])) + ") dq(item_id, text))"
SQL["default_question_retrieval"] = f"""WITH {_bm25_ctes(qsrc=_DEFQ)}, {_hash_ctes()}
{_topk('(SELECT query_id, doc_id, semantic AS score FROM sem_all)', 3)}"""


# ---------------------------------------------------------------- streaming

SQL["stream_ingest"] = SQL["chunk_token_window"]

SQL["stream_metrics"] = """
SELECT event_type AS name, value,
       CAST(trunc((epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) / 1000000) AS BIGINT) AS step
FROM events WHERE value IS NOT NULL"""

_TITLE = "CASE " + " ".join(
    f"WHEN metric = '{m}' THEN '{' '.join(w.capitalize() for w in m.split('_'))}'" for m in _CMP) + " END"
_DESC = "CASE " + " ".join(f"WHEN metric = '{m}' THEN '{v}'" for m, v in _INTERP.items()) + " ELSE '' END"
SQL["eval_report"] = f"""WITH {_KB_MEANS}, {_MORD},
sec AS (SELECT kb_name, metric, score, metric_ord,
          '### ' || {_TITLE} || chr(10) || '- **Score**: ' || printf('%.3f', score) || ' ' || {LABEL('score')}
          || chr(10) || '- **Description**: ' || {_DESC} || {NL2} AS s
        FROM kbm JOIN mo USING (metric)),
agg AS (SELECT kb_name, string_agg(s, '' ORDER BY metric_ord) AS sections, {EXACT_MEAN('score')} AS av,
               arg_min(metric, (-score, metric_ord)) AS best, max(score) AS best_score,
               arg_min(metric, (score, metric_ord)) AS worst, min(score) AS worst_score,
               """ + ", ".join(f"max(CASE WHEN metric = '{m}' THEN score END) AS {m}" for m in _CMP) + """
        FROM sec GROUP BY kb_name),
rc AS (SELECT *, list_filter([""" + ", ".join(
    f"CASE WHEN coalesce({m}, {D(1)}) < {D(t)} THEN '{txt}' END" for m, t, txt in _RECS) + f"""], lambda x: x IS NOT NULL) AS recs FROM agg),
nq AS (SELECT count(*) AS n FROM benchmark)
SELECT kb_name,
  '# RAG Evaluation Report' || {NL2} || '## 📊 Overview' || chr(10) || '- **Knowledge Base**: ' || kb_name || chr(10)
  || '- **Test Questions**: ' || CAST(nq.n AS VARCHAR) || chr(10) || '- **Evaluation Time**: 0.00 seconds' || chr(10)
  || '- **Timestamp**: 1970-01-01T00:00:00' || {NL2} || '## 🎯 RAGAS Metrics Scores' || {NL2} || sections
  || '## 📈 Overall Assessment' || chr(10) || '- **Average Score**: ' || printf('%.3f', av) || ' ' || {LABEL('av')} || chr(10)
  || '- **Best Metric**: ' || best || ' (' || printf('%.3f', best_score) || ')' || chr(10)
  || '- **Needs Improvement**: ' || worst || ' (' || printf('%.3f', worst_score) || ')' || {NL2}
  || '## 💡 Recommendations' || {NL2}
  || CASE WHEN len(recs) = 0 THEN '- 🎉 **Excellent Performance**: Your RAG pipeline is performing well across all metrics!' || chr(10)
          ELSE array_to_string(list_transform(recs, lambda r: '- ' || r || chr(10)), '') END
  || {NL2} || '## 🔧 Next Steps' || chr(10) || '1. **Review detailed results** in the exported CSV file' || chr(10)
  || '2. **Implement recommended improvements**' || chr(10) || '3. **Re-evaluate** to measure progress' || chr(10)
  || '4. **A/B test** different configurations' || {NL2} || '---' || chr(10) || '*Generated by sifter RAG evaluation*' || chr(10) AS report
FROM rc, nq"""


# ------------------------------------------------- small projections (H, L, D)

_LM_BASE = SQL["log_regex_metrics"]
SQL["logging_metrics"] = f"""WITH base AS ({_LM_BASE})
SELECT run, final_train_loss, eval_accuracy AS overall_accuracy,
  CASE WHEN eval_accuracy IS NOT NULL THEN coalesce(eval_loss, {D(0)}) END AS eval_loss,
  CASE WHEN eval_accuracy IS NOT NULL THEN coalesce(eval_f1_macro, {D(0)}) END AS eval_f1_macro,
  CASE WHEN train_runtime IS NOT NULL THEN coalesce(train_runtime, {D(0)}) END AS train_runtime,
  CASE WHEN train_runtime IS NOT NULL THEN {D(0)} END AS train_samples_per_second
FROM base"""

SQL["results_config_info"] = f"""WITH {_EV}
SELECT DISTINCT model, 'model' AS key, CAST(NULL AS DOUBLE) AS value_num, model AS value_text FROM ev"""

SQL["metric_paths"] = f"""WITH {_EV}
SELECT model, 'eval/' || task || '/' || metric AS path, round(value, 6) AS value FROM lng"""

SQL["distinct_tasks_metrics"] = f"""WITH {_EV}
SELECT DISTINCT 'task' AS kind, task AS name FROM lng
UNION ALL SELECT DISTINCT 'metric', metric FROM lng"""

SQL["inference_prompt"] = f"""
SELECT conv_id, turn, task_type,
  CASE WHEN task_type = 'instruction_following' THEN '### Instruction:' || {NL} || text || {NL2} || '### Response:' || {NL}
       WHEN task_type = 'chat' THEN 'Human: ' || text || {NL2} || 'Assistant: ' ELSE text END AS prompt
FROM conversations, (VALUES ('instruction_following'), ('chat'), ('completion')) t(task_type)
WHERE role = 'user'"""

from sifter.functions.formatting import ANSWER_PROMPT, GRADE_PROMPT, REWRITE_PROMPT  # noqa: E402


def _tmpl(t: str, *args: str) -> str:
    parts = t.split("%s")
    out = []
    for i, p in enumerate(parts):
        out.append("'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        if i < len(args):
            out.append(args[i])
    return " || ".join(out)


SQL["grade_prompt"] = f"""{_RERANKED},
whole AS (SELECT question_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS content
          FROM ans GROUP BY question_id)
SELECT a.question_id, {_tmpl(GRADE_PROMPT, 'a.content', 'b.text')} AS grade,
       {_tmpl(REWRITE_PROMPT, 'b.text')} AS rewrite,
       {_tmpl(ANSWER_PROMPT, 'b.text', 'a.content')} AS answer
FROM whole a JOIN benchmark b ON b.item_id = a.question_id"""

SQL["file_payload_flatten"] = """
SELECT event_id,
  CASE WHEN event_type = 'view' THEN 'file' ELSE 'f' || CAST(event_id AS VARCHAR) || '.txt' END AS file_name,
  CASE WHEN event_type = 'click' THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS file_size,
  event_type AS content,
  CASE WHEN event_type = 'error' THEN 'Untitled' ELSE 'Item ' || CAST(event_id AS VARCHAR) END AS title,
  CASE WHEN event_type = 'signup' THEN 'N/A' ELSE CAST(event_id AS VARCHAR) END AS number,
  'N/A' AS url
FROM events"""

SQL["eval_label_histogram"] = f"""WITH {_KB_MEANS}
SELECT {LABEL('score')} AS label, CAST(count(*) AS BIGINT) AS n FROM kbm GROUP BY 1"""

SQL["doc_previews"] = """
SELECT doc_id, substr(text, 1, 200) || '...' AS preview_200, substr(text, 1, 50) || '...' AS preview_50
FROM documents"""

SQL["extract_json"] = """
WITH n AS (SELECT event_id, 'Model says: ' || props || ' (end of ' || event_type || ')' AS t FROM events),
x AS (SELECT event_id, CASE WHEN strpos(t, '{') > 0 AND strpos(t, '}') > 0
             THEN substr(t, strpos(t, '{'), length(t) - strpos(reverse(t), '}') + 1 - strpos(t, '{') + 1) END AS json_text
      FROM n)
SELECT event_id, json_text, CAST(json_extract(json_text, '$.k') AS BIGINT) AS k FROM x"""

SQL["chunk_metadata"] = f"""WITH ch AS ({SQL['chunk_token_window']}),
d AS (SELECT doc_id, source, lang FROM documents)
SELECT ch.chunk_id, 'chunk_id=' || ch.chunk_id || ';chunk_size=' || CAST(ch.chunk_size AS VARCHAR)
       || ';chunk_strategy=token;kb_name=' || ch.kb_name || ';lang=' || d.lang || ';source=' || d.source AS metadata
FROM ch JOIN d USING (doc_id)"""

# Chunks of every knowledge base, searched by its own settings (by the length of its name: semantic, hybrid,
# semantic reranked, hybrid reranked). Statistics and ranges are per knowledge base.
_CHUNK_SEARCH = f"""WITH ch AS ({SQL['chunk_token_window']}),
dt AS (SELECT chunk_id AS doc_id, kb_name, text, {TOK('text')} AS toks FROM ch),
dl AS (SELECT doc_id, kb_name, CAST(len(toks) AS DOUBLE) AS dl FROM dt),
kb AS (SELECT DISTINCT kb_name, length(kb_name) % 4 AS kind FROM ch),
post AS (SELECT kb_name, doc_id, term, count(*) AS tf
         FROM (SELECT kb_name, doc_id, unnest(toks) AS term FROM dt) GROUP BY ALL),
stats AS (SELECT kb_name, CAST(count(*) AS DOUBLE) AS n_docs, avg(dl) AS avgdl FROM dl GROUP BY kb_name),
dfs AS (SELECT kb_name, term, count(*) AS df FROM post GROUP BY ALL),
rawidf AS (SELECT kb_name, term, ln(n_docs - df + {D(0.5)}) - ln(df + {D(0.5)}) AS raw FROM dfs JOIN stats USING (kb_name)),
flo AS (SELECT kb_name, {D(0.25)} * avg(raw) AS eps_idf FROM rawidf GROUP BY kb_name),
idf AS (SELECT kb_name, term, CASE WHEN raw < 0 THEN eps_idf ELSE raw END AS idf FROM rawidf JOIN flo USING (kb_name)),
qtok AS (SELECT item_id AS query_id, {TOK('text')} AS qtoks FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf
       FROM (SELECT query_id, unnest(qtoks) AS term FROM qtok) GROUP BY query_id, term),
qw AS (SELECT kb_name, query_id, term, qtf * idf AS w FROM qt JOIN idf USING (term)),
bm_hit AS (SELECT q.query_id, p.doc_id,
                  sum(q.w * (p.tf * {D(2.5)}) / (p.tf + {D(1.5)} * ({D(0.25)} + {D(0.75)} * d.dl / s.avgdl))) AS bm25
           FROM qw q JOIN post p ON p.term = q.term AND p.kb_name = q.kb_name JOIN dl d ON d.doc_id = p.doc_id
           JOIN stats s ON s.kb_name = q.kb_name GROUP BY q.query_id, p.doc_id),
{_hash_ctes().strip()},
pairs AS (SELECT s.query_id, s.doc_id, d.kb_name, s.semantic, coalesce(h.bm25, {D(0)}) AS bm25
         FROM sem_all s JOIN dl d USING (doc_id) LEFT JOIN bm_hit h ON h.query_id = s.query_id AND h.doc_id = s.doc_id),
ranges AS (SELECT kb_name, query_id, min(bm25) AS bmin, max(bm25) AS bmax, min(semantic) AS smin, max(semantic) AS smax
           FROM pairs GROUP BY kb_name, query_id),
scored AS (SELECT b.kb_name, b.query_id, b.doc_id, kind, round(CASE WHEN kind IN (1, 3) THEN
             {D(0.5)} * (bm25 - bmin) / (bmax - bmin + {D(1e-8)}) + {D(0.5)} * (semantic - smin) / (smax - smin + {D(1e-8)})
             ELSE semantic END, 6) AS score
           FROM pairs b JOIN ranges USING (kb_name, query_id) JOIN kb USING (kb_name)),
first AS (SELECT *, row_number() OVER (PARTITION BY kb_name, query_id ORDER BY score DESC, doc_id) AS rank1 FROM scored
          QUALIFY rank1 <= CASE WHEN kind >= 2 THEN 20 ELSE 5 END),
qd AS (SELECT query_id, list_distinct(qtoks) AS qd FROM qtok),
again AS (SELECT f.kb_name, f.query_id, f.doc_id, kind, rank1, CASE WHEN kind < 2 THEN score WHEN len(qd) = 0 THEN {D(0)}
            ELSE round(CAST(len(list_intersect(qd, list_distinct(d.toks))) AS DOUBLE) / len(qd), 6) END AS score
          FROM first f JOIN qd USING (query_id) JOIN dt d USING (doc_id)),
ranked AS (SELECT kb_name, query_id AS question_id,
             CAST(row_number() OVER (PARTITION BY kb_name, query_id ORDER BY score DESC, rank1) AS INTEGER) AS rank,
             doc_id AS chunk_id, score,
             CASE WHEN kind IN (1, 3) THEN 'Hybrid Search (α=0.5)' ELSE 'Semantic Search' END || CASE WHEN kind >= 2
             THEN ' + Cross-Encoder Reranking (cross-encoder/ms-marco-MiniLM-L-12-v2)' ELSE '' END AS search_method
           FROM again QUALIFY rank <= 5)"""

SQL["kb_chunk_retrieval"] = f"{_CHUNK_SEARCH} SELECT * FROM ranked"

SQL["kb_chunk_answers"] = f"""{_CHUNK_SEARCH},
whole AS (SELECT r.kb_name, question_id, search_method, CAST(count(*) AS INTEGER) AS top_k,
            string_agg(ch.text, {NL2} ORDER BY rank) AS context, arg_min(ch.text, rank) AS first_text,
            string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids
          FROM ranked r JOIN ch USING (chunk_id) GROUP BY r.kb_name, question_id, search_method)
SELECT kb_name, question_id, b.text AS question, top_k, search_method,
  'Based on the following context, answer the question.' || {NL2} || 'Context:' || {NL} || context
  || {NL2} || 'Question: ' || b.text || {NL2} || 'Answer:' AS prompt,
  substr(first_text, 1, 200) || '...' AS answer, CAST(NULL AS VARCHAR) AS answer_error, chunk_ids
FROM whole JOIN benchmark b ON b.item_id = question_id"""

# Index searches return the rows of the full scans.
SQL["keyword_topk"] = SQL["bm25_topk"]
SQL["vector_topk_cells"] = SQL["vector_topk_dense"]
SQL["hybrid_topk_threshold"] = SQL["hybrid_topk"]

# A stream's statistics are those of one full build.
SQL["stream_corpus_stats"] = SQL["corpus_stats"]

SQL["comparison_paths"] = f"""WITH {_EV}
SELECT model, 'comparison/' || replace(replace(model, '/', '_'), '-', '_') || '/' || task || '/' || metric AS path,
       round(value, 6) AS value FROM lng"""

SQL["allowed_task_results"] = f"""WITH {_EV}, asked(task) AS (VALUES ('hellaswag'), ('mmlu'), ('gsm8k'), ('piqa'))
SELECT model, task, metric, round(value, 6) AS value FROM lng WHERE task IN (SELECT task FROM asked)
UNION ALL SELECT NULL, task, NULL, NULL FROM asked WHERE task NOT IN (SELECT task FROM lng)"""

SQL["task_listing"] = f"""WITH {_EV}
SELECT task, CAST(row_number() OVER (ORDER BY task) AS INTEGER) AS place FROM (SELECT DISTINCT task FROM lng)"""
