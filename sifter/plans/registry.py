"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each reads the provided tables whole; names and column aliases match the
DuckDB oracle in :mod:`sifter.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sifter.functions.text import explode_positions, split_sentences, strip_ws, tokenize
from sifter.functions.vectors import dense_entries, entries_norm, l2_normalize, norm
from sifter.functions import cleanup as CU
from sifter.functions import formatting as fmt
from sifter.functions import payload as PL
from sifter.operators import answering as AN
from sifter.operators import chunking as C
from sifter.operators import hybrid_search as HY
from sifter.operators import keyword_index as KI
from sifter.operators import vector_index as VI
from sifter.operators import corrective as CR
from sifter.sources import catalog as CAT
from sifter.operators import evaluation as EV
from sifter.operators import results as RS
from sifter.operators import training_data as TD
from sifter.operators import retrieval as R
from sifter.plans import tables as T
from sifter.plans.sizing import bounded_broadcast, mark_bounded
from sifter.session import cut_lineage, materialize, materialize_bucketed, scratch_path
from sifter.sources.fs import fingerprint
from sifter.streaming import jobs as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


_INDEX_CACHE: dict[tuple, DataFrame] = {}


def _cached_index(spark, sf, kind: str, build):
    """Index tables are built once per session and input version, then reused
    by every question batch (the reference rebuilds its index per question).
    The key holds the documents' size and modification time, so changed input
    is re-indexed."""
    key = (spark.sparkContext.applicationId, kind, fingerprint(spark, f"{sf.rstrip('/')}/documents.parquet"))
    if key not in _INDEX_CACHE:
        _INDEX_CACHE[key] = build()
    return _INDEX_CACHE[key]


def _doc_index(spark, sf):
    # The index feeds four sub-plans (stats, vocabulary, postings, vectors);
    # it is written once, bucketed by doc_id, to the shared checkpoint folder.
    # It carries the knowledge-base column (source), so the same table serves
    # whole-collection and per-KB retrieval.
    return _cached_index(spark, sf, "doc", lambda: R.store_index(
        T.scan(spark, sf, "documents").withColumnRenamed("source", "kb_name"), "sifter_doc_index", group_col="kb_name"))


def _qside(spark, sf, index):
    """The benchmark question side for the documents index (cached like the
    index: one row per question, materialised)."""
    key = (spark.sparkContext.applicationId, "qside", id(index),
           fingerprint(spark, f"{sf.rstrip('/')}/benchmark.parquet"))
    if key not in _INDEX_CACHE:
        _INDEX_CACHE[key] = R.prepare_questions(index, T.questions(spark, sf))
    return _INDEX_CACHE[key]


# ---------------------------------------------------------------- retrieval

@register("tokenize_docs")
def q_tokenize_docs(spark, sf):
    d = T.documents(spark, sf).select("doc_id", tokenize("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"),
                    F.array_join("t", " ").alias("tokens"))


@register("corpus_stats")
def q_corpus_stats(spark, sf):
    idx = _doc_index(spark, sf)
    g = R.idf_floor(idx)
    vocab = R.document_frequency(idx).agg(F.count(F.lit(1)).alias("n_terms"),
                                          F.sum("df").alias("n_postings"))
    return g.crossJoin(vocab).select(
        F.col("n_docs").cast("bigint").alias("n_docs"),
        F.round("avgdl", 6).alias("avgdl"),
        F.round("eps_idf", 6).alias("eps_idf"),
        F.col("n_terms").cast("bigint").alias("n_terms"),
        F.col("n_postings").cast("bigint").alias("n_postings"))


@register("term_df")
def q_term_df(spark, sf):
    idx = _doc_index(spark, sf)
    g = F.broadcast(R.idf_floor(idx))
    raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return (R.document_frequency(idx).crossJoin(g)
            .select("term", F.col("df").cast("bigint").alias("df"),
                    F.round(F.when(raw < 0, F.col("eps_idf")).otherwise(raw), 6).alias("idf")))


@register("bm25_topk")
def q_bm25_topk(spark, sf):
    idx = _doc_index(spark, sf)
    return R.bm25_topk(idx, _qside(spark, sf, idx), k=5)


@register("hashed_vectors")
def q_hashed_vectors(spark, sf):
    idx = _doc_index(spark, sf)
    v = idx.select("doc_id", l2_normalize("vec").alias("v"))
    return (explode_positions(v, F.col("v"), "dim", "w", "doc_id")
            .where(F.col("w") != 0)
            .select("doc_id", F.col("dim").cast("int").alias("dim"), F.round("w", 6).alias("w")))


@register("hashed_vector_topk")
def q_hashed_vector_topk(spark, sf):
    idx = _doc_index(spark, sf)
    return R.semantic_topk(idx, _qside(spark, sf, idx), k=5)


def _label_centroids(emb: DataFrame) -> DataFrame:
    """Query vectors for the dense table: the mean vector of each label."""
    parts = emb.select("label", F.posexplode(F.col("embedding").cast("array<double>"))
                       .alias("pos", "x"))
    mean = parts.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    return (mean.groupBy("label")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("s"))
            .select(F.col("label").alias("question_id"),
                    F.transform("s", lambda e: e["x"]).alias("qvec"),
                    F.lit("").alias("question")))


@register("vector_topk_dense")
def q_vector_topk_dense(spark, sf):
    emb = T.load(spark, sf, "embeddings")
    idx = emb.select(F.col("vec_id").alias("doc_id"),
                     F.col("embedding").cast("array<double>").alias("vec")).withColumn(
        "vnorm", norm("vec"))
    q = _label_centroids(emb).withColumn("qvec", dense_entries("qvec")).withColumn(
        "qnorm", entries_norm("qvec")).select(F.col("question_id").alias("query_id"), "qvec", "qnorm")
    res = R.top_k(R.semantic_pairs(idx, q).withColumnRenamed("semantic", "score"), 5)
    return res.select(F.col("query_id").alias("label"), "rank",
                      F.col("doc_id").alias("vec_id"), "score")


@register("hybrid_topk")
def q_hybrid_topk(spark, sf):
    idx = _doc_index(spark, sf)
    return R.hybrid_topk(idx, _qside(spark, sf, idx), k=5, alpha=0.5)


@register("hybrid_alpha0")
def q_hybrid_alpha0(spark, sf):
    idx = _doc_index(spark, sf)
    return R.hybrid_topk(idx, _qside(spark, sf, idx), k=5, alpha=0.0)


@register("hybrid_alpha1")
def q_hybrid_alpha1(spark, sf):
    idx = _doc_index(spark, sf)
    return R.hybrid_topk(idx, _qside(spark, sf, idx), k=5, alpha=1.0)


@register("hybrid_rerank_topk")
def q_hybrid_rerank_topk(spark, sf):
    docs = T.documents(spark, sf)
    idx = _doc_index(spark, sf)
    qs = T.questions(spark, sf)
    qside = _qside(spark, sf, idx)
    return R.advanced_retrieval(idx, qside, qs, docs, k=5, use_hybrid=True, use_reranking=True,
                                reranker_top_k=20, alpha=0.5)


def _hybrid_index(spark, sf):
    """Posting blocks and vector cells over the document index, built once like it."""
    return _cached_index(spark, sf, "hybrid", lambda: HY.build_hybrid_index(
        _doc_index(spark, sf), keyword=_keyword_index(spark, sf)))


def _keyword_index(spark, sf):
    """Posting blocks alone: a keyword search reads no vectors."""
    return _cached_index(spark, sf, "keyword", lambda: KI.build_keyword_index(_doc_index(spark, sf)))


@register("keyword_topk")
def q_keyword_topk(spark, sf):
    """The rows of bm25_topk through the posting blocks (blocks and documents below the k-th score are left out)."""
    found = KI.search(_keyword_index(spark, sf), _qside(spark, sf, _doc_index(spark, sf)), k=5)
    return found.ranked.select("query_id", "rank", "doc_id", "score")


@register("vector_topk_cells")
def q_vector_topk_cells(spark, sf):
    """The rows of vector_topk_dense through an index of cells (parts out of reach are not visited)."""
    emb = T.load(spark, sf, "embeddings")
    idx = emb.select(F.col("vec_id").alias("doc_id"),
                     F.col("embedding").cast("array<double>").alias("vec")).withColumn("vnorm", norm("vec"))
    q = _label_centroids(emb).withColumn("qvec", dense_entries("qvec")).withColumn(
        "qnorm", entries_norm("qvec")).select(F.col("question_id").alias("query_id"), "qvec", "qnorm")
    q = cut_lineage(q)
    found = VI.exact_search(VI.build_vector_index(idx), mark_bounded(q, q.count()), 5).ranked
    return found.select(F.col("query_id").alias("label"), "rank", F.col("doc_id").alias("vec_id"), "score")


@register("hybrid_topk_threshold")
def q_hybrid_topk_threshold(spark, sf):
    """The rows of hybrid_topk by the threshold algorithm over both indexes."""
    return HY.search(_hybrid_index(spark, sf), _qside(spark, sf, _doc_index(spark, sf)), k=5, alpha=0.5).ranked


# ----------------------------------------------------------------- chunking

@register("split_sentences")
def q_split_sentences(spark, sf):
    d = T.documents(spark, sf).select("doc_id", split_sentences("text").alias("s"))
    return explode_positions(d, F.col("s"), "sent_ord", "sentence", "doc_id").select(
        "doc_id", F.col("sent_ord").cast("int").alias("sent_ord"), "sentence")


@register("chunk_token_window")
def q_chunk_token_window(spark, sf):
    docs = T.documents(spark, sf)
    return C.token_chunks(docs, 512, 50, kb_col=F.col("source"))


@register("chunk_semantic")
def q_chunk_semantic(spark, sf):
    docs = T.documents(spark, sf)
    return C.semantic_chunks(docs, 512, 0.8, kb_col=F.col("source"))


@register("chunk_recursive")
def q_chunk_recursive(spark, sf):
    docs = T.documents(spark, sf)
    return C.recursive_chunks(docs, 512, 50, kb_col=F.col("source"))


@register("chunk_recursive_stats")
def q_chunk_recursive_stats(spark, sf):
    ch = q_chunk_recursive(spark, sf)
    return ch.groupBy("kb_name").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"),
        F.max("chunk_size").alias("max_chunk_size"),
        F.round(F.avg("chunk_size"), 6).alias("avg_chunk_size"))


# ------------------------------------------------------------ training data

def _turn_pairs(spark, sf) -> DataFrame:
    """User turns with the next turn (turn numbers are ordinals) and the
    conversation's system text.

    Equi-joins on (conv_id, turn) hash-partition by both columns, so a very
    long conversation is spread over many tasks; the system text is a
    per-conversation aggregate (partial+final) joined back on conv_id, where
    AQE can split a hot key.
    """
    conv = T.load(spark, sf, "conversations")
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"),
                      F.col("role").alias("next_role"), F.col("text").alias("next_text"))
    system = (conv.where(F.col("role") == "system").groupBy("conv_id")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))),
                                            lambda m: m["text"]), "\n").alias("system_text")))
    pairs = (conv.where(F.col("role") == "user").join(nxt, ["conv_id", "turn"])
             .where(F.col("next_role") == "assistant"))
    return pairs.join(system, "conv_id", "left").select(
        "conv_id", "turn", "role", "text", "next_role", "next_text", "system_text")


@register("format_instruction")
def q_format_instruction(spark, sf):
    p = _turn_pairs(spark, sf)
    return p.select("conv_id", "turn", fmt.instruction_text(
        F.col("text"), F.col("system_text"), F.col("next_text")).alias("text"))


@register("format_completion")
def q_format_completion(spark, sf):
    p = _turn_pairs(spark, sf)
    return p.select("conv_id", "turn", fmt.completion_text(F.col("text"), F.col("next_text"))
                    .alias("text"))


def _messages(spark, sf) -> DataFrame:
    """One row per conversation with its turns in order (a conversation is one group)."""
    conv = T.load(spark, sf, "conversations")
    return conv.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
                    lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
        .alias("messages"))


@register("format_chat")
def q_format_chat(spark, sf):
    return _messages(spark, sf).select("conv_id", fmt.chat_text("messages").alias("text"))


@register("chat_prompt")
def q_chat_prompt(spark, sf):
    return _messages(spark, sf).select("conv_id", fmt.chat_prompt("messages").alias("prompt"))


def _classification_rows(spark, sf) -> DataFrame:
    docs = T.documents(spark, sf).select("doc_id", "text")
    labels = T.load(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id")


@register("format_classification")
def q_format_classification(spark, sf):
    rows = _classification_rows(spark, sf)
    return rows.select("doc_id", fmt.classification_text("text", "label").alias("text"))


@register("validate_training_set")
def q_validate_training_set(spark, sf):
    rows = TD.to_training_columns(_classification_rows(spark, sf))
    return TD.validate_classification(rows).select(
        "ok", "reason", F.col("rows").cast("bigint").alias("rows"))


@register("train_split")
def q_train_split(spark, sf):
    s = TD.exact_split(T.documents(spark, sf).select("doc_id"), "doc_id", 0.1, 42)
    return s.where(F.col("split") == "train").select("doc_id")


@register("eval_split")
def q_eval_split(spark, sf):
    docs = T.documents(spark, sf).select("doc_id")
    train = q_train_split(spark, sf)
    return docs.join(train, "doc_id", "left_anti")


@register("pad_truncate")
def q_pad_truncate(spark, sf):
    t = TD.tokenize_fixed(T.documents(spark, sf), "text", 128, keep=["doc_id"])
    return t.select("doc_id",
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("int").alias("n_real"),
                    F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join("attention_mask", ",").alias("attention_mask"),
                    F.array_join("labels", ",").alias("labels"))


@register("calibration_sample")
def q_calibration_sample(spark, sf):
    return TD.calibration_sample(T.documents(spark, sf).select("doc_id", "text"), "doc_id", 128)


# ----------------------------------------------------------------- results
# Benchmark results are derived from ``events``: the user bucket is the model,
# the event type (mapped to a benchmark task name) is the task, and the mean
# event value / mean JSON ``k`` are the metrics.

EVENT_TASK = {"click": "hellaswag", "view": "arc_easy", "purchase": "gsm8k", "signup": "mmlu",
              "error": "error_rate"}
EVENT_LOG_KEY = {"click": "train_loss", "view": "eval_accuracy", "purchase": "eval_f1_macro",
                 "signup": "train_runtime", "error": "eval_loss"}
N_MODELS = 4
COMPARE_TASKS = ["hellaswag", "arc_easy", "gsm8k", "mmlu"]
RESULT_METRICS = ["k_mean", "value_mean"]


def _map_col(mapping: dict[str, str], col: str):
    expr = F.lit(None).cast("string")
    for k, v in reversed(list(mapping.items())):
        expr = F.when(F.col(col) == k, F.lit(v)).otherwise(expr)
    return expr


def _events(spark, sf):
    e = T.load(spark, sf, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value", "props",
                    F.concat(F.lit("org/model_"), F.pmod("user_id", F.lit(N_MODELS)).cast("string"))
                    .alias("model"),
                    _map_col(EVENT_TASK, "event_type").alias("task"),
                    F.get_json_object("props", "$.k").cast("double").alias("k"))


def _results_docs(spark, sf):
    """One results JSON document per model (numbers as JSON numbers, plus a
    string ``alias`` metric that the numeric filter must drop)."""
    per_task = _events(spark, sf).groupBy("model", "task").agg(
        F.avg("value").alias("value_mean"), F.avg("k").alias("k_mean"))
    doc = per_task.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct(
        "task", F.struct(F.col("task").alias("alias"), "value_mean", "k_mean")))).alias("results"))
    return doc.select("model", F.to_json(F.struct(
        "results", F.create_map(F.lit("model"), F.col("model")).alias("config"))).alias("json"))


def _results_long(spark, sf):
    return RS.flatten_results(_results_docs(spark, sf), "json", "model")


@register("results_flatten")
def q_results_flatten(spark, sf):
    return _results_long(spark, sf).withColumn("value", F.round("value", 6))


@register("results_pivot")
def q_results_pivot(spark, sf):
    w = RS.results_wide(_results_long(spark, sf), RESULT_METRICS)
    return w.select("model", "task", *[F.round(m, 6).alias(m) for m in RESULT_METRICS])


@register("best_performer")
def q_best_performer(spark, sf):
    return RS.best_performers(_results_long(spark, sf)).withColumn("value", F.round("value", 6))


@register("model_compare")
def q_model_compare(spark, sf):
    w = RS.compare_models(_results_long(spark, sf), COMPARE_TASKS, RESULT_METRICS)
    return w.select("model", *[F.round(c, 6).alias(c) for c in w.columns if c != "model"])


@register("results_report")
def q_results_report(spark, sf):
    return RS.report_rows(_results_long(spark, sf))


@register("task_categories")
def q_task_categories(spark, sf):
    return RS.categorize_tasks(_results_long(spark, sf), spark)


@register("suite_expand")
def q_suite_expand(spark, sf):
    tasks = _results_long(spark, sf).select("task").distinct()
    suites = RS.suite_dimension(spark)
    flagged = suites.join(tasks.withColumn("has_results", F.lit(True)), "task", "left")
    return flagged.select("suite", "pos", "task",
                          F.coalesce("has_results", F.lit(False)).alias("has_results"))


@register("metric_last_value")
def q_metric_last_value(spark, sf):
    e = _events(spark, sf).withColumn("step", F.struct("ts", "event_id"))
    r = RS.last_values(e, "user_id", "step", "event_type", "value")
    return r.select("user_id", "event_type", "last_value",
                    F.col("last_step.event_id").alias("last_event_id"))


@register("run_duration")
def q_run_duration(spark, sf):
    e = _events(spark, sf).withColumn("step", F.struct("ts", "event_id"))
    r = RS.run_summary(e, "user_id", "ts", "value", "step")
    return r.select("user_id", F.round("duration_sec", 6).alias("duration_sec"), "n_values", "final_value")


# A list of tasks somebody asks for: three that have results, one that has none.
ASKED_TASKS = ["hellaswag", "mmlu", "gsm8k", "piqa"]


@register("allowed_task_results")
def q_allowed_task_results(spark, sf):
    """The results of the tasks on a list, and the listed tasks without any."""
    asked = T.literal_names(spark, "task", ASKED_TASKS)
    found, missing = RS.allow_list(_results_long(spark, sf), asked, "task")
    return found.select("model", "task", "metric", F.round("value", 6).alias("value")).unionByName(
        missing.select(F.lit(None).cast("string").alias("model"), "task", F.lit(None).cast("string").alias("metric"),
                       F.lit(None).cast("double").alias("value")))


@register("task_listing")
def q_task_listing(spark, sf):
    """tasks with results, in order."""
    return RS.listing(_results_long(spark, sf), "task")


@register("latency_stats")
def q_latency_stats(spark, sf):
    runs = _events(spark, sf).select("model", F.col("value").alias("total_time"),
                                     F.col("k").alias("tokens_generated"))
    r = RS.latency_stats(runs)
    return r.select("model", *[F.round(c, 6).alias(c) for c in
                               ["avg_time", "min_time", "max_time", "avg_tokens_per_second"]],
                    F.col("runs").cast("bigint").alias("runs"))


@register("log_regex_metrics")
def q_log_regex_metrics(spark, sf):
    e = _events(spark, sf)
    lines = e.select(F.col("user_id").alias("run"), F.struct("ts", "event_id").alias("ts"),
                     F.format_string("{'%s': %s, 'step': %d}", _map_col(EVENT_LOG_KEY, "event_type"),
                                     F.col("value").cast("string"), F.col("event_id")).alias("line"))
    return RS.log_line_metrics(lines, "run", "ts", "line").select(
        "run", "final_train_loss", "train_runtime", "eval_accuracy", "eval_f1_macro", "eval_loss")


# --------------------------------------------------------------- evaluation
# Retrieval as configured by default (semantic top-5), the fallback answer,
# and the benchmark passage itself as the ground truth of its question.

EVAL_K = 5
COMPARE_METRICS = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]


def _eval_ranked(spark, sf, group_col=None):
    """Ranked contexts (ids) of the questions x KBs grid."""
    idx = _doc_index(spark, sf)
    # Semantic search alone: the vector side needs no collection statistics.
    qside = R.prepare_questions(idx, T.questions(spark, sf), group_col=group_col, keyword=False)
    ranked = mark_bounded(R.semantic_topk(idx, qside, EVAL_K), qside._sifter_rows * EVAL_K)
    return idx, ranked


def _eval_rows(spark, sf, group_col=None):
    """K1 evaluation dataset (questions x KBs, k context ids each with the terms they share with the row), prepared once
    per session and input version and materialised (bounded rows), then scored
    by every metric query - as the reference prepares its dataset once."""
    keys = ([group_col] if group_col else []) + ["query_id"]
    key = (spark.sparkContext.applicationId, "eval_rows", group_col,
           fingerprint(spark, f"{sf.rstrip('/')}/documents.parquet"),
           fingerprint(spark, f"{sf.rstrip('/')}/benchmark.parquet"))
    if key in _INDEX_CACHE:
        return _INDEX_CACHE[key], keys
    docs = T.documents(spark, sf)
    qs = T.questions(spark, sf)
    if group_col:
        docs = docs.withColumnRenamed("source", group_col)
    idx, ranked = _eval_ranked(spark, sf, group_col)
    ranked = mark_bounded(cut_lineage(ranked), ranked._sifter_rows)  # ids, read twice
    gts = qs.select("question_id", F.array("question").alias("ground_truths"))
    rows = EV.evaluation_term_rows(ranked, qs, docs, idx, keys, ground_truths=gts)
    # Few bytes but much work a row: one task would score them all.
    rows = cut_lineage(rows.repartition(spark.sparkContext.defaultParallelism, *keys))
    _INDEX_CACHE[key] = rows
    return rows, keys


@register("eval_dataset")
def q_eval_dataset(spark, sf):
    _, ranked = _eval_ranked(spark, sf)
    rows = EV.evaluation_rows(ranked, T.questions(spark, sf), T.documents(spark, sf), ["query_id"])
    return rows.select(F.col("query_id").alias("question_id"), "answer",
                       F.size("contexts").alias("n_contexts"),
                       F.array_join("contexts", "\n\n").alias("contexts"))


def _metric_query(metric):
    def q(spark, sf):
        rows, keys = _eval_rows(spark, sf)
        long = EV.score_rows(rows, [metric], keys)
        return long.select(F.col("query_id").alias("question_id"),
                           F.round("value", 6).alias(metric))
    return q


for _m in ["faithfulness", "context_precision", "context_recall", "answer_similarity",
           "answer_relevancy", "answer_correctness"]:
    register(_m)(_metric_query(_m))


def _kb_means(spark, sf):
    rows, keys = _eval_rows(spark, sf, group_col="kb_name")
    long = EV.score_rows(rows, COMPARE_METRICS, keys)
    return EV.metric_means(long, ["kb_name"])


def _kb_order(means):
    # Requested KB order = name order; the KB list is a catalog (bounded).
    kbs = means.select("kb_name").distinct()
    return kbs.select("kb_name", F.dense_rank().over(Window.orderBy("kb_name")).alias("kb_ord"))


@register("kb_compare_pivot")
def q_kb_compare_pivot(spark, sf):
    return EV.compare_pivot(_kb_means(spark, sf), COMPARE_METRICS)


@register("kb_best_per_metric")
def q_kb_best_per_metric(spark, sf):
    m = _kb_means(spark, sf)
    b = EV.best_per_metric(m, _kb_order(m))
    return b.select("metric", "best_kb", F.round("best_score", 6).alias("best_score"))


@register("kb_overall_best")
def q_kb_overall_best(spark, sf):
    m = _kb_means(spark, sf)
    b = EV.overall_best(m, _kb_order(m))
    return b.select("best_kb", F.round("best_mean", 6).alias("best_mean"))


@register("eval_summary")
def q_eval_summary(spark, sf):
    m = _kb_means(spark, sf)
    s = EV.overall_summary(m, ["kb_name"], EV.metric_order(spark, COMPARE_METRICS))
    return s.select("kb_name", F.round("avg_score", 6).alias("avg_score"),
                    EV.performance_label("avg_score").alias("overall_label"),
                    "best_metric", F.round("best_score", 6).alias("best_score"),
                    "worst_metric", F.round("worst_score", 6).alias("worst_score"))


@register("eval_labels")
def q_eval_labels(spark, sf):
    m = _kb_means(spark, sf)
    return m.select("kb_name", "metric", F.round("score", 6).alias("score"),
                    EV.performance_label("score").alias("label"),
                    EV.metric_title("metric").alias("title"),
                    EV.interpretation("metric").alias("description"))


@register("eval_recommendations")
def q_eval_recommendations(spark, sf):
    m = _kb_means(spark, sf)
    per_kb = m.groupBy("kb_name").agg(F.map_from_entries(F.collect_list(
        F.struct("metric", "score"))).alias("scores"))
    return per_kb.select("kb_name", F.array_join(EV.recommendations(F.col("scores")), "\n")
                         .alias("recommendations"))


@register("retrieval_hit_mrr_ndcg")
def q_retrieval_hit_mrr_ndcg(spark, sf):
    emb = T.load(spark, sf, "embeddings")
    idx = emb.select(F.col("vec_id").alias("doc_id"),
                     F.col("embedding").cast("array<double>").alias("vec")).withColumn(
        "vnorm", norm("vec"))
    q = _label_centroids(emb).withColumn("qvec", dense_entries("qvec")).withColumn(
        "qnorm", entries_norm("qvec")).select(F.col("question_id").alias("query_id"), "qvec", "qnorm")
    ranked = R.top_k(R.semantic_pairs(idx, q).withColumnRenamed("semantic", "score"), 10)
    relevant = emb.select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"))
    m = EV.ranking_metrics(ranked, relevant, ["query_id"], 10)
    return m.select(F.col("query_id").alias("label"),
                    *[F.round(c, 6).alias(c) for c in ["hit_at_k", "mrr", "ndcg_at_k", "recall_at_k"]])


# --------------------------------------------------------- clean-up, payload

@register("clean_flat")
def q_clean_flat(spark, sf):
    return T.load(spark, sf, "pages").select("page_id", CU.clean_flat("html").alias("text"))


@register("clean_lines")
def q_clean_lines(spark, sf):
    return T.documents(spark, sf).select("doc_id", CU.clean_lines("text").alias("text"))


@register("strip_code")
def q_strip_code(spark, sf):
    return T.load(spark, sf, "pages").select("page_id", CU.strip_markdown_code("html").alias("text"))


@register("strip_reasoning")
def q_strip_reasoning(spark, sf):
    return T.documents(spark, sf).select("doc_id", CU.strip_reasoning("text").alias("text"))


@register("cut_at_marker")
def q_cut_at_marker(spark, sf):
    return T.documents(spark, sf).select("doc_id", CU.cut_at_marker("text").alias("text"))


@register("paragraphise")
def q_paragraphise(spark, sf):
    return T.documents(spark, sf).select("doc_id", CU.paragraphise("text").alias("text"))


@register("markdown_format")
def q_markdown_format(spark, sf):
    return T.documents(spark, sf).select("doc_id", CU.format_markdown("text").alias("text"))


@register("markdown_table_rows")
def q_markdown_table_rows(spark, sf):
    d = explode_positions(T.documents(spark, sf),
                          F.transform(F.split("text", "\n", -1), strip_ws), "line_no", "line", "doc_id")
    rows = d.where(CU.is_table_line("line")).select(
        "doc_id", F.col("line_no").cast("int").alias("line_no"), CU.table_row("line").alias("r"))
    return rows.where(F.col("r").isNotNull()).select(
        "doc_id", "line_no", "r.name", "r.description", "r.is_header")


@register("json_props_flatten")
def q_json_props_flatten(spark, sf):
    e = T.load(spark, sf, "events")
    j = PL.json_or_text("props", "k bigint")
    return e.select("event_id", j["parsed"]["k"].alias("k"), j["text"].alias("raw_text"))


@register("summarise_json")
def q_summarise_json(spark, sf):
    e = T.load(spark, sf, "events")
    return e.select("event_id", PL.summarise_json_object("props").alias("summary"))


def _iso(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _payload_events(spark, sf):
    return T.load(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"))


@register("repo_flatten")
def q_repo_flatten(spark, sf):
    e = _payload_events(spark, sf)
    item = F.struct(
        F.concat(F.lit("org/repo_"), F.col("event_id").cast("string")).alias("full_name"),
        F.concat(F.lit("repo_"), F.col("event_id").cast("string")).alias("name"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("Event "), F.col("event_type")))
        .alias("description"),
        F.when(F.col("event_type") != "view", F.col("k")).alias("stargazers_count"),
        F.col("user_id").cast("int").alias("forks_count"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("language"),
        _iso(F.col("ts")).alias("updated_at"),
        F.concat(F.lit("https://example.com/"), F.col("event_id").cast("string")).alias("html_url"))
    payload = e.select("event_id", F.to_json(F.struct(F.lit(1).alias("total_count"),
                                                      F.array(item).alias("items"))).alias("json"))
    return PL.flatten_repositories(payload, "json", ["event_id"]).select(
        "event_id", "total_count", F.col("item_no").cast("int").alias("item_no"), "name",
        "description", "stars", "forks", "language", "updated", "has_details", "url")


def _issue_struct(pr: bool):
    state = (F.when(F.col("event_type") == "signup", F.lit(None).cast("string"))
             .when(F.col("value") < 100, "open").otherwise("closed")) if pr else \
        F.when(F.col("value") <= 100, "open").otherwise("closed")
    fields = [F.concat(F.lit("Issue "), F.col("event_id").cast("string")).alias("title"),
              F.col("event_id").cast("int").alias("number"), state.alias("state"),
              F.struct(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("login"))
              .alias("user"),
              _iso(F.col("ts")).alias("created_at"),
              F.concat(F.lit("https://example.com/i/"), F.col("event_id").cast("string")).alias("html_url")]
    if pr:
        fields += [F.struct(F.col("event_type").alias("ref")).alias("head"),
                   F.struct(F.lit("main").alias("ref")).alias("base"),
                   (F.col("event_type") == "view").alias("draft"),
                   (F.col("event_type") == "purchase").alias("merged")]
    return F.struct(*fields)


@register("issue_flatten")
def q_issue_flatten(spark, sf):
    e = _payload_events(spark, sf)
    payload = e.select("event_id", F.to_json(F.array(_issue_struct(False))).alias("json"))
    return PL.flatten_issues(payload, "json", ["event_id"]).select(
        "event_id", "number", "title", "state", "user", "created", "url", "is_open")


@register("pr_flatten")
def q_pr_flatten(spark, sf):
    e = _payload_events(spark, sf)
    payload = e.select("event_id", F.to_json(F.array(_issue_struct(True))).alias("json"))
    return PL.flatten_pull_requests(payload, "json", ["event_id"]).select(
        "event_id", "number", "title", "state", "user", "created", "head", "base", "draft", "status")


# ------------------------------------------------------ query answers, KBs

RERANKER_MODEL = "cross-encoder/ms-marco-MiniLM-L-12-v2"


def _answered(spark, sf):
    """Ranked rows with content (late lookup) plus the KB configuration."""
    docs = T.documents(spark, sf)
    ranked = q_hybrid_rerank_topk(spark, sf)
    # At most k = 5 rows per question (proven by the question count).
    ranked = mark_bounded(ranked, _qside(spark, sf, _doc_index(spark, sf))._sifter_rows * 5)
    content = docs.select("doc_id", F.col("text").alias("content")).join(
        bounded_broadcast(ranked), "doc_id")
    method = R.search_method_description(F.lit(True), F.lit(0.5), F.lit(True), F.lit(RERANKER_MODEL))
    return content.select(F.col("query_id").alias("question_id"), "rank", "doc_id",
                          F.col("score").alias("relevance_score"), "content",
                          F.lit("all").alias("kb_name"), F.lit(5).alias("top_k"),
                          method.alias("search_method"))


@register("query_result_nested")
def q_query_result_nested(spark, sf):
    return _answered(spark, sf)


@register("rag_prompt")
def q_rag_prompt(spark, sf):
    a = _answered(spark, sf)
    per_q = a.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", "content"))), lambda x: x["content"]).alias("contexts"))
    qs = T.questions(spark, sf)
    j = per_q.join(qs, "question_id")
    return j.select("question_id", fmt.rag_prompt("contexts", "question").alias("prompt"),
                    F.concat(F.substring(F.element_at("contexts", 1), 1, 200), F.lit("..."))
                    .alias("answer"))


def _kb_chunks(spark, sf):
    docs = T.documents(spark, sf)
    return C.token_chunks(docs, 512, 50, kb_col=F.col("source"))


# Search settings of the knowledge bases, dealt over their names in order.
KB_SETTINGS = [
    {"use_hybrid_search": False, "use_reranking": False}, {"use_hybrid_search": True, "use_reranking": False},
    {"use_hybrid_search": False, "use_reranking": True}, {"use_hybrid_search": True, "use_reranking": True}]


def _kb_catalog(spark, sf):
    """A catalog row per source, with one of four search settings by the length of its name."""
    names = T.documents(spark, sf).select(F.col("source").alias("kb_name")).distinct()
    rows = CAT.default_configs(names, chunking_strategy="token")
    pick = F.length("name") % len(KB_SETTINGS)
    for field in ("use_hybrid_search", "use_reranking"):
        value = F.lit(False)
        for i, settings in enumerate(KB_SETTINGS):
            value = F.when(pick == i, F.lit(settings[field])).otherwise(value)
        rows = rows.withColumn(field, value)
    return rows


def _chunk_store(spark, sf):
    """Stored chunks of all documents and their index, built once like the document index."""
    chunks = _cached_index(spark, sf, "chunks", lambda: materialize(_kb_chunks(spark, sf), "chunk-store"))
    index = _cached_index(spark, sf, "chunk-index", lambda: materialize_bucketed(
        AN.chunk_index(chunks), "sifter_chunk_index"))
    return chunks, index


def _chunk_ranked(spark, sf):
    key = (spark.sparkContext.applicationId, "chunk_ranked", fingerprint(spark, f"{sf.rstrip('/')}/documents.parquet"),
           fingerprint(spark, f"{sf.rstrip('/')}/benchmark.parquet"))
    if key not in _INDEX_CACHE:
        chunks, index = _chunk_store(spark, sf)
        ranked = AN.retrieve(_kb_catalog(spark, sf), chunks, T.questions(spark, sf), k=5, index=index)
        _INDEX_CACHE[key] = mark_bounded(cut_lineage(ranked), ranked._sifter_rows)
    return _INDEX_CACHE[key]


@register("kb_chunk_retrieval")
def q_kb_chunk_retrieval(spark, sf):
    """Every question of every knowledge base, over its chunks, searched as its catalog row says."""
    return _chunk_ranked(spark, sf)


@register("kb_chunk_answers")
def q_kb_chunk_answers(spark, sf):
    """Prompt and extractive answer from the ranked chunks, one row per knowledge base and question."""
    chunks, _ = _chunk_store(spark, sf)
    found = AN.answer(AN.with_content(_chunk_ranked(spark, sf), chunks), T.questions(spark, sf))
    return found.select("kb_name", "question_id", "question", "top_k", "search_method", "prompt", "answer", "answer_error",
                        F.array_join(F.transform("documents", lambda d: d["chunk_id"]), ",").alias("chunk_ids"))


@register("ingest_counts")
def q_ingest_counts(spark, sf):
    docs = T.documents(spark, sf)
    return CAT.ingest_counts(docs.withColumnRenamed("source", "kb_name"), _kb_chunks(spark, sf))


@register("kb_stats")
def q_kb_stats(spark, sf):
    chunks = _kb_chunks(spark, sf)
    kbs = T.documents(spark, sf).select(F.col("source").alias("kb_name")).distinct()
    catalog = CAT.default_configs(kbs, chunking_strategy="token")
    return CAT.kb_stats(catalog, chunks).select(
        "name", "embedding_model", "chunk_size", "chunk_overlap", "chunking_strategy",
        "vector_store", "document_count", "chunk_count")


# ------------------------------------------------------ corrective retrieval

@register("corrective_retrieval")
def q_corrective_retrieval(spark, sf):
    idx = _doc_index(spark, sf)
    stats = _cached_index(spark, sf, "doc-stats", lambda: R.index_stats(idx))
    out = CR.corrective_retrieval(idx, T.questions(spark, sf), k=5, max_retries=2, stats=stats)
    return out.select("question_id", "question", "rounds", "relevant", "trace", "message_count",
                      F.array_join("doc_ids", ",").alias("doc_ids"))


@register("retrieval_compare")
def q_retrieval_compare(spark, sf):
    idx = _doc_index(spark, sf)
    qside = _qside(spark, sf, idx)
    c = CR.compare_runs(R.bm25_topk(idx, qside, 5), R.semantic_topk(idx, qside, 5))
    return c.select("query_id", F.col("overlap").cast("bigint").alias("overlap"),
                    F.round("jaccard", 6).alias("jaccard"),
                    F.round("mean_rank_delta", 6).alias("mean_rank_delta"))


@register("default_question_retrieval")
def q_default_question_retrieval(spark, sf):
    idx = _doc_index(spark, sf)
    qside = R.prepare_questions(idx, CR.default_questions(spark, 10), keyword=False)
    return R.semantic_topk(idx, qside, 3)


# ---------------------------------------------------------------- streaming

def _stream_dirs(spark, name):
    import uuid
    base = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    return f"{base}/sink", f"{base}/checkpoint"


@register("stream_ingest")
def q_stream_ingest(spark, sf):
    schema = T.load(spark, sf, "documents").schema
    docs = ST.table_stream(spark, sf, "documents.parquet", schema).select(
        "doc_id", F.col("source").alias("kb_name"), "text")
    sink, ck = _stream_dirs(spark, "stream_ingest")
    ST.ingest_stream(docs, sink, ck, strategy="token").awaitTermination()
    return spark.read.parquet(sink).select(
        "kb_name", "doc_id", "chunk_ord", "chunk_id", "text", "chunk_size", "chunk_strategy")


@register("stream_corpus_stats")
def q_stream_corpus_stats(spark, sf):
    """D10 kept by a stream of documents: the rows of corpus_stats from additive parts."""
    schema = T.load(spark, sf, "documents").schema
    docs = ST.table_stream(spark, sf, "documents.parquet", schema).select("doc_id", "text")
    parts, ck = _stream_dirs(spark, "stream_statistics")
    ST.statistics_stream(docs, parts, ck).awaitTermination()
    stats = ST.read_statistics(spark, parts)
    words = stats.vocab.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"))
    return stats.glob.crossJoin(words).select(
        F.col("n_docs").cast("bigint").alias("n_docs"), F.round("avgdl", 6).alias("avgdl"),
        F.round("eps_idf", 6).alias("eps_idf"), F.col("n_terms").cast("bigint").alias("n_terms"),
        F.col("n_postings").cast("bigint").alias("n_postings"))


@register("comparison_paths")
def q_comparison_paths(spark, sf):
    return RS.comparison_paths(_results_long(spark, sf)).withColumn("value", F.round("value", 6))


@register("stream_metrics")
def q_stream_metrics(spark, sf):
    events = T.load(spark, sf, "events")
    start = events.agg(F.min("ts")).first()[0]
    sink, ck = _stream_dirs(spark, "stream_metrics")
    stream = ST.table_stream(spark, sf, "events.parquet", events.schema)
    ST.metric_stream(stream, sink, ck, str(start)).awaitTermination()
    return spark.read.parquet(sink).select("name", "value", "step")


@register("eval_report")
def q_eval_report(spark, sf):
    rows, keys = _eval_rows(spark, sf, group_col="kb_name")
    _, _, report = EV.evaluate_pipeline(rows, keys, COMPARE_METRICS, "kb_name", 0.0,
                                        "1970-01-01T00:00:00")
    return report


# ------------------------------------------------- small projections (H, L, D)

@register("logging_metrics")
def q_logging_metrics(spark, sf):
    return RS.logging_metrics(q_log_regex_metrics_full(spark, sf))


def q_log_regex_metrics_full(spark, sf):
    e = _events(spark, sf)
    lines = e.select(F.col("user_id").alias("run"), F.struct("ts", "event_id").alias("ts"),
                     F.format_string("{'%s': %s, 'step': %d}", _map_col(EVENT_LOG_KEY, "event_type"),
                                     F.col("value").cast("string"), F.col("event_id")).alias("line"))
    return RS.log_line_metrics(lines, "run", "ts", "line")


@register("results_config_info")
def q_results_config_info(spark, sf):
    docs = _results_docs(spark, sf).select(
        "model", F.from_json("json", RS.RESULTS_SCHEMA)["config"].alias("config"))
    kv = explode_positions(docs, F.map_entries("config"), "_p", "e", "model").select(
        "model", F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    return RS.split_info(kv, keep=("model",))


@register("metric_paths")
def q_metric_paths(spark, sf):
    long = _results_long(spark, sf)
    return RS.metric_paths(long, "eval", keep=("model",)).withColumn("value", F.round("value", 6))


@register("distinct_tasks_metrics")
def q_distinct_tasks_metrics(spark, sf):
    tasks, metrics = RS.distinct_tasks_metrics(_results_long(spark, sf))
    return (tasks.select(F.lit("task").alias("kind"), F.col("task").alias("name"))
            .unionByName(metrics.select(F.lit("metric").alias("kind"), F.col("metric").alias("name"))))


@register("inference_prompt")
def q_inference_prompt(spark, sf):
    conv = T.load(spark, sf, "conversations").where(F.col("role") == "user")
    types = F.broadcast(spark.createDataFrame(
        [("instruction_following",), ("chat",), ("completion",)], "task_type string"))
    return conv.crossJoin(types).select("conv_id", "turn", "task_type",
                                        fmt.inference_prompt(F.col("task_type"), F.col("text")).alias("prompt"))


@register("grade_prompt")
def q_grade_prompt(spark, sf):
    # The whole retrieved content in rank order: at most k = 5 rows per question.
    a = _answered(spark, sf).groupBy("question_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda r: r["content"]), "\n\n").alias("content"))
    qs = T.questions(spark, sf)
    j = a.join(bounded_broadcast(qs), "question_id")
    return j.select("question_id", fmt.grade_prompt(F.col("content"), F.col("question")).alias("grade"),
                    fmt.rewrite_prompt(F.col("question")).alias("rewrite"),
                    fmt.answer_prompt(F.col("question"), F.col("content")).alias("answer"))


@register("file_payload_flatten")
def q_file_payload_flatten(spark, sf):
    e = _payload_events(spark, sf)
    fpay = F.to_json(F.struct(
        F.when(F.col("event_type") != "view", F.concat(F.lit("f"), F.col("event_id").cast("string"),
                                                       F.lit(".txt"))).alias("name"),
        F.when(F.col("event_type") != "click", F.col("k")).alias("size"),
        F.col("event_type").alias("content")))
    cpay = F.to_json(F.struct(
        F.when(F.col("event_type") != "error", F.concat(F.lit("Item "), F.col("event_id").cast("string")))
        .alias("title"),
        F.when(F.col("event_type") != "signup", F.col("event_id").cast("int")).alias("number")))
    f = PL.file_contents(fpay)
    c = PL.created_item(cpay)
    return e.select("event_id", f["name"].alias("file_name"), f["size"].alias("file_size"),
                    f["content"].alias("content"), c["title"].alias("title"),
                    c["number"].alias("number"), c["url"].alias("url"))


@register("eval_label_histogram")
def q_eval_label_histogram(spark, sf):
    h = EV.label_histogram(_kb_means(spark, sf))
    return h.select("label", F.col("n").cast("bigint").alias("n"))


@register("doc_previews")
def q_doc_previews(spark, sf):
    from sifter.functions.text import preview
    d = T.documents(spark, sf)
    return d.select("doc_id", preview("text", 200).alias("preview_200"),
                    preview("text", 50).alias("preview_50"))


@register("extract_json")
def q_extract_json(spark, sf):
    e = T.load(spark, sf, "events")
    noisy = F.concat(F.lit("Model says: "), F.col("props"), F.lit(" (end of "), F.col("event_type"),
                     F.lit(")"))
    obj = CU.extract_json_object(noisy)
    return e.select("event_id", obj.alias("json_text"),
                    F.from_json(obj, "k bigint")["k"].alias("k"))


@register("chunk_metadata")
def q_chunk_metadata(spark, sf):
    docs = T.documents(spark, sf)
    meta = docs.select("doc_id", F.create_map(F.lit("source"), F.col("source"), F.lit("lang"),
                                              F.col("lang"), F.lit("kb_name"), F.lit("raw")).alias("metadata"))
    ch = C.with_metadata(C.token_chunks(docs, 512, 50, kb_col=F.col("source")), meta)
    return ch.select("chunk_id", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")),
                                                          lambda e: F.concat(e["key"], F.lit("="), e["value"])),
                                              ";").alias("metadata"))
