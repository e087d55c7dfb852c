"""From a chunk store to ranked answers.

``retrieve`` asks a table of questions of a table of knowledge bases. How each one is searched comes from its own
catalog row: semantic or hybrid search with its alpha, reranking with its depth. Knowledge bases of equal configuration
are searched together; the plan is the union of one branch per configuration (a catalog has few).

``answer`` puts the ranked chunks of a (knowledge base, question) into the prompt, runs a generator and returns one nested
row. A user's generator is a loader for :func:`sifter.hooks.isolated`: it is loaded once a task, and a row it fails on
keeps its ranked chunks and gets the reference's error answer with the reason beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter import hooks
from sifter.functions import formatting as fmt
from sifter.operators import retrieval as R
from sifter.plans.sizing import bounded_broadcast, mark_bounded

# Fixed value: the answer of a question whose generator failed.
FAILED_ANSWER = "Error generating answer with LLM"
SETTINGS = ["use_hybrid_search", "hybrid_alpha", "use_reranking", "reranker_model", "reranker_top_k"]


def chunk_index(chunks: DataFrame, kb_col: str = "kb_name") -> DataFrame:
    """The retrieval index of a chunk store: one row per chunk, grouped by knowledge base."""
    return R.build_index(chunks.withColumnRenamed(kb_col, "kb_name"), id_col="chunk_id", text_col="text",
                         group_col="kb_name")


def configurations(catalog: DataFrame) -> list[tuple[dict, list[str]]]:
    """The distinct search settings of a catalog with their knowledge bases (one row a knowledge base: a
    small table). Settings that a search does not use are left out of the comparison."""
    found: dict[tuple, list[str]] = {}
    for r in catalog.select("name", *SETTINGS).collect():
        key = (r["use_hybrid_search"], r["hybrid_alpha"] if r["use_hybrid_search"] else None, r["use_reranking"],
               r["reranker_model"] if r["use_reranking"] else None, r["reranker_top_k"] if r["use_reranking"] else None)
        found.setdefault(key, []).append(r["name"])
    return [(dict(zip(SETTINGS, key)), sorted(names)) for key, names in sorted(found.items(), key=repr)]


def _branch(index: DataFrame, chunks: DataFrame, questions: DataFrame, settings: dict, names: list[str], k: int,
            scorer) -> DataFrame:
    """The knowledge bases of one configuration."""
    mine = F.col("kb_name").isin(names)  # a catalog's names
    index, chunks = index.where(mine), chunks.where(mine)
    hybrid, rerank = bool(settings["use_hybrid_search"]), bool(settings["use_reranking"])
    qside = R.prepare_questions(index, questions, group_col="kb_name", keyword=hybrid)
    first_k = max(k, settings["reranker_top_k"]) if rerank else k
    found = R.advanced_retrieval(
        index, qside, questions, chunks.withColumnRenamed("chunk_id", "doc_key").select(
            "kb_name", F.col("doc_key").alias("doc_id"), "text"), k=k, use_hybrid=hybrid, use_reranking=rerank,
        reranker_top_k=first_k, alpha=settings["hybrid_alpha"] if hybrid else R.HYBRID_ALPHA, scorer=scorer)
    method = R.search_method_description(
        F.lit(hybrid), F.lit(settings["hybrid_alpha"] if hybrid else R.HYBRID_ALPHA), F.lit(rerank),
        F.lit(settings["reranker_model"] or ""))
    out = found.select("kb_name", F.col("query_id").alias("question_id"), "rank", F.col("doc_id").alias("chunk_id"),
                       "score", method.alias("search_method"))
    return mark_bounded(out, qside._sifter_rows * k)


def retrieve(catalog: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = R.DEFAULT_TOP_K,
             index: DataFrame | None = None, scorer=R.token_overlap_score) -> DataFrame:
    """``kb_name, question_id, rank, chunk_id, score, search_method`` for every question of every
    knowledge base in ``catalog``; ``chunks`` has ``kb_name, doc_id, chunk_id, text``. An ``index``
    (:func:`chunk_index`, stored) can be passed to serve many batches."""
    index = chunk_index(chunks) if index is None else index
    out, rows = None, 0
    for settings, names in configurations(catalog):
        branch = _branch(index, chunks, questions, settings, names, k, scorer)
        rows += branch._sifter_rows
        out = branch if out is None else out.unionByName(branch)
    if out is None:
        return questions.sparkSession.createDataFrame(
            [], "kb_name string, question_id bigint, rank int, chunk_id string, score double, search_method string")
    return mark_bounded(out, rows)


def with_content(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked rows with their chunk's document and text (a late look-up of at most questions x k rows)."""
    side = bounded_broadcast(ranked)
    return chunks.select("kb_name", "chunk_id", "doc_id", F.col("text").alias("content")).join(
        side, ["kb_name", "chunk_id"])


def answer(ranked: DataFrame, questions: DataFrame, generator: Callable[[Column], Column] = hooks.default_generator,
           load: Callable | None = None) -> DataFrame:
    """One row per (knowledge base, question): ``kb_name, question_id, question, top_k, search_method, prompt,
    answer, answer_error, documents ARRAY<STRUCT<rank, chunk_id, doc_id, relevance_score, content>>``.

    ``ranked`` comes from :func:`with_content`. ``generator`` is a Column function of the contexts; ``load``
    instead names a loader whose model maps a frame with ``prompt`` and ``question`` to answers, a row at fault keeping its
    documents.
    """
    nested = ranked.groupBy("kb_name", "question_id", "search_method").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "chunk_id", "doc_id", F.col("score").alias("relevance_score"), "content"))).alias("documents"))  # k rows
    rows = nested.join(bounded_broadcast(questions.select("question_id", "question")), "question_id")
    contexts = F.transform("documents", lambda d: d["content"])
    rows = rows.select("kb_name", "question_id", "question", F.size("documents").alias("top_k"), "search_method",
                       fmt.rag_prompt(contexts, "question").alias("prompt"), "documents")
    if load is None:
        done = rows.withColumn("answer", generator(F.transform("documents", lambda d: d["content"]))).withColumn(
            "answer_error", F.lit(None).cast("string"))
    else:
        done = hooks.isolated(rows, load, ["prompt", "question"], "answer", "string").withColumn(
            "answer", F.when(F.col("answer_error").isNotNull(), F.lit(FAILED_ANSWER)).otherwise(F.col("answer")))
    return done.select("kb_name", "question_id", "question", "top_k", "search_method", "prompt", "answer",
                       "answer_error", "documents")
