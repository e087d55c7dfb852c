"""Corrective retrieval (J11-J15), run comparison (J16) and default questions.

The reference runs a per-question agent graph (retrieve -> grade -> rewrite ->
retrieve ...) with no enforced bound. Here every round is one DataFrame job
over *all* still-active questions: retrieve top-k, grade, finish the
relevant ones, rewrite the rest. The loop runs at most ``max_retries + 1``
rounds (the declared bound is enforced); the small active set is cut from
its lineage with a reliable checkpoint each round.

Hooks (Column functions, native by default):
* router(question) -> boolean: retrieve (True) or answer directly (J15);
* grader(top_score) -> boolean: relevant (J11), default score >= 0.7; or
  ``grade(question, contexts, top_score)``, which sees the retrieved texts (``docs`` has to be given);
* rewriter(question, contexts) -> string: the new question (J12); the default appends the
  ``rewrite_terms`` highest-idf terms of the top context that the question lacks.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sifter.functions.text import tokenize
from sifter.operators import retrieval as R
from sifter.plans.sizing import bounded_broadcast, mark_bounded
from sifter.session import cut_lineage

# Grading threshold, retry bound and trace labels.
GRADING_THRESHOLD = 0.7
MAX_RETRIES = 2
TRACE_RETRIEVE = "🔍 Retrieved documents"
TRACE_GRADE = "📄 Document grading"
TRACE_REWRITE = "✍️ Question rewritten"
REWRITE_TERMS = 3


def default_router(question):
    """J15 default: retrieve whenever the question has a token; else answer directly."""
    return F.size(tokenize(question)) > 0


def default_grader(top_score):
    return F.coalesce(top_score >= GRADING_THRESHOLD, F.lit(False))


def _rewrite(active: DataFrame, top_doc: DataFrame, index: DataFrame,
             vocab: DataFrame, n_active: int, n_terms: int = REWRITE_TERMS) -> DataFrame:
    """J12 default: question + the ``n_terms`` highest-idf terms of its top
    context that the question does not contain (ties by term).

    Only the active questions' top documents are read from the index (a
    broadcast of at most one row per question), and their terms are broadcast
    into the term-dictionary scan.
    """
    tops = bounded_broadcast(mark_bounded(top_doc, n_active))
    doc_terms = index.select("doc_id", "tf").join(tops, "doc_id")
    q_toks = bounded_broadcast(mark_bounded(
        active.select("query_id", tokenize("question").alias("_qt")), n_active))
    terms = (doc_terms.join(q_toks, "query_id")
             .select("query_id", "_qt", F.explode(F.map_keys("tf")).alias("term"))
             .where(~F.array_contains("_qt", F.col("term"))).drop("_qt"))
    terms = vocab.join(bounded_broadcast(terms), "term")
    w = Window.partitionBy("query_id").orderBy(F.asc("df"), F.asc("term"))
    picked = (terms.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_terms)
              .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_r", "term"))).alias("_t")))
    return (active.join(picked, "query_id", "left")
            .withColumn("question", F.when(F.col("_t").isNull(), F.col("question")).otherwise(
                F.concat_ws(" ", F.col("question"), F.array_join(F.transform("_t", lambda x: x["term"]), " "))))
            .drop("_t"))


def corrective_retrieval(index: DataFrame, questions: DataFrame, k: int = 5,
                         max_retries: int = MAX_RETRIES, router=default_router,
                         grader=default_grader, q_id: str = "question_id",
                         q_text: str = "question", stats: R.IndexStats | None = None,
                         docs: DataFrame | None = None, grade=None, rewriter=None,
                         rewrite_terms: int = REWRITE_TERMS) -> DataFrame:
    """``question_id, question (final), rounds, relevant, routed,
    trace, message_count, doc_ids`` (top-k of the last retrieval)."""
    state = questions.select(F.col(q_id).alias("query_id"), F.col(q_text).alias("question"),
                             F.col(q_text).alias("original"))
    routed = state.withColumn("routed", router(F.col("question")))
    direct = (routed.where(~F.col("routed"))
              .select("query_id", "original", "question", F.lit(0).alias("rounds"),
                      F.lit(False).alias("relevant"), "routed",
                      F.array().cast("array<string>").alias("trace"),
                      F.array().cast("array<bigint>").alias("doc_ids")))
    active = cut_lineage(routed.where(F.col("routed")).drop("routed")
                         .withColumn("trace", F.array().cast("array<string>")))
    finished = [direct]
    if (grade or rewriter) and docs is None:
        raise ValueError("grade and rewriter read the retrieved texts: pass docs")
    stats = stats or (None if rewriter else R.index_stats(index))
    for rnd in range(max_retries + 1):
        n_active = active.count()
        if n_active == 0:
            break
        qside = R.prepare_questions(index, active.select(
            F.col("query_id").alias("question_id"), "question"), keyword=False)
        # The round's top-k (active x k rows) feeds grading, the finished rows
        # and the rewrite: materialise it once instead of rescoring.
        top = mark_bounded(cut_lineage(R.semantic_topk(index, qside, k)), n_active * k)
        per_q = top.groupBy("query_id").agg(
            F.max("score").alias("top_score"),
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))),
                        lambda x: x["doc_id"]).alias("doc_ids"))
        if docs is not None:  # at most k texts a question, looked up late
            texts = docs.select("doc_id", F.col("text").alias("_t")).join(bounded_broadcast(top), "doc_id")
            per_q = per_q.join(texts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(
                F.struct("rank", "_t"))), lambda x: x["_t"]).alias("contexts")), "query_id", "left")
        else:
            per_q = per_q.withColumn("contexts", F.lit(None).cast("array<string>"))
        verdict = (grade(F.col("question"), F.col("contexts"), F.col("top_score")) if grade
                   else grader(F.col("top_score")))
        graded = (active.join(per_q, "query_id", "left")
                  .withColumn("relevant", F.coalesce(verdict, F.lit(False)))
                  .withColumn("trace", F.concat("trace", F.array(F.lit(TRACE_RETRIEVE),
                                                                 F.lit(TRACE_GRADE)))))
        last = rnd == max_retries
        done = graded.where(F.col("relevant") | F.lit(last)).select(
            "query_id", "original", "question", F.lit(rnd + 1).alias("rounds"), "relevant",
            F.lit(True).alias("routed"), "trace",
            F.coalesce("doc_ids", F.array().cast("array<bigint>")).alias("doc_ids"))
        finished.append(cut_lineage(done))
        if last:
            break
        todo = graded.where(~F.col("relevant"))
        if rewriter:
            rewritten = todo.withColumn("question", F.coalesce(
                rewriter(F.col("question"), F.col("contexts")), F.col("question")))
        else:
            top_doc = top.where(F.col("rank") == 1).select("query_id", "doc_id")
            rewritten = _rewrite(todo.select("query_id", "question", "original", "trace"), top_doc,
                                 index, stats.vocab, n_active, rewrite_terms)
        active = cut_lineage(rewritten.withColumn(
            "trace", F.concat("trace", F.array(F.lit(TRACE_REWRITE)))).select(
            "query_id", "question", "original", "trace"))
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    msg = 2 + 2 * F.col("rounds") + F.size(F.filter("trace", lambda t: t == TRACE_REWRITE))
    return out.select(F.col("query_id").alias("question_id"), "original", "question", "rounds",
                      "relevant", "routed", F.array_join("trace", " → ").alias("trace"),
                      msg.cast("int").alias("message_count"), "doc_ids")


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Two ranked runs (keys..., rank, doc_id) side by side per question:
    overlap, Jaccard and mean absolute rank delta of shared documents."""
    keys = keys or ["query_id"]
    j = (a.select(*keys, "doc_id", F.col("rank").alias("rank_a"))
         .join(b.select(*keys, "doc_id", F.col("rank").alias("rank_b")), keys + ["doc_id"], "full"))
    both = F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull()
    return j.groupBy(*keys).agg(
        F.sum(both.cast("int")).alias("overlap"),
        (F.sum(both.cast("int")) / F.count(F.lit(1))).alias("jaccard"),
        F.avg(F.when(both, F.abs(F.col("rank_a") - F.col("rank_b")))).alias("mean_rank_delta"),
        F.count(F.col("rank_a")).alias("n_a"), F.count(F.col("rank_b")).alias("n_b"))


def timed(run) -> tuple[DataFrame, float]:
    """A run's rows, computed and stored, and the seconds that took."""
    began = time.time()
    out = cut_lineage(run())
    return out, time.time() - began


def side_by_side(direct, corrective, questions: DataFrame, q_id: str = "question_id",
                 q_text: str = "question") -> DataFrame:
    """Two ways of answering the same questions, one row per question: ``question, direct_ids, corrective_ids,
    overlap, rounds, steps, trace, direct_seconds, corrective_seconds`` (of the whole batch).

    ``direct`` returns ranked rows (``query_id, rank, doc_id``), ``corrective`` the rows of
    :func:`corrective_retrieval`; both are functions, so that each is timed.
    """
    a, a_seconds = timed(direct)
    b, b_seconds = timed(corrective)
    ids = a.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))),
                                                lambda x: x["doc_id"]).alias("direct_ids"))  # k rows
    none = F.array().cast(dict(b.dtypes)["doc_ids"])
    return (questions.select(F.col(q_id).alias("query_id"), F.col(q_text).alias("question"))
            .join(ids, "query_id", "left")
            .join(b.select(F.col("question_id").alias("query_id"), "rounds", "trace", "doc_ids"), "query_id", "left")
            .select("query_id", "question", F.coalesce("direct_ids", none).alias("direct_ids"),
                    F.coalesce("doc_ids", none).alias("corrective_ids"),
                    F.size(F.array_intersect(F.coalesce("direct_ids", none), F.coalesce("doc_ids", none))).alias("overlap"),
                    "rounds", F.when(F.coalesce("trace", F.lit("")) == "", 0).otherwise(
                        F.size(F.split("trace", " → "))).alias("steps"), "trace",
                    F.lit(a_seconds).alias("direct_seconds"), F.lit(b_seconds).alias("corrective_seconds")))


def default_questions(spark, n: int = 10) -> DataFrame:
    """The fixed list of generic questions, first n (the retrieval the
    reference runs before returning them is ignored, so none is run here)."""
    from sifter.operators.evaluation import DEFAULT_QUESTIONS
    rows = [(i, q) for i, q in enumerate(DEFAULT_QUESTIONS[:n])]
    return spark.createDataFrame(rows, "question_id bigint, question string")
