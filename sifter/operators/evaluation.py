"""Retrieval evaluation as table jobs.

Per-question metrics are row-local expressions over ``question, answer,
contexts ARRAY<STRING>, ground_truths ARRAY<STRING>``; the default judge is
token containment (share of a statement's distinct tokens found in the
reference) >= 0.5, so no model is needed. A ``Judge`` hook can replace it
with any Column function ``(statement, reference_tokens) -> boolean``.
Aggregates (means, best/worst, pivots) are grouped aggregations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.functions.formatting import evaluation_run_id
from sifter.functions.text import _c, explode_positions, let, split_sentences, tokenize
from sifter.functions.vectors import entries_cosine, hashed_entries
from sifter.operators.retrieval import held_terms
from sifter.plans.sizing import bounded_broadcast, literal_dimension, mark_bounded

# Metric names, interpretations, label thresholds, recommendation rules.
METRICS = ["faithfulness", "answer_relevancy", "context_precision", "context_recall",
           "answer_correctness", "answer_similarity"]
METRIC_INTERPRETATION = {
    "context_precision": "Signal-to-noise ratio of retrieved context",
    "context_recall": "Coverage of relevant information in retrieved context",
    "faithfulness": "Factual accuracy of generated answers",
    "answer_relevancy": "Relevance of answers to questions",
    "answer_correctness": "Overall correctness of answers",
    "answer_similarity": "Semantic similarity to ground truth",
}
LABELS = [(0.9, "🟢 Excellent"), (0.8, "🟡 Good"), (0.7, "🟠 Fair")]
LABEL_OTHERWISE = "🔴 Needs Improvement"
RECOMMENDATIONS = [
    ("context_precision", 0.7, "🔍 **Improve Retrieval Precision**: Consider tuning chunk size, "
                               "using hybrid search, or improving query preprocessing"),
    ("context_recall", 0.7, "📚 **Improve Context Coverage**: Increase retrieved documents count "
                            "or improve chunking strategy"),
    ("faithfulness", 0.8, "✅ **Improve Answer Faithfulness**: Fine-tune LLM prompts or use better "
                          "instruction-following models"),
    ("answer_relevancy", 0.8, "🎯 **Improve Answer Relevancy**: Optimize prompts to ensure answers "
                              "directly address questions"),
]
EXCELLENT = "🎉 **Excellent Performance**: Your RAG pipeline is performing well across all metrics!"
FALLBACK_PREFIX = "Based on the context: "
NO_CONTEXT = "No context retrieved"
ERROR_ANSWER = "Error generating answer"
CONTAINMENT = 0.5
CORRECTNESS_WEIGHTS = (0.75, 0.25)
DEFAULT_QUESTIONS = [
    "What is the main topic discussed in the documents?",
    "What are the key features mentioned?",
    "How does this work?",
    "What are the benefits?",
    "What are the requirements?",
    "How do you get started?",
    "What are the best practices?",
    "What should you avoid?",
    "Who is the target audience?",
    "What are the next steps?",
]


# ------------------------------------------------------------------- K1 / J10

def evaluation_rows(ranked: DataFrame, questions: DataFrame, docs: DataFrame,
                    keys: list[str], q_id: str = "question_id", q_text: str = "question",
                    d_id: str = "doc_id", d_text: str = "text",
                    ground_truths: DataFrame | None = None, answers: DataFrame | None = None,
                    ) -> DataFrame:
    """K1: one row per question (per key) with answer, contexts in rank order
    and optional ground truths.

    ``ranked`` holds ``keys..., rank, doc_id`` (k rows per question, bounded);
    texts are fetched late by broadcasting it into the document scan. A
    question without any retrieved row gets the reference's error answer and
    context list (J10). Without a generator, the answer is the extractive
    fallback: first 200 characters of the top context.
    """
    gkeys = [k for k in keys if k != "query_id"]
    r = bounded_broadcast(ranked.select(*keys, "rank", "doc_id"))
    texts = docs.select(*gkeys, F.col(d_id).alias("doc_id"), F.col(d_text).alias("_t")).join(
        r, gkeys + ["doc_id"])
    ctx = texts.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "_t"))), lambda x: x["_t"]).alias("contexts"))
    q = questions.select(F.col(q_id).alias("query_id"), F.col(q_text).alias("question"))
    if gkeys:
        grid = ranked.select(*gkeys).distinct()
        q = bounded_broadcast(grid).crossJoin(q)
    rows = q.join(ctx, keys, "left")
    if answers is not None:
        rows = rows.join(answers, keys, "left")
    else:
        rows = rows.withColumn("generated", F.lit(None).cast("string"))
    fallback = F.concat(F.lit(FALLBACK_PREFIX), F.substring(F.element_at("contexts", 1), 1, 200),
                        F.lit("..."))
    rows = rows.select(
        *keys, "question",
        F.when(F.col("contexts").isNull(), F.lit(ERROR_ANSWER))
        .otherwise(F.coalesce(F.col("generated"), fallback)).alias("answer"),
        F.coalesce(F.col("contexts"), F.array(F.lit(NO_CONTEXT))).alias("contexts"))
    if ground_truths is not None:
        rows = rows.join(ground_truths.select(F.col(q_id).alias("query_id"), "ground_truths"),
                         "query_id", "left")
    else:
        rows = rows.withColumn("ground_truths", F.lit(None).cast("array<string>"))
    return rows


def evaluation_term_rows(ranked: DataFrame, questions: DataFrame, docs: DataFrame, index: DataFrame,
                         keys: list[str], q_id: str = "question_id", q_text: str = "question",
                         d_id: str = "doc_id", d_text: str = "text",
                         ground_truths: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """K1 without texts: ``keys, question, answer, ground_truths, context_ids, context_terms``.

    ``context_terms`` holds, per context in rank order, those of the row's own terms (of its answer and its ground
    truth) that the context holds, from the term keys of the document ``index``; the metrics ask for nothing
    else (:func:`score_rows` takes either form). Of a context's text only the 200 characters of an extractive answer
    are read, for the first rank. A question without a context holds the reference's placeholder context.
    """
    gkeys = [k for k in keys if k != "query_id"]
    n = getattr(ranked, "_sifter_rows", None)
    keep = (lambda df: mark_bounded(df, n)) if n is not None else (lambda df: df)
    firsts = bounded_broadcast(keep(ranked.where(F.col("rank") == 1).select(*keys, "doc_id")))
    starts = docs.select(*gkeys, F.col(d_id).alias("doc_id"), F.substring(d_text, 1, 200).alias("_start")).join(
        firsts, gkeys + ["doc_id"]).select(*keys, "_start")
    q = questions.select(F.col(q_id).alias("query_id"), F.col(q_text).alias("question"))
    if gkeys:
        q = bounded_broadcast(ranked.select(*gkeys).distinct()).crossJoin(q)
    rows = q.join(starts, keys, "left")
    rows = (rows.join(answers, keys, "left") if answers is not None
            else rows.withColumn("generated", F.lit(None).cast("string")))
    fallback = F.concat(F.lit(FALLBACK_PREFIX), F.col("_start"), F.lit("..."))
    rows = rows.select(*keys, "question", F.when(F.col("_start").isNull(), F.lit(ERROR_ANSWER)).otherwise(
        F.coalesce(F.col("generated"), fallback)).alias("answer"))
    if ground_truths is not None:
        rows = rows.join(ground_truths.select(F.col(q_id).alias("query_id"), "ground_truths"), "query_id", "left")
    else:
        rows = rows.withColumn("ground_truths", F.lit(None).cast("array<string>"))
    own = F.array_distinct(F.concat(tokenize("answer"), F.coalesce(
        tokenize(_gt_text(F.col("ground_truths"))), F.array().cast("array<string>"))))
    rows = rows.withColumn("_own", own)
    side = bounded_broadcast(keep(ranked.select(*keys, "rank", "doc_id").join(rows.select(*keys, "_own"), keys)))
    packed = getattr(index, "_sifter_packed", None)  # its terms are taken apart after the join
    held = (packed.select(*gkeys, "doc_id", F.col("terms").alias("_held")) if packed is not None
            else index.select(*gkeys, "doc_id", F.map_keys("tf").alias("_held"))).join(side, gkeys + ["doc_id"])
    terms = held_terms(F.col("_held")) if packed is not None else F.col("_held")
    found = held.select(*keys, "rank", "doc_id", F.array_intersect("_own", terms).alias("_t")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id", "_t"))).alias("_c"))  # k contexts
    none = F.array(F.array_intersect("_own", tokenize(F.lit(NO_CONTEXT))))
    return rows.join(found, keys, "left").select(
        *keys, "question", "answer", "ground_truths", F.transform("_c", lambda c: c["doc_id"]).alias("context_ids"),
        F.coalesce(F.transform("_c", lambda c: c["_t"]), none).alias("context_terms"))


# ------------------------------------------------------------- judge helpers

def containment(statement_tokens: Column, reference_set: Column) -> Column:
    """Share of the distinct statement tokens present in the reference token set."""
    return let(F.array_distinct(statement_tokens), lambda s: F.when(
        F.size(s) == 0, F.lit(None).cast("double")).otherwise(
        F.size(F.array_intersect(s, reference_set)) / F.size(s)))


def token_judge(statement: Column, reference_set: Column) -> Column:
    """Default judge: a statement is supported when >= 50% of its distinct
    tokens occur in the reference; NULL when the statement has no token."""
    return let(containment(tokenize(statement), reference_set), lambda c: F.when(
        c.isNull(), F.lit(None).cast("boolean")).otherwise(c >= CONTAINMENT))


def _token_set(texts: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(texts, tokenize)))


def _mean_bool(flags: Column) -> Column:
    """Mean of the non-NULL booleans of an array; NULL when none."""
    return let(F.filter(flags, lambda x: x.isNotNull()), lambda f: F.when(
        F.size(f) == 0, F.lit(None).cast("double")).otherwise(
        F.aggregate(f, F.lit(0.0), lambda a, x: a + F.when(x, 1.0).otherwise(0.0)) / F.size(f)))


def _gt_text(gt: Column) -> Column:
    return F.when(F.size(gt) > 0, F.array_join(gt, " "))


# ----------------------------------------------------------------- K2 - K7

def faithfulness(answer, contexts, judge=token_judge, ctx_set=None) -> Column:
    """K2: supported answer claims (sentences) / claims.

    ``ctx_set`` may pass the contexts' distinct tokens when already computed."""
    ref_set = _c(ctx_set) if ctx_set is not None else _token_set(_c(contexts))
    return let(ref_set, lambda ref: _mean_bool(
        F.transform(split_sentences(answer), lambda c: judge(c, ref))))


def answer_relevancy(question, answer, derive=None) -> Column:
    """K3: cosine(question, question derived from the answer); default hook = the answer."""
    derived = derive(_c(answer)) if derive else _c(answer)
    return entries_cosine(hashed_entries(tokenize(question)), hashed_entries(tokenize(derived)))


def context_precision(contexts, reference, judge=token_judge, ctx_tokens=None) -> Column:
    """K4: sum_k(precision@k * v_k) / sum_k v_k, v_k = context k supports the reference, by the judge.

    ``ctx_tokens`` may pass each context's distinct tokens when already computed."""
    per_ctx = (_c(ctx_tokens) if ctx_tokens is not None
               else F.transform(_c(contexts), lambda ctx: F.array_distinct(tokenize(ctx))))

    def verdicts(ref):
        if judge is token_judge:  # the reference is tokenised once for all contexts
            return let(F.array_distinct(tokenize(ref)), lambda toks: F.transform(per_ctx, lambda ct: F.coalesce(
                containment(toks, ct) >= CONTAINMENT, F.lit(False))))
        return F.transform(per_ctx, lambda ct: F.coalesce(judge(ref, ct), F.lit(False)))

    def score(v):
        hits = F.transform(v, lambda x: F.when(x, 1.0).otherwise(0.0))
        num = F.aggregate(F.transform(hits, lambda h, i: h * F.aggregate(
            F.slice(hits, 1, i + 1), F.lit(0.0), lambda a, y: a + y) / (i + 1)),
            F.lit(0.0), lambda a, y: a + y)
        den = F.aggregate(hits, F.lit(0.0), lambda a, y: a + y)
        return F.when(den == 0, F.lit(0.0)).otherwise(num / den)

    return let(let(_c(reference), verdicts), score)


def context_recall(contexts, ground_truths, judge=token_judge, ctx_set=None) -> Column:
    """K5: ground-truth sentences attributable to the contexts / all."""
    gt = _gt_text(_c(ground_truths))
    ref_set = _c(ctx_set) if ctx_set is not None else _token_set(_c(contexts))
    return F.when(gt.isNull(), F.lit(None).cast("double")).otherwise(
        let(ref_set, lambda ref: _mean_bool(
            F.transform(split_sentences(gt), lambda s: judge(s, ref)))))


def answer_similarity(answer, ground_truths) -> Column:
    """K6: cosine(answer, ground truth)."""
    gt = _gt_text(_c(ground_truths))
    return F.when(gt.isNull(), F.lit(None).cast("double")).otherwise(
        entries_cosine(hashed_entries(tokenize(answer)), hashed_entries(tokenize(gt))))


def answer_correctness(answer, ground_truths, judge=token_judge) -> Column:
    """K7: 0.75 * F1(claims) + 0.25 * similarity, F1 = TP / (TP + (FP + FN) / 2)."""
    gt = _gt_text(_c(ground_truths))
    w_f1, w_sim = CORRECTNESS_WEIGHTS

    def body(ans_set, gt_set):
        claims = F.filter(F.transform(split_sentences(answer), lambda c: judge(c, gt_set)),
                          lambda x: x.isNotNull())
        stmts = F.filter(F.transform(split_sentences(gt), lambda s: judge(s, ans_set)),
                         lambda x: x.isNotNull())
        tp = F.size(F.filter(claims, lambda x: x))
        fp = F.size(claims) - tp
        fn = F.size(F.filter(stmts, lambda x: ~x))
        f1 = F.when(tp + 0.5 * (fp + fn) == 0, F.lit(0.0)).otherwise(tp / (tp + 0.5 * (fp + fn)))
        return F.lit(w_f1) * f1 + F.lit(w_sim) * answer_similarity(answer, ground_truths)

    return F.when(gt.isNull(), F.lit(None).cast("double")).otherwise(
        let(F.array_distinct(tokenize(answer)), lambda a: let(
            F.array_distinct(tokenize(gt)), lambda g: body(a, g))))


def default_metrics(has_ground_truths: bool) -> list[str]:
    """Faithfulness + answer_relevancy, plus context_recall with ground truths."""
    return ["faithfulness", "answer_relevancy"] + (["context_recall"] if has_ground_truths else [])


@dataclass(frozen=True)
class MetricInputs:
    """What a metric's row expression may use. ``contexts`` is null for rows without texts; ``context_terms`` are the
    contexts' distinct tokens (at least those of the row's own answer and ground truth), ``term_set`` their union."""
    question: Column
    answer: Column
    ground_truths: Column
    contexts: Column
    context_terms: Column
    term_set: Column
    judge: Callable = token_judge
    derive: Callable | None = None

    @property
    def reference(self) -> Column:
        return F.coalesce(_gt_text(self.ground_truths), self.answer)


@dataclass(frozen=True)
class Metric:
    """A metric as mergeable pieces: ``row`` gives a value per question; ``partial`` turns the value column
    into named aggregates of a group, ``merge`` aggregates those of several batches under the same names, and ``finish``
    makes the score of them. The defaults are the exact mean of D1."""
    name: str
    row: Callable[[MetricInputs], Column]
    partial: Callable[[Column], dict[str, Column]] | None = None
    merge: Callable[[str], Column] = F.sum
    finish: Callable[[dict[str, Column]], Column] | None = None


def _register(name: str, row) -> None:
    REGISTRY[name] = Metric(name, row)


REGISTRY: dict[str, Metric] = {}
_register("faithfulness", lambda r: faithfulness(r.answer, None, r.judge, r.term_set))
_register("answer_relevancy", lambda r: answer_relevancy(r.question, r.answer, r.derive))
_register("context_precision", lambda r: context_precision(None, r.reference, r.judge, r.context_terms))
_register("context_recall", lambda r: context_recall(None, r.ground_truths, r.judge, r.term_set))
_register("answer_similarity", lambda r: answer_similarity(r.answer, r.ground_truths))
_register("answer_correctness", lambda r: answer_correctness(r.answer, r.ground_truths, r.judge))


def register_metric(metric: Metric) -> None:
    """Make a metric known by name to B4, D1 and K8."""
    REGISTRY[metric.name] = metric


def split_metrics(names: list[str]) -> tuple[list[str], list[str]]:
    """The known names in requested order, and the unknown ones."""
    return [n for n in names if n in REGISTRY], [n for n in names if n not in REGISTRY]


def select_metrics(names: list[str]) -> list[str]:
    """Keep known metric names in requested order (:func:`split_metrics` also returns the
    others); error when none is left."""
    kept = split_metrics(names)[0]
    if not kept:
        raise ValueError("No valid metrics specified")
    return kept


def score_rows(rows: DataFrame, metrics: list[str], keys: list[str], judge=token_judge, derive=None) -> DataFrame:
    """Per-question metric values in long form ``keys..., metric, value``. ``rows`` come from
    :func:`evaluation_rows` or :func:`evaluation_term_rows`; a judge or deriver of one's own replaces the defaults."""
    chosen = select_metrics(metrics)
    # Tokenise each context once per row; the metrics share the token lists.
    if "context_terms" in rows.columns:
        rows = rows.withColumn("_ctx_tokens", F.col("context_terms"))
        texts = F.lit(None).cast("array<string>")
    else:
        rows = rows.withColumn("_ctx_tokens", F.transform("contexts", lambda c: F.array_distinct(tokenize(c))))
        texts = F.col("contexts")
    rows = rows.withColumn("_ctx_set", F.array_distinct(F.flatten("_ctx_tokens")))
    inputs = MetricInputs(F.col("question"), F.col("answer"), F.col("ground_truths"), texts, F.col("_ctx_tokens"),
                          F.col("_ctx_set"), judge, derive)
    wide = rows.select(*keys, *[REGISTRY[m].row(inputs).alias(m) for m in chosen])
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                    for m in chosen])
    return explode_positions(wide, arr, "_p", "mv", *keys).select(*keys, "mv.metric", "mv.value")


# ------------------------------------------------------------------ D1 - D5

QUANTUM = 10 ** 12      # per-value quantisation (integers are summed exactly)
MEAN_DIGITS = 6         # means are exact decimals with 6 places


def exact_mean(value: Column, digits: int = MEAN_DIGITS) -> tuple[Column, Column]:
    """Aggregate pieces of an order-independent mean.

    Returns ``(sum, count)`` aggregate columns over values quantised to 1e-12
    as DECIMAL(38, 0): sums below 1e26 in value are exact, and larger ones raise.
    :func:`finish_mean` turns them into the mean rounded half-up to
    ``digits`` places with integer arithmetic, so every engine and every
    summation order gives the same double (no float ties at the last place).
    """
    q = F.round(value * F.lit(float(QUANTUM)), 0).cast("decimal(38,0)")
    return F.sum(q), F.count(q)


def finish_mean(s: Column, n: Column, digits: int = MEAN_DIGITS) -> Column:
    """floor((2 s + d) / (2 d)) with the remainder taken off first: decimal division
    alone would round at its last place before ``floor`` sees the value."""
    d = n.cast("decimal(20,0)") * F.lit(QUANTUM // 10 ** digits).cast("decimal(14,0)")
    num = (s * 2 + d).cast("decimal(38,0)")
    den = d * 2
    q = (num - F.pmod(num, den)) / den
    return F.when(n > 0, q.cast("double") / F.lit(float(10 ** digits)))


def _mean_partial(value: Column) -> dict[str, Column]:
    v = F.when(F.isnan(value), F.lit(None)).otherwise(value)
    total, n = exact_mean(v)
    return {"total": total, "n": n}


def _mean_finish(parts: dict[str, Column]) -> Column:
    return finish_mean(parts["total"].cast("decimal(38,0)"), parts["n"].cast("bigint"))


def _pieces(metric: Metric) -> tuple[Callable, Callable]:
    return metric.partial or _mean_partial, metric.finish or _mean_finish


def _for_metric(col: str, name: str) -> Column:
    return F.when(F.col("metric") == name, F.col(col))


def metric_partials(long: DataFrame, group_cols: list[str], names: list[str] | None = None) -> DataFrame:
    """Mergeable partial results of a batch: ``group..., metric, parts MAP<STRING, STRING>``. Metrics that were not
    registered have the mean's pieces."""
    special = [REGISTRY[m] for m in (names or REGISTRY) if m in REGISTRY and REGISTRY[m].partial]
    plain = _mean_partial(F.col("value"))
    aggs = [c.cast("string").alias(f"_0_{k}") for k, c in plain.items()]
    packed = F.create_map(*[x for k in plain for x in (F.lit(k), F.col(f"_0_{k}"))])
    for i, m in enumerate(special, 1):
        pieces = m.partial(_for_metric("value", m.name))
        aggs += [c.cast("string").alias(f"_{i}_{k}") for k, c in pieces.items()]
        packed = F.when(F.col("metric") == m.name, F.create_map(
            *[x for k in pieces for x in (F.lit(k), F.col(f"_{i}_{k}"))])).otherwise(packed)
    return long.groupBy(*group_cols, "metric").agg(*aggs).select(*group_cols, "metric", packed.alias("parts"))


def merge_partials(batches: DataFrame, group_cols: list[str], names: list[str] | None = None) -> DataFrame:
    """Partial results of several batches (a union of :func:`metric_partials`) merged to one row per group and metric."""
    special = [REGISTRY[m] for m in (names or REGISTRY) if m in REGISTRY and REGISTRY[m].partial]
    keys = {0: ["total", "n"], **{i: list(m.partial(F.lit(0.0))) for i, m in enumerate(special, 1)}}
    aggs = [F.sum(F.col("parts")["total"].cast("decimal(38,0)")).cast("string").alias("_0_total"),
            F.sum(F.col("parts")["n"].cast("bigint")).cast("string").alias("_0_n")]
    packed = F.create_map(F.lit("total"), F.col("_0_total"), F.lit("n"), F.col("_0_n"))
    ready = batches
    for i, m in enumerate(special, 1):
        for k in keys[i]:
            ready = ready.withColumn(f"_in_{i}_{k}", F.when(F.col("metric") == m.name, F.try_element_at(
                "parts", F.lit(k)).cast("double")))
            aggs.append(m.merge(f"_in_{i}_{k}").cast("string").alias(f"_{i}_{k}"))
        packed = F.when(F.col("metric") == m.name, F.create_map(
            *[x for k in keys[i] for x in (F.lit(k), F.col(f"_{i}_{k}"))])).otherwise(packed)
    # A special metric's pieces are not the mean's: read those only where they are.
    ready = ready.withColumn("parts", F.when(F.map_contains_key("parts", F.lit("total")) & F.map_contains_key(
        "parts", F.lit("n")), F.col("parts")).otherwise(F.create_map(F.lit("total"), F.lit("0"), F.lit("n"), F.lit("0"))))
    return ready.groupBy(*group_cols, "metric").agg(*aggs).select(*group_cols, "metric", packed.alias("parts"))


def finish_partials(merged: DataFrame, group_cols: list[str], names: list[str] | None = None) -> DataFrame:
    """``group..., metric, score`` of merged partial results."""
    score = _mean_finish({k: F.try_element_at("parts", F.lit(k)) for k in ("total", "n")})
    for m in (REGISTRY[x] for x in (names or REGISTRY) if x in REGISTRY and REGISTRY[x].partial):
        pieces = {k: F.try_element_at("parts", F.lit(k)).cast("double") for k in m.partial(F.lit(0.0))}
        score = F.when(F.col("metric") == m.name, _pieces(m)[1](pieces)).otherwise(score)
    return merged.select(*group_cols, "metric", score.alias("score"))


def metric_means(long: DataFrame, group_cols: list[str]) -> DataFrame:
    """Score per group and metric. Means are exact to 6 places and skip NaN and NULL (see
    :func:`exact_mean`); a registered metric with pieces of its own is finished by them."""
    return finish_partials(metric_partials(long, group_cols), group_cols)


def metric_order(spark: SparkSession, metrics: list[str]) -> DataFrame:
    return literal_dimension(spark.createDataFrame(
        [(m, i) for i, m in enumerate(metrics)], "metric string, metric_ord int"))


def overall_summary(means: DataFrame, group_cols: list[str], order: DataFrame) -> DataFrame:
    """Average score, best metric, worst metric (first one wins a tie)."""
    m = means.join(order, "metric")
    s, n = exact_mean(F.col("score"))
    return m.groupBy(*group_cols).agg(
        finish_mean(s, n).alias("avg_score"),
        F.min_by("metric", F.struct((-F.col("score")).alias("s"), "metric_ord")).alias("best_metric"),
        F.max("score").alias("best_score"),
        F.min_by("metric", F.struct(F.col("score").alias("s"), "metric_ord")).alias("worst_metric"),
        F.min("score").alias("worst_score"))


def compare_pivot(means: DataFrame, metrics: list[str], kb_col: str = "kb_name") -> DataFrame:
    """D3: KB rows x metric columns, 3 decimals."""
    p = means.groupBy(kb_col).pivot("metric", metrics).agg(F.first("score"))
    return p.select(kb_col, *[F.round(m, 3).alias(m) for m in metrics])


def best_per_metric(means: DataFrame, kb_order: DataFrame, kb_col: str = "kb_name") -> DataFrame:
    """Best KB per metric (first KB in the requested order wins a tie)."""
    m = means.join(bounded_broadcast(kb_order), kb_col)
    key = F.struct((-F.col("score")).alias("s"), "kb_ord")
    return m.groupBy("metric").agg(F.min_by(kb_col, key).alias("best_kb"),
                                   F.max("score").alias("best_score"))


def overall_best(means: DataFrame, kb_order: DataFrame, kb_col: str = "kb_name") -> DataFrame:
    """KB with the highest mean over metrics (two-level aggregation)."""
    s, n = exact_mean(F.col("score"))
    row_means = means.groupBy(kb_col).agg(finish_mean(s, n).alias("mean_score"))
    m = row_means.join(bounded_broadcast(kb_order), kb_col)
    return m.agg(F.min_by(kb_col, F.struct((-F.col("mean_score")).alias("s"), "kb_ord"))
                 .alias("best_kb"), F.max("mean_score").alias("best_mean"))


# ------------------------------------------------------------ H29 - H31

def performance_label(score) -> Column:
    """>=0.9 Excellent, >=0.8 Good, >=0.7 Fair, else Needs Improvement."""
    s = _c(score)
    expr = F.lit(LABEL_OTHERWISE)
    for threshold, label in reversed(LABELS):
        expr = F.when(s >= threshold, F.lit(label)).otherwise(expr)
    return expr


def recommendations(score_map: Column) -> Column:
    """Rules in order (an absent metric counts as 1.0); default line when none fires."""
    recs = F.filter(F.array(*[
        F.when(F.coalesce(score_map[m], F.lit(1.0)) < t, F.lit(text)) for m, t, text in RECOMMENDATIONS
    ]), lambda x: x.isNotNull())
    return F.when(F.size(recs) == 0, F.array(F.lit(EXCELLENT))).otherwise(recs)


def interpretation(metric) -> Column:
    """Description of a metric (empty for unknown names)."""
    lookup = F.create_map(*[x for k, v in METRIC_INTERPRETATION.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(lookup[_c(metric)], F.lit(""))


def metric_title(metric) -> Column:
    """``context_recall`` -> ``Context Recall``."""
    return F.initcap(F.regexp_replace(_c(metric), "_", " "))


# ----------------------------------------------------------------------- K11

def ranking_metrics(ranked: DataFrame, relevant: DataFrame, keys: list[str], k: int) -> DataFrame:
    """hit@k, MRR@k, nDCG@k and recall@k with binary relevance.

    ``ranked``: keys..., rank, doc_id (top-k); ``relevant``: keys..., doc_id.
    """
    n_rel = relevant.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rel"))
    flagged = ranked.where(F.col("rank") <= k).join(
        relevant.withColumn("rel", F.lit(1)), keys + ["doc_id"], "left").fillna(0, ["rel"])
    per_q = flagged.groupBy(*keys).agg(
        F.max("rel").alias("hit"),
        F.coalesce(F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum("rel").alias("n_hit"))
    idcg = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k))), F.lit(0.0),
                       lambda a, i: a + 1.0 / F.log2(i + 1))
    # A labelled question without any ranked row counts with zeros.
    found = per_q.join(n_rel, keys, "full").fillna(0, ["hit", "rr", "dcg", "n_hit"])
    return found.select(
        *keys, F.col("hit").cast("double").alias("hit_at_k"), F.col("rr").alias("mrr"),
        F.when(F.coalesce(F.col("n_rel"), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.col("dcg") / idcg)
        .alias("ndcg_at_k"),
        F.when(F.coalesce(F.col("n_rel"), F.lit(0)) == 0, F.lit(0.0))
        .otherwise(F.col("n_hit") / F.col("n_rel")).alias("recall_at_k"))


def label_histogram(means: DataFrame) -> DataFrame:
    """Count of metric means per performance label."""
    return means.groupBy(performance_label("score").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ K8, K9

REPORT_NEXT_STEPS = (
    "## 🔧 Next Steps\n"
    "1. **Review detailed results** in the exported CSV file\n"
    "2. **Implement recommended improvements**\n"
    "3. **Re-evaluate** to measure progress\n"
    "4. **A/B test** different configurations\n\n"
    "---\n"
    "*Generated by sifter RAG evaluation*\n")


def fixed(x: Column, digits: int) -> Column:
    """Python's ``f"{x:.Nf}"``: Java's DecimalFormat rounds the exact binary
    value half-to-even, as Python does (format_string/round start from the
    shortest decimal form instead). Grouping commas are removed."""
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def _fmt3(x: Column) -> Column:
    return fixed(x, 3)


def summary_report(means: DataFrame, metrics: list[str], n_questions: Column,
                   evaluation_seconds: float, timestamp: Column,
                   kb_col: str = "kb_name") -> DataFrame:
    """K9: one markdown report per knowledge base (sections in metric order,
    labels, overall average, best and worst metric, recommendations).

    Groups are knowledge bases with at most ``len(metrics)`` rows each.
    """
    spark = means.sparkSession
    order = metric_order(spark, metrics)
    m = means.join(order, "metric")
    section = F.concat(
        F.lit("### "), metric_title("metric"), F.lit("\n- **Score**: "), _fmt3(F.col("score")),
        F.lit(" "), performance_label("score"), F.lit("\n- **Description**: "),
        interpretation("metric"), F.lit("\n\n"))
    per_kb = m.groupBy(kb_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("metric_ord", section.alias("s")))),
                    lambda x: x["s"]).alias("sections"),
        F.map_from_entries(F.collect_list(F.struct("metric", "score"))).alias("scores"),
        finish_mean(*exact_mean(F.col("score"))).alias("avg"),
        F.min_by("metric", F.struct((-F.col("score")).alias("v"), "metric_ord")).alias("best"),
        F.max("score").alias("best_score"),
        F.min_by("metric", F.struct(F.col("score").alias("v"), "metric_ord")).alias("worst"),
        F.min("score").alias("worst_score"))
    recs = F.array_join(F.transform(recommendations(F.col("scores")),
                                    lambda r: F.concat(F.lit("- "), r, F.lit("\n"))), "")
    report = F.concat(
        F.lit("# RAG Evaluation Report\n\n## 📊 Overview\n- **Knowledge Base**: "), F.col(kb_col),
        F.lit("\n- **Test Questions**: "), n_questions.cast("string"),
        F.lit(f"\n- **Evaluation Time**: {evaluation_seconds:.2f} seconds\n- **Timestamp**: "),
        timestamp, F.lit("\n\n## 🎯 RAGAS Metrics Scores\n\n"),
        F.array_join("sections", ""),
        F.lit("## 📈 Overall Assessment\n- **Average Score**: "), _fmt3(F.col("avg")), F.lit(" "),
        performance_label("avg"), F.lit("\n- **Best Metric**: "), F.col("best"), F.lit(" ("),
        _fmt3(F.col("best_score")), F.lit(")\n- **Needs Improvement**: "), F.col("worst"),
        F.lit(" ("), _fmt3(F.col("worst_score")), F.lit(")\n\n## 💡 Recommendations\n\n"),
        recs, F.lit("\n\n"), F.lit(REPORT_NEXT_STEPS))
    return per_kb.select(kb_col, report.alias("report"))


def evaluate_pipeline(rows: DataFrame, keys: list[str], metrics: list[str] | None = None,
                      kb_col: str = "kb_name", evaluation_seconds: float = 0.0,
                      timestamp: str | None = None, out_dir: str | None = None, judge=token_judge, derive=None,
                      config: dict | None = None):
    """K8: evaluation rows -> per-question metrics -> means -> report [-> files].

    Returns ``(details, means, report)``; with ``out_dir`` details, report and the run's metadata (run id, knowledge
    base, metrics asked for, used and unknown, times, configuration, scores) are also
    written (A12). Without ground truths the metric list defaults to B5.
    """
    from sifter.sources.sinks import write_evaluation
    has_gt = "ground_truths" in rows.columns and not rows.filter(
        "ground_truths is not null").isEmpty()
    asked = metrics or default_metrics(has_gt)
    metrics = select_metrics(asked)
    long = score_rows(rows, metrics, keys, judge, derive)
    group = [kb_col] if kb_col in keys else []
    means = metric_means(long, group)
    if not group:
        means = means.withColumn(kb_col, F.lit("default"))
    n_q = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")) if group else \
        rows.agg(F.count(F.lit(1)).alias("_n")).withColumn(kb_col, F.lit("default"))
    ts = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(),
                                                          "yyyy-MM-dd'T'HH:mm:ss")
    report = _report_with_counts(means, n_q, metrics, evaluation_seconds, ts, kb_col)
    details = rows.join(long.groupBy(*keys).pivot("metric", metrics).agg(F.first("value")), keys)
    if out_dir:
        meta = evaluation_metadata(means, n_q, asked, ts, evaluation_seconds, config or {}, kb_col)
        write_evaluation(details, report.select("report"), meta, out_dir)
    return details, means, report


def evaluation_metadata(means: DataFrame, n_q: DataFrame, asked: list[str], timestamp: Column, seconds: float,
                        config: dict, kb_col: str = "kb_name") -> DataFrame:
    """One row per knowledge base about the run itself: ``run_id, kb_name, timestamp, evaluation_seconds,
    n_questions, metrics, unknown_metrics, config, scores``."""
    known, unknown = split_metrics(asked)
    strings = "array<string>"
    scores = means.groupBy(kb_col).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("metric", "score")))).alias("scores"))  # one entry a metric
    settings = [x for k, v in sorted(config.items()) for x in (F.lit(k), F.lit(str(v)))]
    return scores.join(bounded_broadcast(n_q), kb_col).select(
        evaluation_run_id(F.col(kb_col), F.to_timestamp(timestamp, "yyyy-MM-dd'T'HH:mm:ss")).alias("run_id"),
        F.col(kb_col).alias("kb_name"), timestamp.alias("timestamp"),
        F.lit(float(seconds)).alias("evaluation_seconds"), F.col("_n").alias("n_questions"),
        F.array(*map(F.lit, known)).cast(strings).alias("metrics"),
        F.array(*map(F.lit, unknown)).cast(strings).alias("unknown_metrics"),
        (F.create_map(*settings) if settings else F.create_map().cast("map<string,string>")).alias("config"), "scores")


def _report_with_counts(means, n_q, metrics, evaluation_seconds, ts, kb_col):
    rep = summary_report(means, metrics, F.lit("{n}"), evaluation_seconds, ts, kb_col)
    return rep.join(bounded_broadcast(n_q), kb_col).select(
        kb_col, F.replace("report", F.lit("**Test Questions**: {n}"),
                          F.concat(F.lit("**Test Questions**: "), F.col("_n").cast("string")))
        .alias("report"))
