"""Keyword search through an inverted index with block bounds.

*Index.* Documents stay in the task that reads them and are inverted there in segments of a few thousand
(:mod:`sifter.operators.posting_segments`): a row a term with its postings and, for every block of ``BLOCK_DOCS`` documents
that holds it, a bound for their impacts (the term-frequency part of BM25). Nothing is shuffled to build it, and a posting takes four to
five bytes. A search reads the rows of the questions' terms once and deals them by segment.

*Search.* Four steps over all questions. Steps run inside the segments; between them only promising documents, thresholds
and ranked rows move, never (question, document) pairs:

1. *Threshold.* The postings of a question's strongest terms name a few promising documents; they are scored whole and
   the k-th best score becomes the threshold. (It only has to be reached by some k documents.)
2. *Blocks.* The weakest terms whose largest contributions add up to less than a share of the threshold cannot lift a
   document to it alone: documents are found through the other terms. A block goes on when those terms' bounds plus that
   slack reach the threshold.
3. *Documents.* The contributions of those terms are summed; the best sums of a segment are scored whole and may raise its
   threshold; a document goes on when its sum plus the slack reaches the threshold.
4. *Scores.* What is left gets the weak terms' contributions; a segment returns its first k, which are ranked.

Every document that could be among the first k reaches the end, so the rows are those of the full search.
``KeywordResult.work`` counts the (question, document) pairs that were touched and those that were scored whole.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_type

from sifter.operators import batch_scores as B
from sifter.operators import retrieval as R
from sifter.operators.posting_segments import Plan, Segment, found, named, posting_segments, seed_scores
from sifter.plans.sizing import bounded_broadcast, mark_bounded
from sifter.session import cut_lineage, discard, materialize, materialize_clustered

BLOCK_DOCS = 8          # small blocks: bounds of many documents together say little
IDLE_SHARE = 0.3        # idle terms may reach this share of the threshold; the rest prunes documents
SEED_FACTOR = 200       # postings looked at for the first threshold, in multiples of k
SEED_DOCS = 4           # documents scored whole for a threshold, in multiples of k


@dataclass
class KeywordIndex:
    """``blocks``: the posting segments with their block bounds; ``stats``: collection statistics for
    :func:`sifter.operators.retrieval.prepare_questions`; ``first``: ``[group,] doc_id, r``, the smallest document ids;
    ``short``: the documents with the fewest terms."""
    blocks: DataFrame
    stats: R.IndexStats
    first: DataFrame
    short: DataFrame
    group_col: str | None
    params: R.BM25Params
    block_docs: int = BLOCK_DOCS

    def terms(self) -> DataFrame:
        """``[group,] term, df, peak`` (largest impact, rounded up)."""
        return self.blocks.where("term != ''").groupBy(*R._g(self.group_col), "term").agg(
            F.sum("df").alias("df"), F.max("peak").cast("double").alias("peak"))


@dataclass
class KeywordResult:
    """``ranked``: ``[group,] query_id, rank, doc_id, score`` (``raw``: unrounded); ``work``: pairs scored per question."""
    ranked: DataFrame
    work: DataFrame


FIRST_IDS = 64
SHORT_DOCS = 64


def _smallest(index: DataFrame, group_col: str | None, n: int, *order) -> DataFrame:
    """The first ``n`` rows of every group (a top-n before the exchange)."""
    if not group_col:
        return index.orderBy(*order).limit(n)
    w = Window.partitionBy(group_col).orderBy(*order)
    return index.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def build_keyword_index(index: DataFrame, params: R.BM25Params = R.BM25Params(), group_col: str | None = None,
                        block_docs: int = BLOCK_DOCS) -> KeywordIndex:
    """From document rows (``[group,] doc_id, dl, tf``, see ``retrieval.build_index``) to stored posting segments.

    Bounds hold the collection's average length, so an index belongs to one state of the collection.
    """
    g = R._g(group_col)
    stats = R.index_stats(index, params, group_col)
    glob = R._per_group(stats.glob.select(*g, "avgdl"), group_col, index)
    packed = getattr(index, "_sifter_packed", None)
    docs = index.select(*g, "doc_id", "dl", "tf") if packed is None else packed.select(*g, "doc_id", "dl", "terms", "counts")
    docs = docs.join(glob, group_col) if group_col else docs.crossJoin(glob)
    blocks = materialize(posting_segments(docs, group_col, params.k1, params.b, block_docs), "posting-segments")
    first = cut_lineage(_smallest(index.select(*g, "doc_id"), group_col, FIRST_IDS, "doc_id"))
    held = (index.select(*g, "doc_id", F.map_keys("tf").alias("held"), F.size("tf").alias("_s")) if packed is None else
            packed.select(*g, "doc_id", "terms", F.size("counts").alias("_s")))
    short = _smallest(held, group_col, SHORT_DOCS, "_s", "doc_id").drop("_s")
    if packed is not None:
        short = short.select(*g, "doc_id", R.held_terms(F.col("terms")).alias("held"))
    return KeywordIndex(blocks, stats, first, cut_lineage(short), group_col, params, block_docs)


def _fetched(kindex: KeywordIndex, qside: DataFrame) -> KeywordIndex:
    """The index cut down to the questions' terms: read once, then used by every step, a segment in one bucket."""
    g = R._g(kindex.group_col)
    asked = qside.select(*g, F.explode("qterms").alias("t")).select(*g, "t.term").distinct()
    n = getattr(qside, "_sifter_terms", None)
    asked = bounded_broadcast(mark_bounded(asked, n) if n is not None else asked)
    cut = kindex.blocks.where("term = ''").unionByName(kindex.blocks.where("term != ''").join(asked, g + ["term"], "left_semi"))
    return replace(kindex, blocks=materialize_clustered(cut, "asked_segments", ["segment"]))


def _over_segments(kindex: KeywordIndex, qside: DataFrame, plans: dict, step, doc: bool, more: list[str]) -> DataFrame:
    """``step(segment, plan)`` over every segment; it returns columns: the questions' places, ids (with ``doc``), then ``more``."""
    group, k1, b, block_docs = kindex.group_col, kindex.params.k1, kindex.params.b, kindex.block_docs
    kinds = {"segment": ST.LongType(), "place": ST.LongType(), "touched": ST.LongType(), "whole": ST.LongType()}
    fields = [kindex.blocks.schema[group]] if group else []
    fields.append(ST.StructField("query_id", qside.schema["query_id"].dataType))
    if doc:
        fields.append(ST.StructField("doc_id", kindex.blocks.schema["ids"].dataType.elementType))
    schema = ST.StructType(fields + [ST.StructField(c, kinds.get(c, ST.DoubleType())) for c in more])
    kind = {f.name: to_arrow_type(f.dataType) for f in schema}

    def run(table):
        name = table.column(group)[0].as_py() if group else None
        plan = plans.get(name) if name is not None or not group else None   # a null group joins with nothing
        made = []
        if plan is not None:
            seg = Segment(table, plan.asked, k1, b, block_docs)
            for who, ids, *values in step(seg, plan):
                cols = {group: pa.array([name] * len(who), kind[group])} if group else {}
                cols["query_id"] = plan.asked.ids.take(pa.array(who))
                if doc:
                    cols["doc_id"] = ids
                cols |= {c: v if isinstance(v, pa.Array) else pa.array(v, kind[c]) for c, v in zip(more, values)}
                made.append(pa.table([cols[f].cast(kind[f]) for f in kind], names=list(kind)))
        return pa.concat_tables(made) if made else pa.table([pa.array([], t) for t in kind.values()], names=list(kind))

    return kindex.blocks.groupBy(*R._g(group), "segment").applyInArrow(run, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _running(values: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Running sums inside every question (``who`` ascending)."""
    total = np.cumsum(values)
    return total - np.concatenate([[0.0], total])[np.searchsorted(who, who)]


def _plans(kindex: KeywordIndex, qside: DataFrame, k: int) -> tuple[dict, dict]:
    """A plan a group with the strong terms of its questions (the rarest heavy ones, until they name enough documents), and the
    largest possible contribution of every term entry."""
    group, keys = kindex.group_col, R._keys(qside)
    plans = {name: Plan(asked, np.zeros(len(asked.askers), bool)) for name, asked in B.asked_by_group(
        qside.select(*keys, "qvec", "qnorm", "qterms", "avgdl").toArrow(), group).items() if asked.avgdl is not None}
    held = kindex.terms().toArrow()
    names = held.column(group).to_pylist() if group else [None] * held.num_rows
    known = {(n, t): (df, peak) for n, t, df, peak in zip(names, held["term"].to_pylist(), held["df"].to_pylist(), held["peak"].to_pylist())}
    most = {}
    for name, plan in plans.items():
        asked = plan.asked
        found = np.array([known.get((name, t), (0, 0.0)) for t in asked.terms.to_pylist()]).reshape(-1, 2)
        term = np.repeat(np.arange(len(asked.terms)), np.diff(asked.starts))
        most[name] = np.maximum(asked.gains, 0.0) * found[term, 1]
        order = np.lexsort((term, -most[name], asked.askers))
        df = found[term, 0][order]
        plan.use[order] = _running(df, asked.askers[order]) - df < SEED_FACTOR * k
    return plans, most


def _idle(plan: Plan, most: np.ndarray) -> None:
    """Terms whose contributions stay below the threshold together are idle; their sum is the slack."""
    asked = plan.asked
    order = np.lexsort((np.repeat(np.arange(len(asked.terms)), np.diff(asked.starts)), most, asked.askers))
    idle = np.zeros(len(most), dtype=bool)
    with np.errstate(invalid="ignore"):
        idle[order] = _running(most[order], asked.askers[order]) < plan.theta[asked.askers[order]] * IDLE_SHARE
    plan.use = ~idle
    plan.slack = np.bincount(asked.askers[idle], weights=most[idle], minlength=len(asked.ids)).astype(np.float64)


def _parts(qside: DataFrame, k: int) -> list[DataFrame]:
    """The question side in parts whose terms and promising documents fit the driver and the tasks."""
    n, terms = getattr(qside, "_sifter_rows", None), getattr(qside, "_sifter_terms", None)
    if n is None or terms is None:
        n, terms = qside.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("qterms")), F.lit(0))).first()
    return R.dealt(qside, n * (64 + 40 * SEED_DOCS * k) + 56 * terms)


def search(kindex: KeywordIndex, qside: DataFrame, k: int = R.DEFAULT_TOP_K, fill: bool = True) -> KeywordResult:
    """The k best documents of every question of ``qside`` (prepared with ``kindex.stats``).

    With ``fill``, questions with fewer than k matching documents are completed by the smallest ids at score 0, as
    ``retrieval.bm25_topk`` does.
    """
    if fill and k > FIRST_IDS // 2:
        raise ValueError(f"fill serves k up to {FIRST_IDS // 2}; use fill=False and complete the list outside")
    keys = R._keys(qside)
    index = kindex
    kindex = _fetched(kindex, qside)
    found_rows = [_found(kindex, part, k) for part in _parts(qside, k)]
    rows = found_rows[0]
    for more in found_rows[1:]:
        rows = rows.unionByName(more)
    hits = R.top_k(rows.where("touched is null").withColumn("score", F.col("raw")), k, part_col=keys).select(
        *keys, "rank", "doc_id", "score", "raw")
    work = cut_lineage(rows.where("touched is not null").groupBy(*keys).agg(
        F.sum("touched").alias("touched_pairs"), F.sum("whole").alias("scored_pairs")).where("touched_pairs > 0"))
    hits = R._keep_bound(cut_lineage(hits), qside)
    discard(kindex.blocks, *found_rows)  # the search's own tables: ranks and counts are stored
    return KeywordResult(_filled(index, qside, hits, k, keys) if fill else hits, work)


def _found(kindex: KeywordIndex, qside: DataFrame, k: int) -> DataFrame:
    """``keys, doc_id, raw`` of every segment's first k, and rows that count its work: ``keys, touched, whole``."""
    keys, g = R._keys(qside), R._g(kindex.group_col)
    plans, most = _plans(kindex, qside, k)
    n = SEED_DOCS * k

    # 1. The strong terms' documents with the largest sums, scored whole.
    def strong(seg, plan):
        for who, place, part in named(seg, plan, n):
            yield who, seg.ids.take(pa.array(place)), np.full(len(who), seg.number), place, part

    promising = _over_segments(kindex, qside, plans, strong, True, ["segment", "place", "part"])
    best = Window.partitionBy(*keys).orderBy(F.desc("part"), "doc_id")
    promising = promising.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n).select(
        *keys, "segment", "place").toArrow()
    for plan in plans.values():
        plan.seeds = (np.zeros(0, np.int64),) * 3
    for plan, who, rows in B.by_question(plans, promising, kindex.group_col):
        plan.seeds = (who, rows["segment"].to_numpy().astype(np.int64), rows["place"].to_numpy().astype(np.int64))

    def whole(seg, plan):
        who, raw = seed_scores(seg, plan)
        yield who, None, raw

    place = Window.partitionBy(*keys).orderBy(F.desc("raw"))
    thresholds = (_over_segments(kindex, qside, plans, whole, False, ["raw"])
                  .withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k)
                  .groupBy(*keys).agg(F.min("raw").alias("theta"), F.count(F.lit(1)).alias("_n"))
                  .where((F.col("_n") == k) & (F.col("theta") > 0)).select(*keys, "theta").toArrow())
    for plan in plans.values():
        plan.theta, plan.seeds = np.full(len(plan.asked.ids), np.nan), None
    for plan, who, rows in B.by_question(plans, thresholds, kindex.group_col):
        plan.theta[who] = rows["theta"].to_numpy()
    for name, plan in plans.items():
        _idle(plan, most[name])

    # 2 to 4. Blocks, documents and scores.
    def ranked(seg, plan):
        for first, who, spot, raw, touched, scored in found(seg, plan, k, n):
            some, null = np.nonzero(touched)[0], pa.nulls(len(who), pa.int64())
            yield who + first, seg.ids.take(pa.array(spot)), raw, null, null
            yield (some + first, pa.nulls(len(some), seg.ids.type), pa.nulls(len(some), pa.float64()), touched[some], scored[some])

    return materialize(_over_segments(kindex, qside, plans, ranked, True, ["raw", "touched", "whole"]), "keyword-found")


def _filled(kindex: KeywordIndex, qside: DataFrame, hits: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Short lists completed by the smallest ids without a hit (2k ids suffice: at most k-1 of them are hits).
    A short list holds all its question's hits, so they are the ones to leave out."""
    few = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    short = qside.select(*keys).join(few, keys, "left").where(F.coalesce("_n", F.lit(0)) < k).select(*keys)
    ids = kindex.first
    pairs = short.join(ids, kindex.group_col) if kindex.group_col else short.crossJoin(F.broadcast(ids))  # 64 rows
    fill = pairs.join(hits.select(*keys, "doc_id"), keys + ["doc_id"], "left_anti").select(
        *keys, "doc_id", F.lit(0.0).alias("raw"))
    both = hits.select(*keys, "doc_id", "raw").unionByName(fill).withColumn("score", F.col("raw"))
    return R.top_k(both, k, part_col=keys).select(*keys, "rank", "doc_id", "score", "raw")
