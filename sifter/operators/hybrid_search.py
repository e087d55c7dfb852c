"""Hybrid search by the threshold algorithm over two indexes.

The hybrid score is ``(1 - alpha) * bm25 + alpha * cosine``, both min-max normalised per question over all documents.

*Ranges.* The largest scores are the first of either list; the smallest cosine is the nearest vector to the
opposite direction. The smallest keyword score is 0 as soon as one document without any question term is known (the
shortest documents are tried); questions without such a witness, or with a term of negative weight, get both ends from an
aggregate over all their hits.

*Rounds.* The first m documents of both lists are scored whole by one join with the document index. A document
in neither list scores at most the blend of the two m-th scores, so a question is finished when its k-th hybrid score is above
that; the others go on with eight times as many, or are scored against all documents in batches
(``retrieval.hybrid_topk``) once that takes less time than the next round, or the lists would hold more than ``ROUND_ROWS`` rows. At the end of a list the blend is that of documents nobody has
seen: if it is the least possible score, the smallest ids complete the result.

One scoring join serves a round, and nothing is folded into a map per document: rows are keyed by (group, question,
document), so a document may stand in several knowledge bases.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions.vectors import entries_dot_dense
from sifter.operators import batch_scores as B
from sifter.operators import keyword_index as KI
from sifter.operators import retrieval as R
from sifter.operators import vector_index as VI
from sifter.plans.sizing import bounded_broadcast, mark_bounded
from sifter.session import cut_lineage, discard, materialize

FIRST_DEPTH = 64
GROWTH = 8
MARGIN = 2e-6
# A round of depth m costs a question about as much as scoring this many times m documents in batches.
SCAN_FACTOR = 256
# Rows of a round's lists, over all questions: batches score all documents without moving or storing any pair.
ROUND_ROWS = 200_000


@dataclass
class HybridIndex:
    """``docs``: ``[group,] doc_id, dl, tf, vec, vnorm`` (``retrieval.build_index``), and the two indexes over it."""
    docs: DataFrame
    keyword: KI.KeywordIndex
    vector: VI.VectorIndex


def build_hybrid_index(docs: DataFrame, params: R.BM25Params = R.BM25Params(), group_col: str | None = None,
                       n_cells: int | None = None, keyword: KI.KeywordIndex | None = None) -> HybridIndex:
    """Both indexes; a ``keyword`` index built before over the same rows is taken as it is."""
    return HybridIndex(docs, keyword or KI.build_keyword_index(docs, params, group_col),
                       VI.build_vector_index(docs, group_col, n_cells=n_cells))


@dataclass
class HybridResult:
    """``ranked``: ``[group,] query_id, rank, doc_id, score``; ``pairs``: (question, document) pairs scored whole."""
    ranked: DataFrame
    pairs: int
    depth: int


def _part(qside: DataFrame, some: DataFrame, n: int) -> DataFrame:
    """The rows of a question side that are still open, with its marks."""
    out = mark_bounded(cut_lineage(qside.join(some, R._keys(qside), "left_semi")), n)
    for mark in ("_sifter_group", "_sifter_terms", "_sifter_coded"):
        if hasattr(qside, mark):
            setattr(out, mark, getattr(qside, mark))
    return out


def keyword_ranges(hindex: HybridIndex, qside: DataFrame, best: DataFrame) -> DataFrame:
    """``keys, bm_min, bm_max``; ``best`` holds the questions' first hits (``keys, raw``)."""
    keys, g = R._keys(qside), R._g(hindex.keyword.group_col)
    short = hindex.keyword.short.select(*g, "held")
    asked = qside.select(*keys, "qterms")
    pairs = asked.join(short, g) if g else asked.crossJoin(F.broadcast(short))  # SHORT_DOCS rows a group
    free = F.size(F.array_intersect("held", F.transform("qterms", lambda t: t["term"]))) == 0
    known = pairs.groupBy(*keys).agg(F.max(free).alias("witness"), F.first(
        ~F.exists("qterms", lambda t: t["w"] < 0)).alias("plain"))
    known = cut_lineage(asked.select(*keys).join(known, keys, "left").join(best, keys, "left").select(
        *keys, F.coalesce(F.col("witness") & F.col("plain"), F.lit(False)).alias("easy"),
        F.coalesce("raw", F.lit(0.0)).alias("raw")))
    easy = known.where("easy").select(*keys, F.lit(0.0).alias("bm_min"), F.col("raw").alias("bm_max"))
    n_hard = known.where(~F.col("easy")).count()
    if n_hard == 0:
        return easy
    hard = _part(qside, known.where(~F.col("easy")).select(*keys), n_hard)
    asked = R._asked(hindex.docs, hard)
    if asked is not None:  # a row a question and task; a document without a shared term scores 0
        p = hindex.keyword.params
        ends = B.score_ranges(hindex.docs, hard, asked, R._group_of(hard), p.k1, p.b).groupBy(*keys).agg(
            F.min("bm25_min").alias("bm_min"), F.max("bm25_max").alias("bm_max"))
        return easy.unionByName(ends)
    ends = R.bm25_hits(hindex.docs, hard, hindex.keyword.params).groupBy(*keys).agg(
        F.min("bm25").alias("low"), F.max("bm25").alias("high"), F.count(F.lit(1)).alias("n"))
    full = (F.col("n") == F.col("n_docs"))  # every document shares a term: 0 is not among the scores
    low = F.when(full, F.col("low")).otherwise(F.least(F.col("low"), F.lit(0.0)))
    high = F.when(full, F.col("high")).otherwise(F.greatest(F.col("high"), F.lit(0.0)))
    ranges = hard.select(*keys, "n_docs").join(ends, keys, "left").select(
        *keys, F.coalesce(low, F.lit(0.0)).alias("bm_min"), F.coalesce(high, F.lit(0.0)).alias("bm_max"))
    return easy.unionByName(ranges)


def _ends(hindex: HybridIndex, qside: DataFrame, words: DataFrame, near: DataFrame) -> DataFrame:
    """``keys, bm_min, bm_max, sem_min, sem_max``: one row a question, from its lists and the farthest vector."""
    keys = R._keys(qside)
    bm = keyword_ranges(hindex, qside, words.where("rank = 1").select(*keys, "raw"))
    turned = R._keep_bound(qside.withColumn("qvec", F.transform("qvec", lambda e: F.struct(
        e["i"].alias("i"), (-e["w"]).alias("w")))), qside)
    turned._sifter_group = R._group_of(qside)  # type: ignore[attr-defined]
    far = VI.exact_search(hindex.vector, turned, 1).ranked.select(*keys, (-F.col("raw")).alias("sem_min"))
    return cut_lineage(bm.join(near.where("rank = 1").select(*keys, F.col("raw").alias("sem_max")), keys)
                       .join(far, keys))


def _both_scores(hindex: HybridIndex, qside: DataFrame, pairs: DataFrame) -> DataFrame:
    """``keys, doc_id, bm, sem`` of (question, document) pairs: one join with the document index, a document with all its questions."""
    keys, group = R._keys(qside), hindex.keyword.group_col
    g, p, n = R._g(group), hindex.keyword.params, getattr(pairs, "_sifter_rows", None)
    held = R._asked(hindex.docs, qside)
    if held is not None:
        by_doc = pairs.groupBy(*g, "doc_id").agg(F.collect_list("query_id").alias("asked_by"))
        by_doc = bounded_broadcast(mark_bounded(by_doc, n)) if n is not None else by_doc
        rows = B.score_columns(hindex.docs, qside, group, "both").join(by_doc, g + ["doc_id"])
        return B.pair_scores(rows, qside, held, group, p.k1, p.b)
    side = bounded_broadcast(R._keep_bound(qside.select(*keys, "qterms", "qvec", "qnorm", "avgdl"), qside))
    pairs = bounded_broadcast(pairs) if n is not None else pairs
    rows = hindex.docs.select(*g, "doc_id", "dl", "tf", "vec", "vnorm").join(pairs, g + ["doc_id"]).join(side, keys)

    def gain(t):
        tf = F.coalesce(F.try_element_at("tf", t["term"]), F.lit(0)).cast("double")
        return t["w"] * (tf * (p.k1 + 1)) / (tf + F.lit(p.k1) * (
            F.lit(1 - p.b) + F.lit(p.b) * F.col("dl") / F.col("avgdl")))

    bm = F.aggregate("qterms", F.lit(0.0), lambda a, t: a + gain(t))
    qn, dn = F.col("qnorm"), F.col("vnorm")
    sem = F.when((qn == 0) | (dn == 0), F.lit(0.0)).otherwise(entries_dot_dense("qvec", "vec") / (qn * dn))
    return rows.select(*keys, "doc_id", bm.alias("bm"), sem.alias("sem"))


def _blend(bm, sem, alpha: float):
    return (F.lit(1.0 - alpha) * ((bm - F.col("bm_min")) / (F.col("bm_max") - F.col("bm_min") + F.lit(R.NORM_EPS)))
            + F.lit(alpha) * ((sem - F.col("sem_min")) / (F.col("sem_max") - F.col("sem_min") + F.lit(R.NORM_EPS))))


def search(hindex: HybridIndex, qside: DataFrame, k: int = R.DEFAULT_TOP_K, alpha: float = R.HYBRID_ALPHA,
           first_depth: int = FIRST_DEPTH) -> HybridResult:
    """The k best documents of every question by the hybrid score."""
    keys, g = R._keys(qside), R._g(hindex.keyword.group_col)
    sizes = hindex.vector.parts.groupBy(*g).agg(F.sum("n").alias("_docs"))
    ends = None
    largest = hindex.vector.parts.groupBy(*g).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    ids = hindex.keyword.first
    open_side, depth, done, pairs = qside, max(first_depth, 2 * k), [], 0
    while True:
        words = KI.search(hindex.keyword, open_side, depth, fill=False).ranked.select(*keys, "rank", "doc_id", "raw")
        near = VI.exact_search(hindex.vector, open_side, depth).ranked.select(*keys, "rank", "doc_id", "raw")
        words, near = materialize(words, "hybrid-words"), materialize(near, "hybrid-vectors")
        if ends is None:
            ends = _ends(hindex, qside, words, near)
            ends = R._keep_bound(ends.join(sizes, g) if g else ends.crossJoin(F.broadcast(sizes)), qside)
        smallest = (open_side.select(*keys).join(ids, g) if g
                    else open_side.select(*keys).crossJoin(F.broadcast(ids)))  # FIRST_IDS rows a group
        asked = words.select(*keys, "doc_id").unionByName(near.select(*keys, "doc_id")).unionByName(
            smallest.select(*keys, "doc_id")).distinct()
        n_asked = getattr(open_side, "_sifter_rows", None)
        if n_asked is not None:
            asked = mark_bounded(asked, n_asked * (2 * depth + KI.FIRST_IDS))
        scored = _both_scores(hindex, open_side, asked).join(bounded_broadcast(ends), keys)
        scored = materialize(scored.withColumn("score", _blend(F.col("bm"), F.col("sem"), alpha)), "hybrid-scores")
        pairs += scored.count()
        top = R.top_k(scored, k, part_col=keys).select(*keys, "rank", "doc_id", "score")
        top = materialize(top, "hybrid-top")
        # What a document in neither list can score at most.
        tail = lambda x, c: x.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{c}"), F.min("raw").alias(f"_{c}"))
        state = (ends.join(open_side.select(*keys), keys, "left_semi").join(tail(words, "w"), keys, "left")
                 .join(tail(near, "v"), keys, "left")
                 .join(top.groupBy(*keys).agg(F.min("score").alias("_kth"), F.count(F.lit(1)).alias("_nk")), keys, "left"))
        # At the end of the word list only documents without a shared term, or with the least score, are left.
        word = F.when(F.coalesce("_nw", F.lit(0)) < depth, F.greatest(F.lit(0.0), F.col("bm_min"))).otherwise(F.col("_w"))
        state = state.withColumn("word", word).withColumn("most", _blend(F.col("word"), F.col("_v"), alpha))
        seen_all = F.coalesce(F.col("_nv") >= F.col("_docs"), F.lit(True))
        floor = ((F.lit(alpha) == 1.0) | (F.col("word") <= F.col("bm_min"))) & (
            (F.lit(alpha) == 0.0) | (F.col("_v") <= F.col("sem_min")))
        enough = (F.col("_nk") >= k) & ((F.col("_kth") > F.col("most") + MARGIN) | (floor & F.lit(k <= KI.FIRST_IDS)))
        state = cut_lineage(state.select(*keys, F.coalesce(seen_all | enough, F.lit(False)).alias("over")))
        done.append(cut_lineage(top.join(state.where("over"), keys, "left_semi")))
        discard(words, near, scored, top)  # the round's finished rows and states are stored
        n_open = state.where(~F.col("over")).count()
        if n_open == 0 or depth >= largest:
            break
        open_side = _part(open_side, state.where(~F.col("over")).select(*keys), n_open)
        depth = min(depth * GROWTH, largest)
        if depth * SCAN_FACTOR > largest or depth * n_open > ROUND_ROWS:
            per_group = sizes.join(open_side.groupBy(*g).agg(F.count(F.lit(1)).alias("_q")), g) if g else \
                sizes.withColumn("_q", F.lit(n_open))
            pairs += per_group.agg(F.sum(F.col("_docs") * F.col("_q"))).first()[0] or 0
            done.append(cut_lineage(R.hybrid_topk(hindex.docs, open_side, k, alpha, hindex.keyword.params)))
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return HybridResult(out, pairs, depth)
