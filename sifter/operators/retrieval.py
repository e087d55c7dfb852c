"""Batch retrieval over a text collection: BM25 (J4, D10), semantic (J3),
hybrid (J5, D13, H38, H39), reranking (J6, F3, F4) and top-k (E1, F1, F2).

Plan shape (all questions answered in one job):

* the collection is indexed row by row with no shuffle: token count,
  ``MAP<term, tf>`` (sort + run lengths) and a hashed vector (or a supplied
  embedding);
* global statistics (N, average length, document frequencies, the idf floor)
  are partial+final aggregations; only the question terms' idf is kept;
* BM25 explodes postings and hash-joins them with the broadcast question terms
  (a size-checked side), then sums contributions per (question, document);
* ranked lists come from Arrow batches of index rows that meet the checked question
  side inside their task (:mod:`sifter.operators.batch_scores`): a task returns its own k
  best per question. All pairs, and question sides above the bound, stream through a
  nested-loop join with the broadcast question vectors (above the bound question
  blocks meet document ranges by an equi-join);
* ``row_number() <= k`` becomes ``WindowGroupLimit`` before the exchange, so
  at most k rows per question and partition are shuffled for ranking.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sifter.functions.text import tokenize
from sifter.functions.vectors import (HASH_DIM, dense_entries, entries_dot_dense, entries_norm,
                                      hashed_entries, norm)
from sifter.operators import batch_scores as B
from sifter.plans.sizing import bounded_broadcast, mark_bounded
from sifter.session import cut_lineage, materialize, materialize_bucketed

# Library defaults of the BM25-Okapi scorer and the hybrid blend.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
HYBRID_ALPHA = 0.5
NORM_EPS = 1e-8
DEFAULT_TOP_K = 5
RERANK_TOP_K = 20
SCORE_DIGITS = 6


@dataclass(frozen=True)
class BM25Params:
    k1: float = BM25_K1
    b: float = BM25_B
    epsilon: float = BM25_EPSILON


def _g(group_col: str | None) -> list[str]:
    return [group_col] if group_col else []


def _n_groups(index: DataFrame, group_col: str) -> int:
    """Number of groups (knowledge bases) of an index, counted once."""
    n = getattr(index, "_sifter_groups", None)
    if n is None:
        n = index.select(group_col).distinct().count()
        index._sifter_groups = n  # type: ignore[attr-defined]
    return n


def _per_group(df: DataFrame, group_col: str | None, index: DataFrame | None = None) -> DataFrame:
    """Broadcast a statistics table with one row per group: a single row
    without groups; with groups, the group count of the index is the bound."""
    if not group_col:
        return F.broadcast(df)
    if index is not None:
        df = mark_bounded(df, _n_groups(index, group_col))
    return bounded_broadcast(df)


# Question sides up to this size are broadcast; larger ones meet the documents in blocks.
SIDE_BYTES = 32 << 20
BLOCK_DOCS = 50_000


def _side_bytes(side: DataFrame) -> int:
    """Size of a question side: a constant a row and 16 bytes a vector entry, bounded by the token count of
    ``prepare_questions`` where that is known, else counted."""
    n, terms = getattr(side, "_sifter_rows", None), getattr(side, "_sifter_entries", None)
    if n is None or terms is None:
        n, terms = side.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("qvec")), F.lit(0))).first()
    return 64 * n + 16 * terms


def _join_side(big: DataFrame, small: DataFrame, group_col: str | None) -> DataFrame:
    """Every document row with every question (of its group).

    A question side of at most ``SIDE_BYTES`` is broadcast. A larger one is cut into question blocks of that
    size and the documents into ranges of about ``BLOCK_DOCS`` by a hash of their id: a (question block,
    document range) pair is one task's work, joined on both numbers (and the group), so that neither a hot
    knowledge base nor a large question set meets in one task. The ranked lists of the ranges are merged
    by the top-k that follows.
    """
    size = _side_bytes(small)
    if size <= SIDE_BYTES:
        side = F.broadcast(small)
        return big.join(side, group_col) if group_col else big.crossJoin(side)
    blocks, ranges = -(-size // SIDE_BYTES), max(1, -(-big.count() // BLOCK_DOCS))
    asked = small.withColumn("_block", F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(blocks))).withColumn(
        "_range", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ranges - 1).cast("bigint"))))
    held = big.withColumn("_range", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(ranges))).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    return held.join(asked, _g(group_col) + ["_block", "_range"]).drop("_block", "_range")


def dealt(qside: DataFrame, size: int) -> list[DataFrame]:
    """A question side of ``size`` bytes in parts of at most about ``SIDE_BYTES``, with its marks."""
    parts = -(-size // SIDE_BYTES)
    if parts <= 1:
        return [qside]
    out = [qside.where(F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(parts)) == i) for i in range(parts)]
    for part in out:
        part._sifter_group = _group_of(qside)  # type: ignore[attr-defined]
        _keep_bound(part, qside)
    return out


# Up to as many (question, document) pairs the row expressions take less time (15 microseconds a pair) than Python workers
# take to start.
ROW_PAIRS = 100_000


def _pairs(index: DataFrame, qside: DataFrame) -> int:
    """Number of (question, document) pairs, documents and groups counted once an index."""
    group_col = _group_of(qside)
    docs = getattr(index, "_sifter_docs", None)
    if docs is None:
        docs = index._sifter_docs = index.count()  # type: ignore[attr-defined]
    asked = getattr(qside, "_sifter_rows", None)
    asked = qside.count() if asked is None else asked
    return docs * asked // max(1, _n_groups(index, group_col) if group_col else 1)


def _asked(index: DataFrame, qside: DataFrame, ranges: DataFrame | None = None) -> dict | None:
    """The question side for the batch scores, shipped to every task; None above ``SIDE_BYTES`` or for few pairs."""
    if _pairs(index, qside) <= ROW_PAIRS:
        return None
    held = getattr(qside, "_sifter_asked", None)
    if held is None:
        terms = "qterms" in qside.columns
        n_terms = getattr(qside, "_sifter_terms", None) if terms else 0
        if n_terms is None:
            n_terms = qside.agg(F.coalesce(F.sum(F.size("qterms")), F.lit(0))).first()[0]
        if _side_bytes(qside) + 40 * n_terms > SIDE_BYTES:
            return None
        held = qside.select(*_keys(qside), "qvec", "qnorm", *(["qterms", "avgdl"] if terms else [])).toArrow()
        qside._sifter_asked = held  # type: ignore[attr-defined]
    return B.asked_by_group(held, _group_of(qside), None if ranges is None else ranges.toArrow())


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                embedding_col: str | None = None, group_col: str | None = None,
                expected_dim: int | None = None) -> DataFrame:
    """Per-document index row: ``[group,] doc_id, dl, tf, vec, vnorm`` (no shuffle).

    ``vec`` is the supplied embedding column, or the hashed embedding counts.
    ``group_col`` (e.g. ``kb_name``) makes every statistic and ranking per group.
    Persist the result as a table to reuse it across question batches.
    """
    rows = _index_input(docs, id_col, text_col, embedding_col, group_col)
    if embedding_col and expected_dim:
        # Every stored vector has the collection's width.
        rows = rows.withColumn("vec", F.when(F.size("vec") == expected_dim, F.col("vec")).otherwise(F.raise_error(
            F.concat(F.lit(f"embedding width != {expected_dim} for doc "), F.col("doc_id").cast("string")))))
    # Terms are counted and hashed once per distinct term of a batch.
    return B.count_rows(rows, "_text", None if embedding_col else HASH_DIM).withColumn("vnorm", norm("vec"))


def _index_input(docs: DataFrame, id_col: str, text_col: str, embedding_col: str | None, group_col: str | None) -> DataFrame:
    return docs.select(*_g(group_col), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"),
                       *([F.col(embedding_col).cast("array<double>").alias("vec")] if embedding_col else []))


# Buckets of a stored index for one partition of the documents' scan (128 MB by default).
SCAN_BUCKETS = 8


def store_index(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text",
                group_col: str | None = None) -> DataFrame:
    """The rows of :func:`build_index` over ``docs`` (a scan), stored in buckets by ``doc_id``.

    Texts are dealt to the buckets before they are counted, so a bucket is one task and one file whatever files and row
    groups the documents come in, and there are as many buckets as keep one at a share of a scan's partition. ``tf`` is stored
    as ``terms, counts, postings`` (:data:`batch_scores.PACKED`): batch scores read the postings alone, and the map is put
    together for those who ask for it.
    """
    rows = _index_input(docs, id_col, text_col, None, group_col)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), SCAN_BUCKETS * docs.rdd.getNumPartitions())
    rows = B.count_rows(rows.repartition(n, "doc_id"), "_text", HASH_DIM, packed=True).withColumn("vnorm", norm("vec"))
    packed = materialize_bucketed(rows, name, buckets=n)
    out = packed.select(*_g(group_col), "doc_id", "dl", F.map_from_arrays(held_terms(F.col("terms")), "counts").alias("tf"),
                        "vec", "vnorm")
    out._sifter_packed = packed  # type: ignore[attr-defined]
    return out


def held_terms(terms: Column) -> Column:
    """The distinct terms of a stored row (:func:`store_index`) in byte order."""
    return F.when(terms == "", F.array().cast("array<string>")).otherwise(F.split(terms, " "))


def term_code(term: Column) -> Column:
    """:func:`batch_scores.term_codes` as a row expression."""
    return F.conv(F.substring(F.md5(term), 1, 16), 16, -10).cast("bigint")


def _codes_clash(vocab: DataFrame, asked: DataFrame) -> bool:
    """Whether a question term of ``asked`` has the code of another term of the collection."""
    mine = bounded_broadcast(_keep_bound(asked.select(F.col("term").alias("_asked"), term_code(F.col("term")).alias("_code")), asked))
    return not vocab.select("term", term_code(F.col("term")).alias("_code")).join(mine, "_code").where(
        F.col("term") != F.col("_asked")).isEmpty()


def corpus_stats(index: DataFrame, group_col: str | None = None) -> DataFrame:
    """``[group,] n_docs, avgdl`` (empty documents included)."""
    return index.groupBy(*_g(group_col)).agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg(F.col("dl").cast("double")).alias("avgdl"))


def document_frequency(index: DataFrame, group_col: str | None = None) -> DataFrame:
    """``[group,] term, df`` over the whole vocabulary (partial+final aggregation)."""
    packed = getattr(index, "_sifter_packed", None)
    if packed is not None and not group_col:
        return B.term_counts(packed).groupBy("term").agg(F.sum("n").alias("df"))
    return (index.select(*_g(group_col), F.explode(F.map_keys("tf")).alias("term"))
            .groupBy(*_g(group_col), "term").agg(F.count(F.lit(1)).alias("df")))


def _raw_idf(df_col: Column, n_col: Column) -> Column:
    return F.log(n_col - df_col + 0.5) - F.log(df_col + 0.5)


def idf_floor(index: DataFrame, params: BM25Params = BM25Params(),
              group_col: str | None = None) -> DataFrame:
    """``[group,] n_docs, avgdl, eps_idf`` with eps_idf = epsilon * mean raw idf.

    One row per group: the number of groups (knowledge bases) is a catalog
    size, so these rows are broadcast.
    """
    stats = corpus_stats(index, group_col)
    dfs = document_frequency(index, group_col)
    n = _per_group(stats.select(*_g(group_col), "n_docs"), group_col, index)
    mean_idf = ((dfs.join(n, group_col) if group_col else dfs.crossJoin(n))
                .groupBy(*_g(group_col))
                .agg(F.avg(_raw_idf(F.col("df"), F.col("n_docs"))).alias("mean_idf")))
    joined = (stats.join(_per_group(mean_idf, group_col, index), group_col, "left") if group_col
              else stats.crossJoin(F.broadcast(mean_idf)))
    return joined.select(*_g(group_col), "n_docs", "avgdl",
                         (F.lit(params.epsilon) * F.coalesce(F.col("mean_idf"), F.lit(0.0)))
                         .alias("eps_idf"))


@dataclass
class IndexStats:
    """Materialised collection statistics: the term dictionary (``[group,]
    term, df``) and the per-group row ``n_docs, avgdl, eps_idf``."""
    vocab: DataFrame
    glob: DataFrame


def index_stats(index: DataFrame, params: BM25Params = BM25Params(),
                group_col: str | None = None) -> IndexStats:
    """Compute the term dictionary and global statistics once an index and group column (stored
    tables), for callers that ask several question batches."""
    held = index.__dict__.setdefault("_sifter_stats", {})
    if (params, group_col) not in held:
        vocab = materialize(document_frequency(index, group_col), "term-dictionary")
        held[params, group_col] = IndexStats(vocab, cut_lineage(with_floor(
            vocab, corpus_stats(index, group_col), params, group_col, index)))
    return held[params, group_col]


def with_floor(vocab: DataFrame, stats: DataFrame, params: BM25Params = BM25Params(), group_col: str | None = None,
               index: DataFrame | None = None) -> DataFrame:
    """``[group,] n_docs, avgdl, eps_idf`` from a term dictionary and ``[group,] n_docs, avgdl``."""
    n = _per_group(stats.select(*_g(group_col), "n_docs"), group_col, index)
    mean_idf = ((vocab.join(n, group_col) if group_col else vocab.crossJoin(n))
                .groupBy(*_g(group_col))
                .agg(F.avg(_raw_idf(F.col("df"), F.col("n_docs"))).alias("mean_idf")))
    joined = (stats.join(_per_group(mean_idf, group_col, index), group_col, "left") if group_col
              else stats.crossJoin(F.broadcast(mean_idf)))
    return joined.select(*_g(group_col), "n_docs", "avgdl",
                         (F.lit(params.epsilon) * F.coalesce(F.col("mean_idf"), F.lit(0.0))).alias("eps_idf"))


def prepare_questions(index: DataFrame, questions: DataFrame, id_col: str = "question_id",
                      text_col: str = "question", params: BM25Params = BM25Params(),
                      embedding_col: str | None = None, group_col: str | None = None,
                      groups: DataFrame | None = None, stats: IndexStats | None = None,
                      keyword: bool = True) -> DataFrame:
    """One row per question (per group) with everything scoring needs.

    ``[group,] query_id, qtoks, qterms ARRAY<STRUCT<term, w>>, qvec, qnorm, n_docs, avgdl``
    where ``w = query-term count * idf`` (repeated query terms count repeatedly;
    unknown terms have idf 0 and are left out). With ``group_col`` every
    question is asked of every group (C9: groups x questions), unless the
    questions already carry the group column. ``keyword=False`` prepares the vector side
    alone (``[group,] query_id, qtoks, qvec, qnorm``) for semantic search: no
    collection statistics are read.
    """
    q = questions.select(*([F.col(group_col)] if group_col and group_col in questions.columns
                           else []),
                         F.col(id_col).alias("query_id"), tokenize(text_col).alias("qtoks"),
                         *([F.col(embedding_col).cast("array<double>").alias("qvec")]
                           if embedding_col else []))
    if not embedding_col:
        q = q.withColumn("qvec", hashed_entries("qtoks"))
    else:
        q = q.withColumn("qvec", dense_entries("qvec"))
    q = q.withColumn("qnorm", entries_norm("qvec"))
    if group_col and group_col not in questions.columns:
        if groups is not None:
            g = bounded_broadcast(groups.select(group_col))
        else:
            g = bounded_broadcast(mark_bounded(index.select(group_col).distinct(),
                                               _n_groups(index, group_col)))
        q = g.crossJoin(q)
    # One size check on the question table: question count and total tokens
    # bound every question-side table derived below.
    n_q, n_tok = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("qtoks")), F.lit(0))).first()
    if not keyword:
        out = cut_lineage(q.select(*_g(group_col), "query_id", "qtoks", "qvec", "qnorm"))
        out._sifter_group = group_col  # type: ignore[attr-defined]
        out._sifter_entries = n_tok if not embedding_col else None  # type: ignore[attr-defined]
        return mark_bounded(out, n_q)
    q = bounded_broadcast(mark_bounded(q, n_q))
    if stats is None:
        stats = index_stats(index, params, group_col)  # the vocabulary is exploded once
    glob = _per_group(stats.glob, group_col, index)
    keys = _g(group_col) + ["query_id"]
    qt = (q.select(*keys, F.explode("qtoks").alias("term"))
          .groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("qtf")))
    # Vocabulary x (small, checked) query terms: only matching terms survive.
    dfs = stats.vocab.join(
        bounded_broadcast(mark_bounded(qt, n_tok)), _g(group_col) + ["term"])
    weighted = ((dfs.join(glob, group_col) if group_col else dfs.crossJoin(glob))
                .withColumn("raw", _raw_idf(F.col("df"), F.col("n_docs")))
                .withColumn("idf", F.when(F.col("raw") < 0, F.col("eps_idf"))
                            .otherwise(F.col("raw")))
                .groupBy(*keys)
                .agg(F.array_sort(F.collect_list(
                    F.struct("term", (F.col("qtf") * F.col("idf")).alias("w")))).alias("qterms")))
    base = q.join(weighted, keys, "left")
    base = base.join(glob, group_col, "left") if group_col else base.crossJoin(glob)
    out = base.select(*keys, "qtoks",
                      F.coalesce("qterms", F.array().cast("array<struct<term:string,w:double>>"))
                      .alias("qterms"),
                      "qvec", "qnorm", "n_docs", "avgdl")
    # The question side feeds several sub-plans (postings join, vectors,
    # zero fill, ranges); it is small (one row per question), so it is
    # materialised once in the shared checkpoint folder.
    out = cut_lineage(out)
    packed = getattr(index, "_sifter_packed", None)
    if packed is not None and not _codes_clash(stats.vocab, mark_bounded(qt.select("term").distinct(), n_tok)):
        out._sifter_coded = packed  # type: ignore[attr-defined]
    out._sifter_terms = n_tok  # type: ignore[attr-defined]
    out._sifter_entries = n_tok if not embedding_col else None  # type: ignore[attr-defined]
    out._sifter_group = group_col  # type: ignore[attr-defined]
    return mark_bounded(out, n_q)


def _keep_bound(derived: DataFrame, source: DataFrame) -> DataFrame:
    """A projection of a bounded side keeps its proven row bound."""
    n = getattr(source, "_sifter_rows", None)
    entries = getattr(source, "_sifter_entries", None)
    if entries is not None:
        derived._sifter_entries = entries  # type: ignore[attr-defined]
    return mark_bounded(derived, n) if n is not None else derived


def _group_of(qside: DataFrame) -> str | None:
    return getattr(qside, "_sifter_group", None)


def bm25_hits(index: DataFrame, qside: DataFrame, params: BM25Params = BM25Params()) -> DataFrame:
    """BM25 of every (question, document) pair sharing at least one term.

    Postings are exploded from the index rows and hash-joined with the
    broadcast (checked) question terms; contributions are summed by a
    partial+final aggregation. Pairs without a shared term score 0 and are
    not materialised.
    """
    group_col = _group_of(qside)
    k1, b = params.k1, params.b
    keys = _g(group_col) + ["query_id"]
    qterms = qside.select(*keys, "avgdl", F.explode("qterms").alias("qt")).select(
        *keys, "avgdl", F.col("qt.term").alias("term"), F.col("qt.w").alias("w"))
    n_terms = getattr(qside, "_sifter_terms", None)
    qterms = bounded_broadcast(mark_bounded(qterms, n_terms) if n_terms is not None else qterms)
    post = index.select(*_g(group_col), "doc_id", "dl", F.explode("tf").alias("term", "tf"))
    tf = F.col("tf").cast("double")
    contrib = F.col("w") * (tf * (k1 + 1)) / (
        tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
    return (post.join(qterms, _g(group_col) + ["term"])
            .groupBy(*keys, "doc_id").agg(F.sum(contrib).alias("bm25")))


def _zero_fill(index: DataFrame, qside: DataFrame, k: int) -> DataFrame:
    """Score-0 rows for the 2k smallest document ids of every question.

    A question with fewer than k hits is completed by the smallest ids without
    a hit; at most k-1 of the first 2k-1 ids can be hits, so 2k ids suffice.
    The id list is a top-2k per group (bounded), the question list is checked.
    """
    group_col = _group_of(qside)
    if group_col:
        w = Window.partitionBy(group_col).orderBy("doc_id")
        first_ids = bounded_broadcast(index.select(group_col, "doc_id")
                                .withColumn("_r", F.row_number().over(w))
                                .where(F.col("_r") <= 2 * k).drop("_r"))
    else:
        first_ids = F.broadcast(index.select("doc_id").orderBy("doc_id").limit(2 * k))
    qs = bounded_broadcast(_keep_bound(qside.select(*_g(group_col), "query_id"), qside))
    pairs = qs.join(first_ids, group_col) if group_col else qs.crossJoin(first_ids)
    return (pairs.select(*_g(group_col), "query_id", "doc_id", F.lit(0.0).alias("bm25")),
            first_ids)


def semantic_pairs(index: DataFrame, qside: DataFrame) -> DataFrame:
    """Cosine of every (question, document) pair (of the same group).

    The question side is broadcast behind a size check and the collection streams
    once through the join; larger question sides go in blocks (:func:`_join_side`).
    """
    group_col = _group_of(qside)
    side = _keep_bound(qside.select(*_g(group_col), "query_id", "qvec", "qnorm"), qside)
    pairs = _join_side(index, side, group_col)
    qn, dn = F.col("qnorm"), F.col("vnorm")
    cos = F.when((qn == 0) | (dn == 0), F.lit(0.0)).otherwise(
        entries_dot_dense("qvec", "vec") / (qn * dn))
    return pairs.select(*_g(group_col), "query_id", "doc_id", cos.alias("semantic"))


def top_k(scored: DataFrame, k: int, score_col: str = "score", part_col="query_id",
          id_col: str = "doc_id", digits: int | None = SCORE_DIGITS) -> DataFrame:
    """Rank 1..k per question by score desc, id asc (ties are certain).

    Scores are rounded to ``digits`` places before ranking so the order does
    not depend on floating-point summation order. ``row_number() <= k`` is
    planned as a partial WindowGroupLimit before the exchange.
    """
    parts = part_col if isinstance(part_col, list) else [part_col]
    s = F.round(score_col, digits) if digits is not None else F.col(score_col)
    w = Window.partitionBy(*parts).orderBy(F.desc(score_col), F.asc(id_col))
    return (scored.withColumn(score_col, s)
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def _keys(qside: DataFrame) -> list[str]:
    return _g(_group_of(qside)) + ["query_id"]


def bm25_topk(index: DataFrame, qside: DataFrame, k: int = DEFAULT_TOP_K,
              params: BM25Params = BM25Params()) -> DataFrame:
    """J4 keyword search: ``[group,] query_id, rank, doc_id, score`` (zero scores fill short lists)."""
    keys = _keys(qside)
    asked = _asked(index, qside)
    if asked is not None:  # every document is scored, 0 without a shared term
        scored = B.best_rows(index, qside, asked, _group_of(qside), "keyword", k, k1=params.k1, b=params.b)
        return top_k(scored, k, part_col=keys).select(*keys, "rank", "doc_id", "score")
    hits = bm25_hits(index, qside, params)
    fill, fill_ids = _zero_fill(index, qside, k)
    # Only hits among the 2k candidate ids can collide with a fill row: the
    # anti-join runs on two small sides (<= questions x 2k rows each).
    bound = (getattr(qside, "_sifter_rows", None) or 0) * 2 * k or None
    # Score only the <= 2k candidate documents (semi-join at the index scan).
    cand_index = index.join(fill_ids, _g(_group_of(qside)) + ["doc_id"], "left_semi")
    colliding = bm25_hits(cand_index, qside, params).select(*keys, "doc_id")
    if bound:
        colliding = mark_bounded(colliding, bound)
    fill = fill.join(bounded_broadcast(colliding), keys + ["doc_id"], "left_anti")
    scored = hits.unionByName(fill).withColumnRenamed("bm25", "score")
    return top_k(scored, k, part_col=keys).select(*keys, "rank", "doc_id", "score")


def semantic_topk(index: DataFrame, qside: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """J3 semantic search with the true cosine (not the constant 1.0)."""
    keys = _keys(qside)
    asked = _asked(index, qside)
    if asked is not None:
        return top_k(B.best_rows(index, qside, asked, _group_of(qside), "semantic", k), k, part_col=keys).select(
            *keys, "rank", "doc_id", "score")
    return top_k(semantic_pairs(index, qside).withColumnRenamed("semantic", "score"), k,
                 part_col=keys).select(*keys, "rank", "doc_id", "score")


def _minmax(col: str) -> Column:
    return ((F.col(col) - F.col(f"{col}_min"))
            / (F.col(f"{col}_max") - F.col(f"{col}_min") + F.lit(NORM_EPS)))


def hybrid_scores(index: DataFrame, qside: DataFrame, alpha: float = HYBRID_ALPHA,
                  params: BM25Params = BM25Params()) -> DataFrame:
    """Min-max normalise both scores over *all* documents per question (D13, H38),
    then blend ``(1-alpha)*bm25 + alpha*semantic`` (H39).

    No (question, document) pair is shuffled: BM25 hits are folded into one
    ``MAP<query_id, bm25>`` per document and group (an aggregation on doc_id), joined to
    the index on doc_id, and both scores are computed in the same row of the
    nested-loop join with the broadcast question side. With an index stored
    bucketed by doc_id (:func:`sifter.session.materialize_bucketed`) the hit
    aggregation, the fold and the join need no exchange at all; only the
    per-question ranges (one row per question) and the top-k rows move.
    Document ids must be unique within their group; the same id may stand in several.
    :mod:`sifter.operators.hybrid_search` gets the same rows from two indexes without
    scoring every pair.
    """
    group_col = _group_of(qside)
    keys = _keys(qside)
    hits = bm25_hits(index, qside, params)
    per_doc = hits.groupBy(*_g(group_col), "doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("query_id", "bm25"))).alias("_bm"))
    docs = index.select(*_g(group_col), "doc_id", "vec", "vnorm").join(
        per_doc, _g(group_col) + ["doc_id"], "left")
    side = _keep_bound(qside.select(*_g(group_col), "query_id", "qvec", "qnorm"), qside)
    pairs = _join_side(docs, side, group_col)
    qn, dn = F.col("qnorm"), F.col("vnorm")
    sem = F.when((qn == 0) | (dn == 0), F.lit(0.0)).otherwise(
        entries_dot_dense("qvec", "vec") / (qn * dn))
    pairs = pairs.select(*keys, "doc_id",
                         F.coalesce(F.col("_bm")[F.col("query_id")], F.lit(0.0)).alias("bm25"),
                         sem.alias("semantic"))
    ranges = pairs.groupBy(*keys).agg(
        F.min("bm25").alias("bm25_min"), F.max("bm25").alias("bm25_max"),
        F.min("semantic").alias("semantic_min"), F.max("semantic").alias("semantic_max"))
    ranges = bounded_broadcast(_keep_bound(ranges, qside))
    return (pairs.join(ranges, keys)
            .select(*keys, "doc_id", "bm25", "semantic",
                    ((F.lit(1.0 - alpha) * _minmax("bm25"))
                     + (F.lit(alpha) * _minmax("semantic"))).alias("score")))


def hybrid_topk(index: DataFrame, qside: DataFrame, k: int = DEFAULT_TOP_K,
                alpha: float = HYBRID_ALPHA, params: BM25Params = BM25Params()) -> DataFrame:
    """J5 + F2: ``[group,] query_id, rank, doc_id, score``. The rows of :func:`hybrid_scores`: the scores' ranges come
    from one pass over the index (a row per question and task), the blend's first k from a second one."""
    keys, group_col = _keys(qside), _group_of(qside)
    asked = _asked(index, qside)
    if asked is not None:
        ends = B.score_ranges(index, qside, asked, group_col, params.k1, params.b).groupBy(*keys).agg(
            *[(F.min if c.endswith("min") else F.max)(c).alias(c) for c in B.RANGES])
        scored = B.best_rows(index, qside, _asked(index, qside, ends), group_col, "both", k, alpha, params.k1, params.b, NORM_EPS)
        return top_k(scored, k, part_col=keys).select(*keys, "rank", "doc_id", "score")
    return top_k(hybrid_scores(index, qside, alpha, params), k, part_col=keys).select(
        *keys, "rank", "doc_id", "score")


def token_overlap_score(question: Column, text: Column) -> Column:
    """Default reranker: distinct question tokens found in the text / distinct question tokens."""
    q = F.array_distinct(tokenize(question))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(q, F.array_distinct(tokenize(text)))) / F.size(q))


def rerank(candidates: DataFrame, questions: DataFrame, docs: DataFrame, k: int = DEFAULT_TOP_K,
           scorer=token_overlap_score, q_id: str = "question_id", q_text: str = "question",
           d_id: str = "doc_id", d_text: str = "text", group_col: str | None = None) -> DataFrame:
    """Score (question, text) pairs of the candidates, sort desc, keep k.

    Ties keep the first-stage order. Document text is fetched late (C8): the
    candidate list (k' rows per question, checked) is broadcast into a scan
    of the documents, so text never enters a shuffle.
    """
    keys = _g(group_col) + ["query_id"]
    cand = bounded_broadcast(_keep_bound(
        candidates.select(*keys, "doc_id", F.col("rank").alias("rank1")), candidates))
    with_text = docs.select(*_g(group_col), F.col(d_id).alias("doc_id"),
                            F.col(d_text).alias("_text")).join(cand, _g(group_col) + ["doc_id"])
    qs = bounded_broadcast(questions.select(F.col(q_id).alias("query_id"),
                                            F.col(q_text).alias("_question")))
    scored = with_text.join(qs, "query_id").select(
        *keys, "doc_id", "rank1",
        F.round(scorer(F.col("_question"), F.col("_text")), SCORE_DIGITS).alias("score"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("rank1"))
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(*keys, "rank", "doc_id", "score", "rank1"))


def advanced_retrieval(index: DataFrame, qside: DataFrame, questions: DataFrame,
                       docs: DataFrame, k: int = DEFAULT_TOP_K, use_hybrid: bool = True,
                       use_reranking: bool = True, reranker_top_k: int = RERANK_TOP_K,
                       alpha: float = HYBRID_ALPHA, scorer=token_overlap_score,
                       q_id: str = "question_id", q_text: str = "question") -> DataFrame:
    """Hybrid (or semantic) first stage with k' = reranker_top_k when
    reranking, then rerank and keep k; otherwise trim to k."""
    first_k = reranker_top_k if use_reranking else k
    first = (hybrid_topk(index, qside, first_k, alpha) if use_hybrid
             else semantic_topk(index, qside, first_k))
    if not use_reranking:
        return first.where(F.col("rank") <= k)
    n_q = getattr(qside, "_sifter_rows", None)
    if n_q is not None:
        first = mark_bounded(first, n_q * first_k)  # at most k' rows per question
    return rerank(first, questions, docs, k, scorer, q_id=q_id, q_text=q_text,
                  group_col=_group_of(qside)).drop("rank1")


def search_method_description(use_hybrid: Column, alpha: Column, use_reranking: Column,
                              reranker_model: Column) -> Column:
    """``Semantic Search`` or ``Hybrid Search (α=..)`` [+ `` + Cross-Encoder Reranking (m)``]."""
    first = F.when(use_hybrid, F.concat(F.lit("Hybrid Search (α="), alpha.cast("string"),
                                        F.lit(")"))).otherwise(F.lit("Semantic Search"))
    second = F.when(use_reranking, F.concat(F.lit("Cross-Encoder Reranking ("), reranker_model,
                                            F.lit(")")))
    return F.concat_ws(" + ", first, second)
