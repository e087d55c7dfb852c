"""Index searches return the rows of the full scans while forming a part of the pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sifter.functions.vectors import dense_entries, entries_norm, norm
from sifter.operators import hybrid_search as HY
from sifter.operators import keyword_index as KI
from sifter.operators import retrieval as R
from sifter.operators import vector_index as VI
from sifter.plans import tables as T
from sifter.plans.sizing import mark_bounded

COLS = ["query_id", "rank", "doc_id", "score"]


def rows(df, cols=COLS):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --------------------------------------------------------------- keyword

def corpus(spark, n=600, seed=1):
    """Zipf words in two knowledge bases, ids shared between them, empty and repeated documents."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(400)])
    p = 1 / np.arange(1, 401)
    out = []
    for i in range(n):
        words = rng.choice(vocabulary, int(rng.integers(0, 60)), p=p / p.sum())
        out.append((i // 2, "ab"[i % 2], " ".join(words)))
    out += [(1000 + i, "a", "w1 w2 w300 w300") for i in range(20)]
    questions = [(0, "w300 w301 w302"), (1, "w0 w1 w2 w350"), (2, "w0"), (3, "unknown"), (4, ""),
                 (5, "w9 w9 w10 w11 w12 w390"), (6, out[7][2])]
    return (spark.createDataFrame(out, "doc_id bigint, kb string, text string"),
            spark.createDataFrame(questions, "question_id bigint, question string"))


@pytest.mark.parametrize("k", [1, 5, 20])
def test_keyword_search_equals_the_full_scan(spark, k):
    docs, qs = corpus(spark)
    index = R.build_index(docs.withColumn("doc_id", F.monotonically_increasing_id())).cache()
    kindex = KI.build_keyword_index(index)
    q = R.prepare_questions(index, qs, stats=kindex.stats)
    found = KI.search(kindex, q, k)
    assert rows(found.ranked) == rows(R.bm25_topk(index, q, k))
    work = {r.query_id: r for r in found.work.collect()}
    if k == 1:  # one long document answers question 6: little else is scored whole
        assert work[6].scored_pairs < 60 < index.count()


def test_keyword_search_inside_groups(spark):
    docs, qs = corpus(spark)
    index = R.build_index(docs, group_col="kb").cache()
    kindex = KI.build_keyword_index(index, group_col="kb")
    q = R.prepare_questions(index, qs, group_col="kb", stats=kindex.stats)
    cols = ["kb", *COLS]
    assert rows(KI.search(kindex, q, 5).ranked, cols) == rows(R.bm25_topk(index, q, 5), cols)


def test_keyword_search_scores_few_pairs_whole(spark):
    docs, qs = T.documents(spark, SF_SMALL), T.questions(spark, SF_SMALL)
    index = R.build_index(docs).cache()
    kindex = KI.build_keyword_index(index)
    q = R.prepare_questions(index, qs, stats=kindex.stats)
    found = KI.search(kindex, q, 5)
    assert rows(found.ranked) == rows(R.bm25_topk(index, q, 5))
    touched, whole = found.work.agg(F.sum("touched_pairs"), F.sum("scored_pairs")).first()
    assert whole < 0.2 * qs.count() * docs.count() and touched < R.bm25_hits(index, q).count()


def test_keyword_search_with_negative_floor(spark):
    """Every term in most documents: the idf floor is negative, bounds stay bounds."""
    docs = spark.createDataFrame([(i, "x y z" if i % 5 else "x y") for i in range(40)], "doc_id bigint, text string")
    qs = spark.createDataFrame([(0, "x"), (1, "z x"), (2, "z z y")], "question_id bigint, question string")
    index = R.build_index(docs).cache()
    kindex = KI.build_keyword_index(index)
    q = R.prepare_questions(index, qs, stats=kindex.stats)
    assert rows(KI.search(kindex, q, 3).ranked) == rows(R.bm25_topk(index, q, 3))


# ---------------------------------------------------------------- vector

def directions(spark, n=4000, dim=24, centres=40, seed=2):
    """Clusters of vectors with copies, zero vectors and two knowledge bases; questions are every 50th vector,
    a zero vector and one far from everything."""
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(centres, size=n)] + 0.08 * rng.normal(size=(n, dim))
    x[100:140] = x[100]
    x[200:205] = 0
    data = [(i, "ab"[i % 3 == 0], [float(v) for v in x[i]]) for i in range(n)]
    index = spark.createDataFrame(data, "doc_id bigint, kb string, vec array<double>").withColumn(
        "vnorm", norm("vec")).repartition(4).cache()
    asked = [(i, data[i][2]) for i in range(0, n, 50)] + [(n, [0.0] * dim), (n + 1, [float(v) for v in -c.sum(0)])]
    q = spark.createDataFrame(asked, "query_id bigint, v array<double>").select(
        "query_id", dense_entries("v").alias("qvec")).withColumn("qnorm", entries_norm("qvec")).cache()
    return index, mark_bounded(q, len(asked))


def full_scan(index, q, k, keys=("query_id",)):
    q = mark_bounded(q, q.count())
    return R.top_k(R.semantic_pairs(index, q).withColumnRenamed("semantic", "score"), k, part_col=list(keys))


@pytest.mark.parametrize("k", [1, 5, 60])
def test_vector_search_equals_the_full_scan(spark, k):
    index, q = directions(spark)
    vindex = VI.build_vector_index(index.drop("kb"))
    assert vindex.vectors.count() == index.count()
    found = VI.exact_search(vindex, q, k)
    assert rows(found.ranked) == rows(full_scan(index.drop("kb"), q, k))
    visited, multiplied = found.work.where("query_id < 4000").agg(F.sum("visited"), F.sum("multiplied")).first()
    if k == 5:  # clusters: a small part of the pairs
        assert multiplied <= visited < 0.2 * 80 * index.count()


def test_vector_search_inside_groups_and_crowded_parts(spark, monkeypatch):
    monkeypatch.setattr(VI, "PART_ROWS", 16)
    index, q = directions(spark, n=1200)
    vindex = VI.build_vector_index(index, group_col="kb", n_cells=12)
    assert vindex.parts.agg(F.max("salts")).first()[0] > 1
    grid = q.crossJoin(index.select("kb").distinct())
    grid._sifter_group = "kb"
    mark_bounded(grid, grid.count())
    cols = ["kb", *COLS]
    want = R.top_k(R.semantic_pairs(index, grid).withColumnRenamed("semantic", "score"), 5, part_col=["kb", "query_id"])
    assert rows(VI.exact_search(vindex, grid, 5).ranked, cols) == rows(want, cols)


def test_approximate_vector_search_reaches_its_recall(spark):
    index, q = directions(spark)
    vindex = VI.build_vector_index(index.drop("kb"))
    asked = mark_bounded(q.where("query_id < 4000"), 80)
    exact = full_scan(index.drop("kb"), asked, 5)
    found = VI.approximate_search(vindex, asked, 5)
    assert VI.recall(found.ranked, exact).first()[0] >= 0.9
    assert found.work.agg(F.sum("visited")).first()[0] < 0.2 * 80 * index.count()
    # Vectors without clusters: calibration takes more cells, the recall holds.
    emb = T.load(spark, "/root/testdata/sf0.01", "embeddings")
    noise = emb.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec")).withColumn(
        "vnorm", norm("vec")).cache()
    ask = noise.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), dense_entries("vec").alias("qvec"),
                                                F.col("vnorm").alias("qnorm"))
    ask = mark_bounded(ask, ask.count())
    found = VI.approximate_search(VI.build_vector_index(noise), ask, 5)
    assert VI.recall(found.ranked, full_scan(noise, ask, 5)).first()[0] >= 0.9


def test_vector_index_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, vec array<double>, vnorm double")
    q = mark_bounded(spark.createDataFrame([(1, [(0, 1.0)], 1.0)], "query_id int, qvec array<struct<i:int,w:double>>, "
                                           "qnorm double"), 1)
    assert VI.exact_search(VI.build_vector_index(none), q, 3).ranked.count() == 0


# ---------------------------------------------------------------- hybrid

@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_hybrid_search_equals_the_full_scan(spark, alpha):
    docs, qs = corpus(spark)
    index = R.build_index(docs, group_col="kb").cache()  # ids stand in both knowledge bases
    hindex = HY.build_hybrid_index(index, group_col="kb")
    q = R.prepare_questions(index, qs, group_col="kb", stats=hindex.keyword.stats)
    found = HY.search(hindex, q, 5, alpha, first_depth=8)
    cols = ["kb", *COLS]
    assert rows(found.ranked, cols) == rows(R.hybrid_topk(index, q, 5, alpha), cols)


def test_hybrid_scores_part_of_the_pairs(spark):
    docs, qs = T.documents(spark, "/root/testdata/sf0.01"), T.questions(spark, "/root/testdata/sf0.01")
    index = R.build_index(docs).cache()
    hindex = HY.build_hybrid_index(index)
    q = R.prepare_questions(index, qs, stats=hindex.keyword.stats)
    found = HY.search(hindex, q, 5, 0.5)
    assert rows(found.ranked) == rows(R.hybrid_topk(index, q, 5, 0.5))
    assert found.pairs < 0.5 * qs.count() * docs.count()


def test_keyword_ranges_without_a_witness(spark):
    """Every document shares a term with the question: the least score is a real one."""
    docs = spark.createDataFrame([(i, "x " * (i % 3 + 1) + ("y" if i % 4 else "z")) for i in range(30)],
                                 "doc_id bigint, text string")
    qs = spark.createDataFrame([(0, "y x"), (1, "z"), (2, "q")], "question_id bigint, question string")
    index = R.build_index(docs).cache()
    hindex = HY.build_hybrid_index(index)
    q = R.prepare_questions(index, qs, stats=hindex.keyword.stats)
    best = KI.search(hindex.keyword, q, 1, fill=False).ranked.select("query_id", "raw")
    got = {r.query_id: (r.bm_min, r.bm_max) for r in HY.keyword_ranges(hindex, q, best).collect()}
    scores = R.hybrid_scores(index, q).groupBy("query_id").agg(F.min("bm25").alias("a"), F.max("bm25").alias("b"))
    for r in scores.collect():
        assert math.isclose(got[r.query_id][0], r.a, abs_tol=1e-9) and math.isclose(got[r.query_id][1], r.b, abs_tol=1e-9)
    for alpha in (0.0, 0.5):
        assert rows(HY.search(hindex, q, 4, alpha, first_depth=4).ranked) == rows(R.hybrid_topk(index, q, 4, alpha))


def test_keyword_query_builds_no_vector_cells(spark, monkeypatch):
    from sifter.plans import registry

    def no_cells(*args, **kwargs):
        raise AssertionError("a keyword search reads no vectors")
    monkeypatch.setattr(VI, "build_vector_index", no_cells)
    monkeypatch.setattr(registry, "_INDEX_CACHE", {})
    sf = "/root/testdata/sf0.001"
    assert rows(registry.QUERIES["keyword_topk"](spark, sf)) == rows(registry.QUERIES["bm25_topk"](spark, sf))
