"""What the index searches write: little beside the documents, and no (question, document) pairs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sifter.operators import hybrid_search as HY
from sifter.operators import keyword_index as KI
from sifter.operators import posting_segments as PS
from sifter.operators import retrieval as R
from sifter.operators import vector_index as VI
from sifter.plans import tables as T
from sifter.plans.sizing import mark_bounded
from test_search_indexes import COLS, corpus, directions, full_scan, rows

SF = "/root/testdata/sf0.01"


def stored_bytes(table):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(table._sifter_path.removeprefix("file:"))
               for f in names)


def recorded(monkeypatch, module):
    """Rows and bytes of every table that ``module`` stores, by name."""
    found = {}

    def of(store):
        def run(df, name, *args, **kwargs):
            out = store(df, name, *args, **kwargs)
            found.setdefault(name, []).append((out.count(), stored_bytes(out)))
            return out
        return run

    for name in ("materialize", "materialize_clustered"):
        if hasattr(module, name):
            monkeypatch.setattr(module, name, of(getattr(module, name)))
    return found


def test_keyword_search_stores_few_bytes_a_posting_and_no_pairs(spark, monkeypatch):
    docs, qs = T.documents(spark, SF), T.questions(spark, SF)
    index = R.store_index(docs, "disk_test_index")
    found = recorded(monkeypatch, KI)
    kindex = KI.build_keyword_index(index)
    q = R.prepare_questions(index, qs, stats=kindex.stats)
    result = KI.search(kindex, q, 5)
    assert rows(result.ranked) == rows(R.bm25_topk(index, q, 5))
    touched = result.work.agg(F.sum("touched_pairs")).first()[0]
    postings = kindex.stats.vocab.agg(F.sum("df")).first()[0]
    (_, size), = found.pop("posting-segments")
    assert size < 10 * postings
    assert sum(s for parts in found.values() for _, s in parts) < size    # what the search itself stores
    assert found["keyword-found"][0][0] < 0.1 * touched


def test_posting_segments_are_built_without_an_exchange(spark):
    docs, _ = corpus(spark)
    index = R.build_index(docs).withColumn("avgdl", F.lit(20.0))
    plan = PS.posting_segments(index, None, 1.5, 0.75, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_keyword_search_over_small_segments_and_question_parts(spark, monkeypatch):
    """Segments of a few documents, questions in several parts and steps, counts above a byte."""
    monkeypatch.setattr(PS, "SEGMENT_DOCS", 13)
    monkeypatch.setattr(PS, "PAIRS", 40)
    docs, qs = corpus(spark, n=200)
    extra = spark.createDataFrame([(5000, "a", "w300 " * 300 + "w1"), (5001, "a", "w301 " * 70_000), (5002, "a", None)],
                                  docs.schema)
    docs = docs.unionByName(extra).withColumn("doc_id", F.concat(F.lit("d"), "doc_id", "kb"))    # ids may be strings
    index = R.build_index(docs).cache()
    kindex = KI.build_keyword_index(index)
    q = R.prepare_questions(index, qs, stats=kindex.stats)
    want = rows(R.bm25_topk(index, q, 3))
    monkeypatch.setattr(R, "SIDE_BYTES", 2_000)
    assert len(KI._parts(q, 3)) > 1
    assert rows(KI.search(kindex, q, 3).ranked) == want


def test_bounds_are_bounds(spark):
    docs, _ = corpus(spark)
    index = R.build_index(docs).withColumn("avgdl", F.lit(20.0))
    segs = PS.posting_segments(index, None, 1.5, 0.75, 8).toArrow()
    heads = {r["segment"]: np.frombuffer(r["counts"], "<i4") for r in segs.to_pylist() if r["term"] == ""}
    postings = 0
    for r in segs.to_pylist():
        if r["term"] == "":
            continue
        place, count = np.frombuffer(r["places"], "<u2"), np.frombuffer(r["counts"], np.uint8).astype(int)
        impact = PS._impacts(count, heads[r["segment"]][place], 20.0, 1.5, 0.75)
        assert len(place) == len(count) == r["df"] and r["peak"] >= impact.max()
        for i, block in enumerate(np.unique(place // 8)):
            assert r["bounds"][i] * r["peak"] / 255 >= impact[place // 8 == block].max()
        postings += len(place)
    assert postings == R.document_frequency(index).agg(F.sum("df")).first()[0]


def test_vector_search_stores_no_pairs(spark, monkeypatch):
    """A task's k best, not every vector in reach (texts' vectors have no clusters: nearly all are)."""
    index = R.build_index(T.documents(spark, SF)).cache()
    q = R.prepare_questions(index, T.questions(spark, SF), keyword=False)
    vindex = VI.build_vector_index(index)
    found = recorded(monkeypatch, VI)
    result = VI.exact_search(vindex, q, 5)
    assert rows(result.ranked) == rows(R.semantic_topk(index, q, 5))
    stored, = found["vector-found"]
    assert stored[0] < 0.25 * result.work.agg(F.sum("multiplied")).first()[0]


def test_vector_search_with_question_parts(spark, monkeypatch):
    index, q = directions(spark, n=2000)
    index = index.drop("kb")
    want = rows(full_scan(index, q, 5))
    monkeypatch.setattr(R, "SIDE_BYTES", 10_000)
    assert len(R.dealt(q, R._side_bytes(q))) > 1
    assert rows(VI.exact_search(VI.build_vector_index(index), q, 5).ranked) == want


def test_vector_search_ranks_missing_and_odd_vectors_like_the_full_scan(spark, monkeypatch):
    monkeypatch.setattr(R, "ROW_PAIRS", 0)
    index, q = directions(spark, n=120)
    odd = spark.createDataFrame([(5000, None, None), (5001, [float("nan")] * 24, float("nan")), (5002, [0.0] * 24, 0.0)],
                                "doc_id bigint, vec array<double>, vnorm double")
    index = index.drop("kb").unionByName(odd)
    q = mark_bounded(q.where("qnorm > 0"), q.where("qnorm > 0").count())
    for k in (2, 130):
        got = VI.exact_search(VI.build_vector_index(index, n_cells=5), q, k).ranked
        want = R.semantic_topk(index, q, k)
        assert [str(r) for r in rows(got, ["query_id", "rank", "doc_id"])] == [str(r) for r in rows(want, ["query_id", "rank", "doc_id"])]


@pytest.mark.parametrize("group", [None, "kb"])
def test_hybrid_search_in_batches(spark, monkeypatch, group):
    """Pairs scored by document in batches, questions without a witness too; later rounds fall back to batches over all documents."""
    docs, qs = corpus(spark)
    if group is None:
        docs = docs.drop("kb").withColumn("doc_id", F.monotonically_increasing_id())
        index = R.store_index(docs, "disk_test_hybrid")
    else:
        index = R.build_index(docs, group_col="kb").cache()
    q = R.prepare_questions(index, qs, group_col=group)
    cols = [*R._g(group), *COLS]
    want = {alpha: rows(R.hybrid_topk(index, q, 5, alpha), cols) for alpha in (0.0, 0.5)}
    monkeypatch.setattr(R, "ROW_PAIRS", 0)
    monkeypatch.setattr(HY, "ROUND_ROWS", 500)
    hindex = HY.build_hybrid_index(index, group_col=group)
    for alpha, expected in want.items():
        assert rows(HY.search(hindex, q, 5, alpha, first_depth=8).ranked, cols) == expected
