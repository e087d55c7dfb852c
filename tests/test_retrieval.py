from collections import Counter

from pyspark.sql import functions as F

from conftest import SF_SMALL
from sifter.functions.text import tokenize
from sifter.operators import retrieval as R
from sifter.plans import tables as T


def _setup(spark):
    idx = R.build_index(T.documents(spark, SF_SMALL)).cache()
    qside = R.prepare_questions(idx, T.questions(spark, SF_SMALL))
    return idx, qside


def _order(df):
    return [(r["query_id"], r["doc_id"]) for r in df.orderBy("query_id", "rank").collect()]


def test_alpha_extremes_follow_single_scores(spark):
    idx, q = _setup(spark)
    assert _order(R.hybrid_topk(idx, q, 5, alpha=0.0)) == _order(R.bm25_topk(idx, q, 5))
    assert _order(R.hybrid_topk(idx, q, 5, alpha=1.0)) == _order(R.semantic_topk(idx, q, 5))


def test_hybrid_scores_in_unit_range_and_ranks_dense(spark):
    idx, q = _setup(spark)
    s = R.hybrid_scores(idx, q, 0.5)
    lo, hi = s.agg(F.min("score"), F.max("score")).first()
    assert lo >= 0.0 and hi <= 1.0 + 1e-9
    top = R.hybrid_topk(idx, q, 7)
    per_q = top.groupBy("query_id").agg(F.collect_list("rank").alias("r")).collect()
    assert all(sorted(r["r"]) == list(range(1, 8)) for r in per_q)


def test_bm25_zero_fill_when_few_hits(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "banana"), (3, "cherry"), (4, "date")],
                                 "doc_id bigint, text string")
    qs = spark.createDataFrame([(0, "apple")], "question_id bigint, question string")
    idx = R.build_index(docs)
    top = R.bm25_topk(idx, R.prepare_questions(idx, qs), 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in top] == [1, 2, 3]
    assert top[0]["score"] > 0 and top[1]["score"] == 0.0


def test_bm25_idf_floor_and_repeated_terms(spark):
    # "common" is in every document: negative raw idf is replaced by eps * mean idf.
    docs = spark.createDataFrame([(1, "common rare"), (2, "common"), (3, "common other")],
                                 "doc_id bigint, text string")
    idx = R.build_index(docs)
    g = R.idf_floor(idx).first()
    import math
    raw = {"common": math.log(3 - 3 + 0.5) - math.log(3.5), "rare": math.log(2.5) - math.log(1.5),
           "other": math.log(2.5) - math.log(1.5)}
    assert abs(g["eps_idf"] - 0.25 * sum(raw.values()) / 3) < 1e-12
    qs = spark.createDataFrame([(0, "rare rare")], "question_id bigint, question string")
    hits = R.bm25_hits(idx, R.prepare_questions(idx, qs)).collect()
    assert len(hits) == 1 and hits[0]["doc_id"] == 1
    avgdl = 5 / 3
    one = raw["rare"] * (1 * 2.5) / (1 + 1.5 * (0.25 + 0.75 * 2 / avgdl))
    assert abs(hits[0]["bm25"] - 2 * one) < 1e-12


def test_grouped_retrieval_stays_inside_group(spark):
    docs = spark.createDataFrame([(1, "a", "x y"), (2, "a", "y z"), (3, "b", "x x")],
                                 "doc_id bigint, kb string, text string")
    idx = R.build_index(docs, group_col="kb")
    qs = spark.createDataFrame([(0, "x")], "question_id bigint, question string")
    top = R.hybrid_topk(idx, R.prepare_questions(idx, qs, group_col="kb"), 5).collect()
    assert {(r["kb"], r["doc_id"]) for r in top} == {("a", 1), ("a", 2), ("b", 3)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shape_topk_and_no_python(spark):
    idx, q = _setup(spark)
    for df in (R.bm25_topk(idx, q, 5), R.semantic_topk(idx, q, 5), R.hybrid_topk(idx, q, 5)):
        p = _plan(df)
        assert "WindowGroupLimit" in p
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    sem = _plan(R.semantic_topk(idx, q, 5))
    assert "BroadcastNestedLoopJoin" in sem
    assert "BroadcastHashJoin" in _plan(R.bm25_hits(idx, q))


def test_bucketed_index_shuffles_only_question_keyed_rows(spark):
    import re
    from sifter.session import materialize_bucketed
    idx = materialize_bucketed(R.build_index(T.documents(spark, SF_SMALL)), "test_idx")
    q = R.prepare_questions(idx, T.questions(spark, SF_SMALL))
    for df in (R.hybrid_topk(idx, q, 5), R.bm25_topk(idx, q, 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        assert exchanges, plan
        assert all("doc_id" not in e for e in exchanges), exchanges


def test_user_model_hook_reranks(spark):
    """A user model plugs in as an Arrow-batched column (loaded once per task)."""
    import pandas as pd
    from sifter.hooks import batch_model_column

    def load():
        def predict(batch: pd.DataFrame) -> pd.Series:
            return batch["c1"].str.len().astype("float64")  # longer text = more relevant
        return predict

    docs = spark.createDataFrame([(1, "a"), (2, "a bb ccc"), (3, "a b")], "doc_id bigint, text string")
    qs = spark.createDataFrame([(0, "a")], "question_id bigint, question string")
    cand = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "query_id bigint, rank int, doc_id bigint")
    out = R.rerank(cand, qs, docs, k=2, scorer=lambda q, t: batch_model_column(load, "double", q, t))
    assert [r["doc_id"] for r in out.orderBy("rank").collect()] == [2, 3]


def test_over_bound_side_is_not_broadcast(spark, monkeypatch):
    """Above the row bound the hint is dropped and Catalyst plans a shuffle
    join; the results are the same."""
    from sifter.plans import sizing
    idx, q = _setup(spark)
    want = _order(R.bm25_topk(idx, q, 5))
    monkeypatch.setattr(sizing, "DEFAULT_BROADCAST_ROWS", 1)
    monkeypatch.setattr(R, "bounded_broadcast",
                        lambda df, max_rows=1: sizing.bounded_broadcast(df, max_rows))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q2 = R.prepare_questions(idx, T.questions(spark, SF_SMALL))
        df = R.bm25_topk(idx, q2, 5)
        plan = df._jdf.queryExecution().executedPlan().toString()
        # The question-term side is over the bound: the postings join on
        # term is planned as a shuffle join (the 2k zero-fill ids, bounded by
        # a limit, may still be broadcast).
        import re
        assert not re.search(r"BroadcastHashJoin \[term", plan)
        assert re.search(r"(SortMergeJoin|ShuffledHashJoin) \[term", plan)
        assert _order(df) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bounded_broadcast_counts_unmarked_sides(spark):
    from sifter.plans.sizing import bounded_broadcast, mark_bounded
    df = spark.range(10)
    assert "ResolvedHint" in bounded_broadcast(df, 10)._jdf.queryExecution().analyzed().toString() \
        or "broadcast" in bounded_broadcast(df, 10)._jdf.queryExecution().analyzed().toString().lower()
    big = bounded_broadcast(df, 5)
    assert "broadcast" not in big._jdf.queryExecution().analyzed().toString().lower()
    marked = bounded_broadcast(mark_bounded(spark.range(10 ** 9), 3), 5)  # proven bound, no count
    assert "broadcast" in marked._jdf.queryExecution().analyzed().toString().lower()


def test_ranked_lists_do_not_form_pairs_in_the_plan(spark, monkeypatch):
    # Documents meet the questions in batches: no row per (question, document) pair.
    monkeypatch.setattr(R, "ROW_PAIRS", 0)
    idx, q = _setup(spark)
    for df in (R.bm25_topk(idx, q, 5), R.semantic_topk(idx, q, 5), R.hybrid_topk(idx, q, 5)):
        p = _plan(df)
        assert "MapInArrow" in p and "NestedLoopJoin" not in p and "CartesianProduct" not in p and "BroadcastHashJoin" not in p


def test_batch_ranks_equal_pair_ranks(spark, monkeypatch):
    # Ties, copies, empty and null texts, several groups, text ids; more documents than one batch step.
    words = "ape bee cat dog eel fox gnu hen".split()
    docs = [(f"d{i}", f"kb{i % 3}", None if i % 97 == 0 else " ".join(words[(i * j) % 8] for j in range(1, i % 6)))
            for i in range(2600)]
    docs = spark.createDataFrame(docs, "doc_id string, kb string, text string")
    qs = spark.createDataFrame([(0, "ape bee bee"), (1, "cat fox ape"), (2, "yak"), (3, ""), (4, "hen dog eel gnu")],
                               "question_id bigint, question string")
    for group in (None, "kb"):
        idx = R.build_index(docs, group_col=group).repartition(3).cache()
        monkeypatch.undo()
        monkeypatch.setattr(R, "ROW_PAIRS", 0)
        q = R.prepare_questions(idx, qs, group_col=group)
        runs = [lambda: R.bm25_topk(idx, q, 7), lambda: R.semantic_topk(idx, q, 7), lambda: R.hybrid_topk(idx, q, 7, 0.3)]

        def rows(df):
            return sorted((*(r[c] for c in df.columns if c != "score"), round(r["score"], 6)) for r in df.collect())
        got = [rows(run()) for run in runs]
        q._sifter_asked = None
        monkeypatch.setattr(R, "_asked", lambda *a: None)
        assert got == [rows(run()) for run in runs]


def test_batch_rounding_is_the_engines(spark):
    import numpy as np
    from sifter.operators import batch_scores as B
    x = [0.1234565, 0.1234575, -0.1234565, 2.5e-7, 5e-7, 0.9999995, 1 / 3, -2 / 3, 0.0, 123456.0000005]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert list(B.ranked_value(np.array(x))) == [r[0] for r in df.select(F.round("x", 6)).collect()]


def test_index_rows_in_batches_equal_row_expressions(spark):
    from sifter.functions.text import term_frequencies, tokenize
    from sifter.functions.vectors import hashed_counts
    docs = T.documents(spark, SF_SMALL).select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "Été été ÉTÉ x_1 x_1")], "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in R.build_index(docs).collect()}
    want = docs.select("doc_id", tokenize("text").alias("t")).select(
        "doc_id", F.size("t").alias("dl"), term_frequencies("t").alias("tf"), hashed_counts("t").alias("vec"))
    for r in want.collect():
        assert (r["dl"], r["tf"], r["vec"]) == tuple(got[r["doc_id"]][c] for c in ("dl", "tf", "vec"))


def test_batches_split_latin_texts_like_the_row_expression(spark):
    """The index counts tokens of Latin-1 texts in its Arrow batches, and of all others by the row expression."""
    import pyarrow as pa
    from sifter.operators import batch_scores as B
    texts = ["".join(map(chr, range(256))), " ".join(f"Ab{chr(c)}c{chr(c)} {chr(c)}" for c in range(256)), None, "", " \x85\xa0\x1c\t",
             "Plain-text, it's A_B 2x\n\nÀÉß µ² ¼ × ÷", "İstanbul ΣΑΣ  x’s 日本 Ab", "a" * 3000 + " é" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = {r.doc_id: r.t for r in df.select("doc_id", tokenize("text").alias("t")).collect()}
    for r in R.build_index(df).collect():
        assert r.dl == (None if want[r.doc_id] is None else len(want[r.doc_id])), r.doc_id
        assert (r.tf or {}) == dict(Counter(want[r.doc_id] or [])), r.doc_id
    latin = [i for i, t in enumerate(texts) if t is None or max(map(ord, t), default=0) < 256]
    got = B._split(pa.array([texts[i] for i in latin], pa.string()), pa.nulls(len(latin), pa.list_(pa.string())))
    assert got.to_pylist() == [want[i] for i in latin]


def _stored(spark, tmp_path):
    docs = T.documents(spark, SF_SMALL).select("doc_id", "text", "source").unionByName(spark.createDataFrame(
        [(-1, None, "src0"), (-2, "", "src1"), (-3, "Été été ÉTÉ x_1 x_1", None), (-4, "日本 Ab İstanbul", "src1")],
        "doc_id bigint, text string, source string"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs").withColumnRenamed("source", "kb_name")
    return docs, R.store_index(docs, "test_stored_idx", group_col="kb_name")


def test_stored_index_deals_one_row_group_to_all_buckets(spark, tmp_path):
    """A file of one row group is counted by many tasks, one file a bucket; the rows are build_index's."""
    docs, idx = _stored(spark, tmp_path)
    files = {r[0]: r[1] for r in idx.groupBy(F.input_file_name()).count().collect()}
    assert len(files) >= 8 and max(files.values()) < docs.count() / 3
    plan = idx._sifter_packed.groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    want = {r["doc_id"]: r for r in R.build_index(docs, group_col="kb_name").collect()}
    got = {r["doc_id"]: r for r in idx.collect()}
    assert got == want and list(got[-3].asDict()) == list(want[-3].asDict()) and got[-3]["tf"] == {"x_1": 2, "été": 3}
    count = lambda i: {(r["term"], r["df"]) for r in R.document_frequency(i).collect()}
    assert count(idx) == count(R.build_index(docs))


def test_batch_scores_read_stored_postings_and_not_terms(spark, tmp_path, monkeypatch):
    """Ranked lists from a stored index read numbers; a code that two terms share sends them to the terms."""
    docs, idx = _stored(spark, tmp_path)
    plain = R.build_index(docs, group_col="kb_name").cache()
    qs = T.questions(spark, SF_SMALL)
    monkeypatch.setattr(R, "ROW_PAIRS", 0)
    searches = [lambda i, q: R.hybrid_topk(i, q, 5), lambda i, q: R.hybrid_topk(i, q, 5, alpha=0.0),
                lambda i, q: R.bm25_topk(i, q, 5), lambda i, q: R.semantic_topk(i, q, 5)]
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = [rows(s(plain, R.prepare_questions(plain, qs))) for s in searches]
    q = R.prepare_questions(idx, qs)
    assert q._sifter_coded is idx._sifter_packed
    plan = searches[2](idx, q)._jdf.queryExecution().executedPlan().toString()
    assert "postings" in plan and "terms" not in plan
    assert [rows(s(idx, q)) for s in searches] == want
    monkeypatch.setattr(R, "term_code", lambda t: F.length(t).cast("bigint"))
    q = R.prepare_questions(idx, qs)
    assert not hasattr(q, "_sifter_coded")
    assert [rows(s(idx, q)) for s in searches] == want


def test_term_codes_agree_between_batches_and_rows(spark):
    """Short terms are hashed all at once, longer ones (above 55 bytes) one by one."""
    import pyarrow as pa
    from sifter.operators import batch_scores as B
    terms = ["a", "", "été", "日本", "x_1", "0", "é" * 27, "é" * 27 + "x", "é" * 28, "b" * 200] + [f"t{i}" * (i % 30) for i in range(500)]
    got = spark.createDataFrame([(t,) for t in terms], "t string").select(R.term_code(F.col("t"))).collect()
    assert [r[0] for r in got] == B.term_codes(pa.array(["skipped"] + terms).slice(1)).tolist()
    assert len(B.term_codes(pa.array([], pa.string()))) == 0
