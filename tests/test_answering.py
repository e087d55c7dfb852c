"""Chunk store to ranked answers, and hooks whose failures stay in their row."""

import pytest
from pyspark.sql import functions as F

from sifter import hooks
from sifter.operators import answering as AN
from sifter.operators import chunking as C
from sifter.operators import retrieval as R
from sifter.sources import catalog as CAT
from sifter.sources import files as S


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Files of two knowledge bases, loaded and chunked."""
    folder = tmp_path_factory.mktemp("kb")
    texts = {"a/one.txt": "Spark splits a shuffle into stages. " * 8, "a/two.md": "Parquet stores columns with statistics. " * 8,
             "b/three.txt": "A river flows to the sea. " * 8, "b/four.txt": "Columns of marble hold the roof. " * 8}
    for name, text in texts.items():
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_text(text)
    docs = None
    for kb in "ab":
        part = S.load_documents(spark, str(folder / kb)).withColumn("kb_name", F.lit(kb))
        docs = part if docs is None else docs.unionByName(part)
    chunks = C.token_chunks(docs, 12, 2, kb_col=F.col("kb_name")).cache()
    questions = spark.createDataFrame([(1, "How are columns stored by parquet?"), (2, "Where does a river flow?")],
                                      "question_id bigint, question string")
    return chunks, questions


def catalog(spark, **by_kb):
    rows = CAT.default_configs(spark.createDataFrame([(k,) for k in by_kb], "kb_name string"))
    for field in AN.SETTINGS:
        for kb, settings in by_kb.items():
            if field in settings:
                rows = rows.withColumn(field, F.when(F.col("name") == kb, F.lit(settings[field])).otherwise(F.col(field)))
    return rows


def test_each_knowledge_base_is_searched_as_its_row_says(spark, store):
    chunks, questions = store
    rows = catalog(spark, a={"use_hybrid_search": True, "hybrid_alpha": 0.25, "use_reranking": True}, b={})
    assert [(s["use_hybrid_search"], names) for s, names in AN.configurations(rows)] == [(False, ["b"]), (True, ["a"])]
    got = AN.retrieve(rows, chunks, questions, k=3)
    methods = {(r.kb_name, r.search_method) for r in got.collect()}
    assert methods == {("a", "Hybrid Search (α=0.25) + Cross-Encoder Reranking (cross-encoder/ms-marco-MiniLM-L-12-v2)"),
                       ("b", "Semantic Search")}
    for kb, settings in (("a", {"use_hybrid": True, "alpha": 0.25, "use_reranking": True}), ("b", {
            "use_hybrid": False, "use_reranking": False})):
        mine = chunks.where(F.col("kb_name") == kb)
        index = R.build_index(mine, id_col="chunk_id")
        want = R.advanced_retrieval(index, R.prepare_questions(index, questions), questions,
                                    mine.select(F.col("chunk_id").alias("doc_id"), "text"), k=3, **settings)
        assert sorted(tuple(r) for r in got.where(F.col("kb_name") == kb).select(
            "question_id", "rank", "chunk_id", "score").collect()) == sorted(tuple(r) for r in want.collect())
    assert AN.retrieve(rows.limit(0), chunks, questions).count() == 0


def test_answers_nest_their_chunks(spark, store):
    chunks, questions = store
    ranked = AN.with_content(AN.retrieve(catalog(spark, a={}), chunks, questions, k=2), chunks)
    r = AN.answer(ranked, questions).where("question_id = 1").first()
    assert r.top_k == 2 and [d.rank for d in r.documents] == [1, 2]
    assert "two.md" in str(r.documents[0].doc_id) and "Parquet stores columns" in r.documents[0].content
    assert r.prompt.endswith("Answer:") and r.documents[1].content in r.prompt
    assert r.answer == r.documents[0].content[:200] + "..." and r.answer_error is None


def test_a_failing_generator_keeps_all_ranked_rows(spark, store):
    def failing_generator():
        def predict(frame):
            if (frame["question"].str.contains("river")).any():
                raise RuntimeError("model refused")
            return frame["prompt"].str.len().astype(str) + " characters"
        return predict

    def broken_loader():
        raise OSError("no weights")

    chunks, questions = store
    ranked = AN.with_content(AN.retrieve(catalog(spark, a={}, b={}), chunks, questions, k=3), chunks)
    got = {(r.kb_name, r.question_id): r for r in AN.answer(ranked, questions, load=failing_generator).collect()}
    assert len(got) == 4 and sum(len(r.documents) for r in got.values()) == ranked.count()
    for (kb, q), r in got.items():
        if q == 2:
            assert r.answer == AN.FAILED_ANSWER and r.answer_error == "RuntimeError: model refused"
        else:
            assert r.answer == f"{len(r.prompt)} characters" and r.answer_error is None
    unloaded = AN.answer(ranked, questions, load=broken_loader).collect()
    assert {r.answer_error for r in unloaded} == {"OSError: no weights"} and len(unloaded) == 4


def test_isolated_model_is_loaded_once_a_task_and_keeps_columns(spark):
    def load():
        state = {"calls": 0}

        def predict(frame):
            state["calls"] += 1
            return [state["calls"] if x != 7 else 1 / 0 for x in frame["id"]]
        return predict

    df = spark.range(0, 40, 1, 2).withColumn("x", F.lit("kept"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = hooks.isolated(df, load, ["id"], "n", "int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 40 and {r.x for r in rows} == {"kept"}
    assert [r.id for r in rows if r.n is None] == [7] and "ZeroDivisionError" in [r.n_error for r in rows if r.id == 7][0]
    assert max(r.n for r in rows if r.id >= 20) == 2  # two batches in that task, one loaded model
