"""Checks that must fire, sums that must not overflow, and the path from files to answers."""

import json

import pytest
from pyspark.sql import functions as F

from sifter.operators import chunking as C
from sifter.operators import evaluation as EV
from sifter.operators import retrieval as R
from sifter.operators import training_data as TD
from sifter.sources import files as S


@pytest.mark.parametrize("truths", [[["a"]], [["a"], ["b"], ["c"]]])
def test_question_set_mismatch_fails_for_every_projection(spark, tmp_path, truths):
    p = tmp_path / "q.json"
    p.write_text(json.dumps({"questions": ["x", "y"], "ground_truths": truths}))
    df = S.read_question_set(spark, str(p))
    for action in (lambda: df.select("question").collect(), df.count, df.collect):
        with pytest.raises(Exception, match="Number of ground truths must match"):
            action()


def test_result_files_without_metrics_fail(spark, tmp_path):
    (tmp_path / "results_1.json").write_text(json.dumps({"results": {"t": {}}}))
    with pytest.raises(Exception, match="No results with metrics found"):
        S.results_from_files(spark, str(tmp_path), "m").collect()


def test_means_of_ten_million_rows(spark):
    long = spark.range(10_000_000).select(F.lit("m").alias("metric"), F.lit(1.0).alias("value"))
    assert EV.metric_means(long, []).first().score == 1.0
    neg = spark.createDataFrame([("m", -0.25), ("m", -0.5), ("m", float("nan")), ("m", None)],
                                "metric string, value double")
    assert EV.metric_means(neg, []).first().score == -0.375


@pytest.mark.parametrize("values,want", [
    ([2.0e6], 2.0e6), ([3.0e12, 5.0e12], 4.0e12), ([4.999999e-6] + [0.0] * 9, 0.0),
    ([5e-6] + [0.0] * 9, 1e-6), ([-5e-6] + [0.0] * 9, 0.0), ([-5.000001e-6] + [0.0] * 9, -1e-6),
    ([0.1, 0.2, 0.3], 0.2), ([1 / 3], 0.333333), ([2 / 3], 0.666667)])
def test_means_round_half_up_at_every_size(spark, values, want):
    long = spark.createDataFrame([("m", v) for v in values], "metric string, value double")
    assert EV.metric_means(long, []).first().score == want


def test_ranking_counts_questions_without_rows(spark):
    ranked = spark.createDataFrame([(1, 1, 10)], "query_id int, rank int, doc_id int")
    relevant = spark.createDataFrame([(1, 10), (2, 20)], "query_id int, doc_id int")
    got = {r.query_id: tuple(r)[1:] for r in EV.ranking_metrics(ranked, relevant, ["query_id"], 5).collect()}
    assert got == {1: (1.0, 1.0, 1.0, 1.0), 2: (0.0, 0.0, 0.0, 0.0)}


def test_split_uses_many_buckets(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    out = TD.exact_split(df, "doc_id", 0.2)
    assert out.filter("split = 'train'").count() == 800
    assert out.select("doc_id").distinct().count() == 1000


def test_files_to_chunks_to_ranked_answers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Spark splits a shuffle into stages. " * 30)
    (tmp_path / "b.md").write_text("Parquet stores columns with statistics. " * 30)
    (tmp_path / "d.txt").write_text("A question of another kind altogether. " * 30)
    (tmp_path / "c.log").write_text("ignored")
    docs = S.load_documents(spark, str(tmp_path))
    assert docs.count() == 3
    questions = spark.createDataFrame([(1, "How are columns stored by parquet?")],
                                      "question_id int, question string")
    for strategy in ("recursive", "token", "semantic"):
        chunks = C.chunk_documents(docs, strategy, 200, 20)
        assert dict(chunks.dtypes)["doc_id"] == "string"
        index = R.build_index(chunks, id_col="chunk_id", text_col="text")
        top = R.semantic_topk(index, R.prepare_questions(index, questions, keyword=False), 1).first()
        assert "b.md" in top.doc_id
        assert "b.md" in R.bm25_topk(index, R.prepare_questions(index, questions), 1).first().doc_id


def test_only_json_numbers_are_metrics(spark, tmp_path):
    body = json.dumps({"results": {"t": {"acc": 0.5, "n": 3, "flag": True, "alias": "12", "yes": "true",
                                         "none": None, "list": [1]}}, "config": {"model": "m"}})
    (tmp_path / "results_1.json").write_text(body)
    want = {("acc", 0.5), ("n", 3.0), ("flag", 1.0)}
    from sifter.operators import results as RS
    one = RS.flatten_results(spark.createDataFrame([("m", body)], "model string, json string"))
    for df in (one, S.results_from_files(spark, str(tmp_path), "m")):
        assert {(r.metric, r.value) for r in df.collect()} == want


def test_small_columns(spark):
    from sifter.functions import formatting as FM
    from sifter.functions import text as T
    from sifter.operators import results as RS
    df = spark.sql("select 'a, b ,c' s, timestamp'2024-01-02 03:04:05' ts")
    r = df.select(T.comma_list("s"), FM.evaluation_run_id(F.lit("kb"), F.col("ts")),
                  FM.experiment_name(F.col("ts"))).first()
    assert tuple(r) == (["a", "b", "c"], "eval_kb_1704164645", "exp_20240102_030405")
    long = spark.createDataFrame([("m", "t", "b", 2.0), ("m", "t", "a", 1.0)],
                                 "model string, task string, metric string, value double")
    assert RS.final_metric_map(long).first().metrics == {"t_a": 1.0, "t_b": 2.0}


def test_grade_prompt_holds_every_retrieved_document(spark):
    from conftest import SF_SMALL
    from sifter.plans.registry import QUERIES
    found = {}
    for r in sorted(QUERIES["query_result_nested"](spark, SF_SMALL).select(
            "question_id", "rank", "content").collect()):
        found.setdefault(r.question_id, []).append(r.content)
    got = {r.question_id: r for r in QUERIES["grade_prompt"](spark, SF_SMALL).collect()}
    assert set(got) == set(found) and max(map(len, found.values())) == 5
    for q, contents in found.items():
        assert "\n\n".join(contents) in got[q].grade and "\n\n".join(contents) in got[q].answer
