import json

from pyspark.sql import functions as F

from sifter.operators import results as RS


def test_flatten_filters_strings_and_keeps_bools(spark):
    doc = json.dumps({"results": {"arc_easy": {"alias": "arc_easy", "acc": 0.5, "flag": True}}})
    df = spark.createDataFrame([("m", doc)], "model string, json string")
    out = {(r["metric"], r["value"]) for r in RS.flatten_results(df).collect()}
    assert out == {("acc", 0.5), ("flag", 1.0)}


def test_best_performer_first_wins_tie(spark):
    long = spark.createDataFrame([("org/b", "t", "acc", 0.9), ("org/a", "t", "acc", 0.9),
                                  ("org/c", "t", "acc", 0.1)], "model string, task string, metric string, value double")
    order = spark.createDataFrame([("org/b", 0), ("org/a", 1), ("org/c", 2)], "model string, ord int")
    r = RS.best_performers(long, order).first()
    assert r["best_model"] == "b" and r["task_metric"] == "t_acc"


def test_categories_and_suites(spark):
    tasks = spark.createDataFrame([("hellaswag",), ("gsm8k",), ("mmlu",), ("custom",)], "task string")
    cats = {r["task"]: r["category"] for r in RS.categorize_tasks(tasks, spark).collect()}
    assert cats == {"hellaswag": "standard", "gsm8k": "reasoning", "mmlu": "knowledge", "custom": "other"}
    assert [r["task"] for r in RS.expand_suite(spark, "knowledge").orderBy("pos").collect()][:2] == \
        ["arc_easy", "arc_challenge"]
    for bad in (("custom", None), ("nope", None)):
        try:
            RS.expand_suite(spark, *bad)
            raise AssertionError
        except ValueError:
            pass


def test_log_regex_first_and_last(spark):
    lines = spark.createDataFrame([
        ("r", 1, "{'train_loss': 2.5, 'eval_accuracy': 0.1}"),
        ("r", 2, "{'train_loss': 1.5}"),
        ("r", 3, "{'eval_accuracy': 0.9, 'train_runtime': 12.0}")], "run string, ts int, line string")
    r = RS.log_line_metrics(lines, "run", "ts", "line").first()
    assert r["final_train_loss"] == 2.5 and r["eval_accuracy"] == 0.9 and r["train_runtime"] == 12.0
    assert r["eval_loss"] is None


def test_latency_zero_time(spark):
    runs = spark.createDataFrame([("m", 0.0, 10), ("m", 2.0, 10)], "model string, total_time double, tokens_generated int")
    r = RS.latency_stats(runs).first()
    assert r["avg_tokens_per_second"] == 2.5 and r["runs"] == 2


def test_select_newest(spark):
    files = spark.createDataFrame([
        ("a", 3, ["hellaswag"]), ("b", 2, ["HellaSwag ", "mmlu"]), ("c", 1, ["mmlu"])],
        "path string, mtime int, task_keys array<string>")
    assert RS.select_newest(files, ["mmlu", "hellaswag"]).first()["path"] == "b"
    assert RS.select_newest(files, ["other"]).first()["path"] == "a"
