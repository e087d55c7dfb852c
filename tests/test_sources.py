import json
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from sifter.sources import catalog as CAT
from sifter.sources import files as FS
from sifter.sources import sinks as SK


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="sifter-test-")


def _write(path, data, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


def test_load_documents_directory_and_single_file(spark, tmp):
    _write(f"{tmp}/docs/a.txt", "alpha")
    _write(f"{tmp}/docs/sub/b.md", "# beta")
    _write(f"{tmp}/docs/C.TXT", "upper")
    _write(f"{tmp}/docs/d.csv", "x")
    _write(f"{tmp}/docs/e.txt", b"\xff\xfe bad", "wb")
    _write(f"{tmp}/docs/f.pdf", b"%PDF", "wb")
    out = {os.path.basename(r["source_path"]): r for r in FS.load_documents(spark, f"{tmp}/docs").collect()}
    # Directory mode: glob-exact extensions, so C.TXT and d.csv are not loaded.
    assert set(out) == {"a.txt", "b.md", "e.txt", "f.pdf"}
    assert out["a.txt"]["text"] == "alpha" and out["b.md"]["file_type"] == "md"
    assert out["e.txt"]["_error"] and out["e.txt"]["text"] is None
    assert out["f.pdf"]["_error"] == "no extractor for pdf"
    single = FS.load_documents(spark, f"{tmp}/docs/C.TXT").collect()
    assert single[0]["text"] == "upper"
    pages = FS.load_documents(spark, f"{tmp}/docs", file_types=["pdf"],
                              extractors={"pdf": lambda b: [(1, "p1"), (2, "p2")]}).collect()
    assert sorted(r["text"] for r in pages) == ["p1", "p2"]


def test_read_dataset_formats(spark, tmp):
    _write(f"{tmp}/d.jsonl", '{"a": 1}\n{"a": 2}\n')
    _write(f"{tmp}/d.json", '[{"a": 1}, {"a": 2}, {"a": 3}]')
    _write(f"{tmp}/d.csv", 'text,label\n"multi\nline",1\nx,0\n')
    assert FS.read_dataset(spark, f"{tmp}/d.jsonl", "a int").count() == 2
    assert FS.read_dataset(spark, f"{tmp}/d.json", "a int").count() == 3
    rows = FS.read_dataset(spark, f"{tmp}/d.csv", "text string, label string").collect()
    assert rows[0]["text"] == "multi\nline" and len(rows) == 2


def test_question_set(spark, tmp):
    _write(f"{tmp}/q.json", json.dumps({"questions": ["a?", "b?"], "ground_truths": [["x"], ["y"]]}))
    rows = FS.read_question_set(spark, f"{tmp}/q.json").orderBy("question_id").collect()
    assert [(r["question"], r["ground_truths"]) for r in rows] == [("a?", ["x"]), ("b?", ["y"])]
    _write(f"{tmp}/bad.json", json.dumps({"questions": ["a?", "b?"], "ground_truths": [["x"]]}))
    with pytest.raises(Exception):
        FS.read_question_set(spark, f"{tmp}/bad.json").collect()
    _write(f"{tmp}/none.json", json.dumps({"other": 1}))
    assert FS.read_question_set(spark, f"{tmp}/none.json").count() == 0


def test_result_file_selection(spark, tmp):
    _write(f"{tmp}/run/results_old.json", json.dumps({"results": {"mmlu": {"acc": 0.1}, "gsm8k": {"acc": 0.2}}}))
    time.sleep(1.1)
    _write(f"{tmp}/run/sub/results_new.json", json.dumps({"results": {"mmlu": {"acc": 0.3}}}))
    chosen = FS.scan_result_files(spark, f"{tmp}/run", ["gsm8k", " MMLU"]).first()
    assert chosen["path"].endswith("results_old.json")
    newest = FS.scan_result_files(spark, f"{tmp}/run", ["other"]).first()
    assert newest["path"].endswith("results_new.json")
    long = FS.results_from_files(spark, f"{tmp}/run", "m", ["gsm8k"]).collect()
    assert {(r["task"], r["value"]) for r in long} == {("mmlu", 0.1), ("gsm8k", 0.2)}
    _write(f"{tmp}/empty/results.json", json.dumps({"results": {"mmlu": {}}}))
    with pytest.raises(Exception):
        FS.scan_result_files(spark, f"{tmp}/empty").collect()


def test_trainer_state(spark, tmp):
    state = {"log_history": [{"loss": 1.0, "step": 1}, {"eval_accuracy": 0.5, "eval_loss": 0.7},
                             {"loss": 0.5, "step": 2}, {"eval_accuracy": 0.8, "eval_f1": 0.6}],
             "epoch": 2.0, "global_step": 20, "best_metric": 0.8}
    _write(f"{tmp}/proj/checkpoint-20/trainer_state.json", json.dumps(state))
    r = FS.trainer_state_summary(spark, tmp, "proj").first()
    assert r["final_train_loss"] == 0.5 and r["eval_metrics"] == {"eval_accuracy": 0.8, "eval_f1": 0.6}
    assert r["global_step"] == 20


def test_calibration_files(spark, tmp):
    _write(f"{tmp}/c.txt", "a\n\n  b \nc\n")
    assert [r[0] for r in FS.read_calibration(spark, f"{tmp}/c.txt", 3).collect()] == ["a", "b"]
    _write(f"{tmp}/c.json", json.dumps(["s1", {"content": "s2"}, {"other": 1}, {"prompt": "s4"}]))
    assert [r[0] for r in FS.read_calibration(spark, f"{tmp}/c.json", 3).collect()] == ["s1", "s2"]


def test_catalog_lifecycle(spark, tmp):
    cat = CAT.KnowledgeBaseCatalog(spark, f"{tmp}/kb")
    assert cat.list().count() == 0
    cat.create("docs", "my docs", chunking_strategy="token")
    with pytest.raises(ValueError):
        cat.create("docs")
    cat.create("other")
    chunks = spark.createDataFrame([("docs", 1, 0, "1#0", "t"), ("docs", 1, 1, "1#1", "u"),
                                    ("other", 2, 0, "2#0", "v")],
                                   "kb_name string, doc_id bigint, chunk_ord int, chunk_id string, text string")
    cat.ingest(chunks)
    stats = {r["name"]: (r["document_count"], r["chunk_count"]) for r in cat.stats().collect()}
    assert stats == {"docs": (1, 2), "other": (1, 1)}
    assert cat.scan("docs").count() == 2
    assert cat.delete("docs") and not cat.delete("docs")
    assert [r["name"] for r in cat.list().collect()] == ["other"]
    assert cat.scan("docs").count() == 0


def test_sinks(spark, tmp):
    df = spark.createDataFrame([("t", "1")], "text string, label string")
    SK.write_training_csv(df, f"{tmp}/train")
    assert spark.read.option("header", True).csv(f"{tmp}/train").columns == ["text", "target"]
    q = spark.createDataFrame([("kb", 1, "b?"), ("kb", 0, "a?")], "kb_name string, question_id int, question string")
    SK.write_question_set(q, f"{tmp}/qs", generated_at="2024-01-01T00:00:00")
    doc = json.loads(spark.read.text(f"{tmp}/qs").first()[0])
    assert doc == {"kb_name": "kb", "questions": ["a?", "b?"], "ground_truths": None,
                   "metadata": {"generated_at": "2024-01-01T00:00:00", "num_questions": 2}}
    ev = spark.createDataFrame([("m", "1.5", "2024-01-01 00:00:00"), ("m", "abc", "2024-01-01 00:00:05"),
                                ("m", "2", "2024-01-01 00:00:09")], "n string, v string, ts string") \
        .withColumn("ts", F.to_timestamp("ts"))
    recs = SK.metric_records(ev, "n", "v", "ts").orderBy("step").collect()
    assert [(r["value"], r["step"]) for r in recs] == [(1.5, 0), (2.0, 9)]
    details = spark.createDataFrame([("q", ["c1", "c2"])], "question string, contexts array<string>")
    SK.write_evaluation(details, spark.createDataFrame([("# Report",)], "r string"),
                        spark.createDataFrame([("kb", 1)], "kb string, n int"), f"{tmp}/eval")
    assert spark.read.option("header", True).csv(f"{tmp}/eval/detailed_results").first()["contexts"] == '["c1","c2"]'


def test_parallelism_guard(spark):
    from sifter.plans.sizing import ensure_parallelism
    one = spark.range(100).coalesce(1)
    spread = ensure_parallelism(one, 4)
    assert spread.rdd.getNumPartitions() == 4 and spread.count() == 100
    many = spark.range(100).repartition(8)
    assert ensure_parallelism(many, 4) is many  # already parallel: unchanged, no shuffle added


def test_catalog_versions_names_and_counts(spark, tmp):
    root = f"{tmp}/kbv"
    cat = CAT.KnowledgeBaseCatalog(spark, root)
    odd = "a/b=c: 100%"
    cat.create(odd)
    cat.create("plain")
    schema = "kb_name string, doc_id bigint, chunk_ord int, chunk_id string, text string"
    cat.ingest(spark.createDataFrame([(odd, 1, 0, "1#0", "t"), (odd, 1, 1, "1#1", "u"), (odd, 2, 0, "2#0", "v"),
                                      ("plain", 3, 0, "3#0", "w")], schema))
    rows = {r["name"]: r for r in cat.list().collect()}
    assert rows[odd].document_count == 2 and rows["plain"].document_count == 1
    assert rows[odd].updated_at > rows[odd].created_at
    cat.ingest(spark.createDataFrame([("plain", 4, 0, "4#0", "w")], schema),
               spark.createDataFrame([("plain", 4), ("plain", 5)], "kb_name string, doc_id bigint"))
    again = {r["name"]: r for r in cat.list().collect()}
    assert again["plain"].document_count == 3 and again[odd].updated_at == rows[odd].updated_at
    assert cat.scan(odd).count() == 3
    # A version without its success marker is not seen; a second writer of the same version fails.
    version = cat._version()
    cat.list().limit(0).write.json(f"{root}/catalog/version={version + 1}")
    import os
    os.remove(f"{root}/catalog/version={version + 1}/_SUCCESS")
    assert {r["name"] for r in cat.list().collect()} == {odd, "plain"}
    with pytest.raises(Exception, match="already exists"):
        cat._commit(cat.list(), version)
    import shutil
    shutil.rmtree(f"{root}/catalog/version={version + 1}")
    assert cat.delete(odd) and cat.scan(odd).count() == 0 and cat.scan("plain").count() == 2
    assert [r["name"] for r in cat.list().collect()] == ["plain"]
