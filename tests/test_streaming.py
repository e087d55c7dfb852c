import os
import tempfile

from pyspark.sql import functions as F

from sifter.streaming import jobs as ST


def test_ingest_stream_restart_no_duplicates(spark):
    base = tempfile.mkdtemp(prefix="sifter-stream-")
    src, store, ck = f"{base}/in", f"{base}/store", f"{base}/ck"
    os.makedirs(src)
    with open(f"{src}/a.txt", "w") as f:
        f.write("one two three four")
    ST.ingest_stream(ST.file_documents_stream(spark, src, kb_name="kb"), store, ck).awaitTermination()
    assert spark.read.parquet(store).count() == 1
    with open(f"{src}/b.txt", "w") as f:
        f.write("five six")
    # Restart from the same checkpoint: only the new file is processed.
    ST.ingest_stream(ST.file_documents_stream(spark, src, kb_name="kb"), store, ck).awaitTermination()
    rows = spark.read.parquet(store).collect()
    assert sorted(r["text"] for r in rows) == ["five six", "one two three four"]
    ST.ingest_stream(ST.file_documents_stream(spark, src, kb_name="kb"), store, ck).awaitTermination()
    assert spark.read.parquet(store).count() == 2


def test_metric_stream(spark):
    base = tempfile.mkdtemp(prefix="sifter-metric-")
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", "loss", 1.0), (2, "2024-01-01 00:00:03", "loss", None)],
                               "event_id long, ts string, event_type string, value double") \
        .selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value")
    df.write.parquet(f"{base}/src")
    stream = ST.table_stream(spark, f"{base}/src", "*.parquet", df.schema)
    ST.metric_stream(stream, f"{base}/sink", f"{base}/ck", "2024-01-01 00:00:00").awaitTermination()
    assert [(r["name"], r["value"], r["step"]) for r in spark.read.parquet(f"{base}/sink").collect()] == [("loss", 1.0, 0)]


def _docs(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, "doc_id bigint, kb_name string, text string").coalesce(1).write.mode(mode).parquet(path)


def test_statistics_of_two_batches_equal_one_build(spark):
    from sifter.operators import retrieval as R
    base = tempfile.mkdtemp(prefix="sifter-stats-")
    schema = "doc_id bigint, kb_name string, text string"
    first = [(1, "a", "red fish red"), (2, "a", "blue"), (3, "b", "")]
    second = [(4, "a", "fish tree"), (5, "b", "tree tree bird"), (6, "c", "x")]

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        ST.statistics_stream(stream, f"{base}/parts", f"{base}/ck", group_col="kb_name").awaitTermination()

    def same(rows):
        index = R.build_index(spark.createDataFrame(rows, schema), group_col="kb_name")
        want, got = R.index_stats(index, group_col="kb_name"), ST.read_statistics(spark, f"{base}/parts", "kb_name")
        for a, b in ((want.vocab, got.vocab), (want.glob, got.glob)):
            rounded = [F.round(c, 12) if t == "double" else F.col(c) for c, t in sorted(a.dtypes)]
            assert sorted(map(tuple, a.select(rounded).collect())) == sorted(map(tuple, b.select(rounded).collect()))

    _docs(spark, f"{base}/in", first)
    run()
    same(first)
    _docs(spark, f"{base}/in", second)
    run()                       # restarted from the checkpoint: only the new file
    same(first + second)
    run()                       # nothing new
    same(first + second)
    # A batch that is run again replaces its part.
    from sifter.sources.fs import delete_path, list_folders
    last = max(int(f.split("=")[1]) for f in list_folders(spark, f"{base}/ck/commits")) if list_folders(
        spark, f"{base}/ck/commits") else 1
    for name in (f"{last}", f".{last}.crc"):
        delete_path(spark, f"{base}/ck/commits/{name}")
    run()
    same(first + second)
    assert ST.compact_statistics(spark, f"{base}/parts", "kb_name") == last
    assert list_folders(spark, f"{base}/parts/terms") == [f"base={last}"]
    same(first + second)
    _docs(spark, f"{base}/in", [(7, "a", "fish")])
    run()
    same(first + second + [(7, "a", "fish")])


def test_dedupe_state_is_bounded(spark):
    """Hashes leave the state once the watermark has passed them; copies within it are left out across restarts."""
    base = tempfile.mkdtemp(prefix="sifter-dedupe-")
    schema = "doc_id bigint, kb_name string, text string, at timestamp"
    state = []

    def run(rows):
        spark.createDataFrame(rows, "doc_id bigint, kb_name string, text string, at string").selectExpr(
            "doc_id", "kb_name", "text", "cast(at as timestamp) at").coalesce(1).write.mode("append").parquet(f"{base}/in")
        q = ST.ingest_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/store", f"{base}/ck",
                             dedupe=True, keep_for="1 hour", event_time="at")
        q.awaitTermination()
        state.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])

    run([(1, "kb", "same words", "2024-01-01 00:00:00"), (2, "kb", "same words", "2024-01-01 00:00:10"),
         (3, "other", "same words", "2024-01-01 00:00:20")])
    run([(4, "kb", "same words", "2024-01-01 00:10:00")] + [
        (100 + i, "kb", f"text {i}", "2024-01-01 00:30:00") for i in range(50)])
    run([(500, "kb", "new", "2024-01-02 00:00:00")])
    run([(501, "kb", "newer", "2024-01-02 00:00:01")])   # the watermark of the day before has passed
    got = {r.doc_id for r in spark.read.parquet(f"{base}/store").collect()}
    assert len(got & {1, 2}) == 1 and 3 in got and 4 not in got and {500, 501} <= got and len(got) == 54
    assert state[1] == 52 and state[-1] <= 2


def test_table_stream_reads_a_folder_of_part_files(spark):
    from sifter.plans.registry import QUERIES
    base = tempfile.mkdtemp(prefix="sifter-parts-")
    rows = [(i, f"word{i} and more", "en", f"src{i % 2}", 14) for i in range(8)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .repartition(3).write.parquet(f"{base}/documents.parquet")
    found = QUERIES["stream_ingest"](spark, base).collect()
    assert sorted((r["kb_name"], r["doc_id"]) for r in found) == sorted((r[3], r[0]) for r in rows)
    assert QUERIES["stream_corpus_stats"](spark, base).first()["n_docs"] == 8
