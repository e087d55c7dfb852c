"""Structured Streaming jobs (M1, M2).

* M1 incremental ingest: new files (or rows) of a folder are chunked and
  appended to the chunk store partitioned by ``kb_name``. The checkpoint
  tracks processed files, so a restart never re-ingests a file (the
  reference's re-ingest duplicates). Optional de-duplication on a content
  hash keeps a chunk's hash only until the watermark has passed it by ``keep_for``, so its state is bounded.
* D10 statistics (document and token counts, document frequencies) can be kept up to date by the same stream: every
  micro-batch writes its own additive part, and reading sums the parts.
* M2 metric stream: event rows become ``(name, value, step)`` records and are
  appended to the metric table; stateless.

Both are plain ``readStream -> transform -> writeStream`` with declared
schemas and a checkpoint location; ``trigger(availableNow=True)`` runs them as
incremental batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sifter.operators import chunking as C
from sifter.operators import retrieval as R
from sifter.operators.results import numeric_value
from sifter.session import cut_lineage
from sifter.sources.fs import delete_path, is_folder, list_folders, path_exists

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_documents_stream(spark: SparkSession, folder: str, file_glob: str = "*.txt",
                          kb_name: str | None = None) -> DataFrame:
    """New text files of a folder as document rows (path as doc id, UTF-8 text)."""
    raw = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
           .option("pathGlobFilter", file_glob).option("recursiveFileLookup", "true").load(folder))
    return raw.select(F.lit(kb_name).cast("string").alias("kb_name"), F.col("path").alias("source_path"),
                      F.xxhash64("path").alias("doc_id"), F.col("content").cast("string").alias("text"))


def table_stream(spark: SparkSession, folder: str, table_file: str, schema) -> DataFrame:
    """Rows of a table inside ``folder`` as a stream: ``table_file`` names parquet files or, as Spark writes them,
    folders of part files."""
    reader = spark.readStream.schema(schema)
    path = f"{folder.rstrip('/')}/{table_file}"
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", table_file).parquet(folder)


def ingest_stream(docs: DataFrame, store_path: str, checkpoint: str, strategy: str = "token",
                  chunk_size: int = C.CHUNK_SIZE, chunk_overlap: int = C.CHUNK_OVERLAP,
                  dedupe: bool = False, available_now: bool = True, keep_for: str = "7 days",
                  event_time: str | None = None) -> StreamingQuery:
    """M1: chunk each micro-batch and append it to the partitioned store.

    With ``dedupe``, a chunk whose text was seen in its knowledge base within ``keep_for`` (of ``event_time``, a
    timestamp column of ``docs``; by default the time of arrival) is left out. Hashes older than that leave
    the state, so a later copy is ingested again.
    """
    kb = F.col("kb_name") if "kb_name" in docs.columns else None
    if not dedupe:
        chunks = C.chunk_documents(docs, strategy, chunk_size, chunk_overlap, kb_col=kb)
    else:
        when = F.col(event_time) if event_time else F.current_timestamp()
        timed = docs.withColumn("_when", when.cast("timestamp")).withWatermark("_when", keep_for)
        # Chunkers return their own columns: the time rides along in the metadata-free id.
        chunks = C.chunk_documents(timed.withColumn("doc_id", F.struct("doc_id", "_when")), strategy, chunk_size,
                                   chunk_overlap, kb_col=kb)
        chunks = (chunks.withColumn("_when", F.col("doc_id._when")).withColumn("doc_id", F.col("doc_id.doc_id"))
                  .withColumn("chunk_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_ord").cast("string")))
                  .withColumn("_h", F.sha2(F.concat_ws("\u0001", "kb_name", "text"), 256))
                  .dropDuplicatesWithinWatermark(["_h"]).drop("_h", "_when"))
    w = (chunks.writeStream.format("parquet").option("path", store_path)
         .option("checkpointLocation", checkpoint).partitionBy("kb_name").outputMode("append"))
    return (w.trigger(availableNow=True) if available_now else w).start()


def metric_stream(events: DataFrame, sink_path: str, checkpoint: str, start_ts: str,
                  name_col: str = "event_type", value_col: str = "value", ts_col: str = "ts",
                  available_now: bool = True) -> StreamingQuery:
    """M2: ``(name, value, step, ts)`` with step = whole seconds since ``start_ts``;
    non-numeric values are dropped."""
    rec = events.select(
        F.col(name_col).alias("name"), numeric_value(F.col(value_col).cast("string")).alias("value"),
        ((F.unix_micros(F.col(ts_col).cast("timestamp"))
          - F.unix_micros(F.lit(start_ts).cast("timestamp"))) / 1_000_000).cast("bigint").alias("step"),
        F.col(ts_col).alias("ts")).where(F.col("value").isNotNull())
    w = (rec.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return (w.trigger(availableNow=True) if available_now else w).start()


# ------------------------------------------------------------ D10 from deltas

_PARTS = {"terms": ["term"], "totals": []}


def statistics_stream(docs: DataFrame, path: str, checkpoint: str, group_col: str | None = None,
                      available_now: bool = True) -> StreamingQuery:
    """Keep a collection's statistics up to date: each micro-batch of documents (``[group,] doc_id, text``) writes its
    document count, token count and document frequencies under its own number. A batch that is run again after a
    failure overwrites its part, so nothing counts twice."""
    g = [group_col] if group_col else []

    def write(batch: DataFrame, number: int) -> None:
        index = R.build_index(batch, group_col=group_col).select(*g, "dl", "tf")
        terms = index.select(*g, F.explode(F.map_keys("tf")).alias("term")).groupBy(*g, "term").agg(
            F.count(F.lit(1)).alias("df"))
        totals = index.groupBy(*g).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("dl").cast("bigint")).alias("tokens"))
        for name, part in (("terms", terms), ("totals", totals)):
            part.write.mode("overwrite").parquet(f"{path}/{name}/delta={number}")

    w = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def _parts(spark: SparkSession, path: str, name: str) -> tuple[list[str], int]:
    """The newest complete base and the deltas behind it; the number of the last delta."""
    base, deltas = -1, []
    for folder in list_folders(spark, f"{path}/{name}"):
        kind, _, number = folder.partition("=")
        if kind == "base" and path_exists(spark, f"{path}/{name}/{folder}/_SUCCESS"):
            base = max(base, int(number))
        elif kind == "delta" and path_exists(spark, f"{path}/{name}/{folder}/_SUCCESS"):
            deltas.append(int(number))
    found = [f"{path}/{name}/base={base}"] if base >= 0 else []
    return found + [f"{path}/{name}/delta={n}" for n in sorted(deltas) if n > base], max([base, *deltas])


def _summed(spark: SparkSession, path: str, name: str, g: list[str]) -> DataFrame:
    found, _ = _parts(spark, path, name)
    if not found:
        raise ValueError(f"no statistics in {path}")
    sums = ["df"] if name == "terms" else ["n_docs", "tokens"]
    return spark.read.parquet(*found).groupBy(*g, *_PARTS[name]).agg(*[F.sum(c).alias(c) for c in sums])


def read_statistics(spark: SparkSession, path: str, group_col: str | None = None,
                    params: R.BM25Params = R.BM25Params()) -> R.IndexStats:
    """The statistics of everything ingested so far, as ``retrieval.index_stats`` would compute them from all
    documents."""
    g = [group_col] if group_col else []
    vocab = cut_lineage(_summed(spark, path, "terms", g))
    totals = _summed(spark, path, "totals", g).select(
        *g, "n_docs", (F.col("tokens").cast("double") / F.col("n_docs")).alias("avgdl"))
    return R.IndexStats(vocab, cut_lineage(R.with_floor(vocab, totals, params, group_col)))


def compact_statistics(spark: SparkSession, path: str, group_col: str | None = None) -> int:
    """Merge all parts into a new base (complete once its success marker stands) and delete what it holds; the number of
    the last batch in it. Not while the stream writes."""
    g, last = [group_col] if group_col else [], -1
    for name in _PARTS:
        found, last = _parts(spark, path, name)
        if len(found) > 1 or (found and "delta=" in found[0]):
            _summed(spark, path, name, g).write.mode("overwrite").parquet(f"{path}/{name}/base={last}")
            for old in found:
                delete_path(spark, old)
    return last
