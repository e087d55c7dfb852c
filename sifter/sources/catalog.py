"""Knowledge-base catalog (A9), chunk store (A10, A11) and KB statistics.

The catalog is a small table with one row per knowledge base; the chunk store
is parquet partitioned by ``kb_name``, so a KB scan prunes partitions and a
KB delete drops its partition. Every change writes the whole (small) catalog as a new version; readers take the newest one
whose success marker stands, so a change is seen whole or not at all, and two writers of one version conflict instead of
mixing. Statistics are derived by aggregation from the store; the ``document_count`` of a catalog row is what its
ingests reported, as in the reference.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE
from sifter.sources.fs import delete_path, escape_name, list_folders, path_exists

# Knowledge-base configuration defaults.
DEFAULTS = {
    "embedding_model": "sentence-transformers/all-MiniLM-L6-v2",
    "chunk_size": CHUNK_SIZE,
    "chunk_overlap": CHUNK_OVERLAP,
    "chunking_strategy": "recursive",
    "vector_store": "chroma",
    "use_hybrid_search": False,
    "hybrid_alpha": 0.5,
    "use_reranking": False,
    "reranker_model": "cross-encoder/ms-marco-MiniLM-L-12-v2",
    "reranker_top_k": 20,
    "semantic_similarity_threshold": 0.8,
}

CATALOG_SCHEMA = (
    "name string, description string, embedding_model string, chunk_size int, "
    "chunk_overlap int, chunking_strategy string, vector_store string, created_at string, "
    "updated_at string, use_hybrid_search boolean, hybrid_alpha double, use_reranking boolean, "
    "reranker_model string, reranker_top_k int, semantic_similarity_threshold double, document_count bigint")
FIELDS = [f.split()[0] for f in CATALOG_SCHEMA.split(", ")]


def default_configs(names: DataFrame, **overrides) -> DataFrame:
    """Catalog rows with defaults for every KB name in ``names(kb_name)``."""
    vals = {**DEFAULTS, **overrides}
    typed = {"chunk_size": "int", "chunk_overlap": "int", "reranker_top_k": "int"}
    cols = [F.col("kb_name").alias("name"), F.lit("").alias("description")]
    for k in FIELDS[2:]:
        if k in ("created_at", "updated_at"):
            cols.append(F.lit("").alias(k))
        elif k == "document_count":
            cols.append(F.lit(0).cast("bigint").alias(k))
        else:
            v = F.lit(vals[k])
            cols.append((v.cast(typed[k]) if k in typed else v).alias(k))
    return names.select(*cols)


def kb_stats(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """Configuration fields + document_count + chunk_count per KB."""
    catalog = catalog.drop("document_count")
    counts = chunks.groupBy("kb_name").agg(
        F.countDistinct("doc_id").alias("document_count"), F.count(F.lit(1)).alias("chunk_count"))
    return catalog.join(counts, catalog["name"] == counts["kb_name"], "left").select(
        *[catalog[c] for c in catalog.columns],
        F.coalesce("document_count", F.lit(0)).cast("bigint").alias("document_count"),
        F.coalesce("chunk_count", F.lit(0)).cast("bigint").alias("chunk_count"))


def ingest_counts(docs: DataFrame, chunks: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """documents_processed, chunks_created and total_documents per KB
    (all three always present, also for an empty batch)."""
    d = docs.groupBy("kb_name").agg(F.count(F.lit(1)).alias("documents_processed"))
    c = chunks.groupBy("kb_name").agg(F.count(F.lit(1)).alias("chunks_created"))
    total_src = store if store is not None else chunks
    t = total_src.groupBy("kb_name").agg(F.countDistinct("doc_id").alias("total_documents"))
    return (d.join(c, "kb_name", "full").join(t, "kb_name", "full")
            .select("kb_name", *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in
                                 ["documents_processed", "chunks_created", "total_documents"]]))


class KnowledgeBaseCatalog:
    """Catalog table + chunk store under one root folder.

    Catalog operations touch a table with one row per knowledge base; they
    are tiny driver-side jobs. Chunk data only ever moves executor-side.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.catalog_path = f"{self.root}/catalog"
        self.store_path = f"{self.root}/chunks"

    def _now(self) -> str:
        return _dt.datetime.now(_dt.timezone.utc).isoformat()

    def _version(self) -> int:
        """The newest complete version; -1 without one."""
        found = [int(f.split("=")[1]) for f in list_folders(self.spark, self.catalog_path) if f.startswith("version=")
                 and path_exists(self.spark, f"{self.catalog_path}/{f}/_SUCCESS")]
        return max(found, default=-1)

    def _commit(self, rows: DataFrame, base: int) -> None:
        """Write ``rows`` as the version after ``base`` (an error if somebody else did) and drop versions before ``base``."""
        rows.select(*FIELDS).coalesce(1).write.mode("errorifexists").json(f"{self.catalog_path}/version={base + 1}")
        for f in list_folders(self.spark, self.catalog_path):
            if f.startswith("version=") and int(f.split("=")[1]) < base:
                delete_path(self.spark, f"{self.catalog_path}/{f}")

    def _read(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], CATALOG_SCHEMA)
        return (self.spark.read.schema(CATALOG_SCHEMA).option("mode", "DROPMALFORMED")
                .json(f"{self.catalog_path}/version={version}").where(F.col("name").isNotNull()))

    def list(self) -> DataFrame:
        """All catalog rows (an absent catalog is empty; malformed rows are skipped)."""
        return self._read(self._version())

    def get(self, name: str) -> DataFrame:
        return self.list().where(F.col("name") == name)

    def exists(self, name: str) -> bool:
        return self.get(name).limit(1).count() > 0

    def create(self, name: str, description: str = "", **config) -> DataFrame:
        base = self._version()
        rows = self._read(base)
        if rows.where(F.col("name") == name).count():
            raise ValueError(f"Knowledge base '{name}' already exists")
        now = self._now()
        row = {**DEFAULTS, **config, "name": name, "description": description,
               "created_at": now, "updated_at": now, "document_count": 0}
        df = self.spark.createDataFrame([tuple(row[f] for f in FIELDS)], CATALOG_SCHEMA)
        self._commit(rows.unionByName(df), base)
        return df

    def delete(self, name: str) -> bool:
        """Remove the KB row (a new version without it), then its chunk partition: a failure in between leaves chunks
        that no catalog row names."""
        base = self._version()
        rows = self._read(base)
        if not rows.where(F.col("name") == name).count():
            return False
        self._commit(rows.where(F.col("name") != name), base)
        delete_path(self.spark, f"{self.store_path}/kb_name={escape_name(self.spark, name)}")
        return True

    def ingest(self, chunks: DataFrame, documents: DataFrame | None = None) -> None:
        """A10: append chunks (partitioned by kb_name); re-ingest appends again. The catalog rows of the knowledge bases
        concerned get the time and the number of documents (of ``documents``, else those with a chunk)."""
        chunks.write.mode("append").partitionBy("kb_name").parquet(self.store_path)
        new = (documents if documents is not None else chunks.select("kb_name", "doc_id").distinct()).groupBy(
            "kb_name").agg(F.count(F.lit(1)).alias("_new")).withColumnRenamed("kb_name", "name")
        base = self._version()
        if base < 0:
            return
        rows = self._read(base).join(new, "name", "left")
        touched = F.col("_new").isNotNull()
        self._commit(rows.withColumn("document_count", F.coalesce("document_count", F.lit(0)) + F.coalesce("_new", F.lit(0)))
                     .withColumn("updated_at", F.when(touched, F.lit(self._now())).otherwise(F.col("updated_at"))), base)

    def scan(self, name: str) -> DataFrame:
        """Partition-pruned scan of one KB's chunks (text and metadata only)."""
        if not path_exists(self.spark, self.store_path):
            return self.spark.createDataFrame([], "kb_name string, doc_id bigint, chunk_id string, text string")
        return self.spark.read.parquet(self.store_path).where(F.col("kb_name") == name)

    def stats(self) -> DataFrame:
        """D11 over the stored chunks."""
        store = (self.spark.read.parquet(self.store_path) if path_exists(self.spark, self.store_path)
                 else self.spark.createDataFrame([], "kb_name string, doc_id bigint"))
        return kb_stats(self.list(), store)
