"""Session helpers: a local session for tests/bench and cluster-safe checkpointing."""

from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "sifter") -> SparkSession:
    """Local session used by tests and bench.py; production jobs pass their own session."""
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="sifter-warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder comes from the session configuration and is used
    as is (unset is an error there). Only in local mode, when it is unset
    (tests), a scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):  # one JVM; local-cluster has executors of its own
            # A machine-local folder would not survive executor loss.
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store)")
        conf_dir = tempfile.mkdtemp(prefix="sifter-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss; never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Stored tables are packed tighter than by default, and the shuffle files of their making go once they stand.
CODEC = "zstd"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is written inside are deleted when it is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str, codec: str | None = CODEC) -> DataFrame:
    """Write ``df`` as a parquet table in the shared checkpoint folder and read
    it back: cuts lineage like ``checkpoint()`` but keeps columnar storage, so
    later scans prune columns (an index read for vectors skips the tf maps).
    Without a ``codec`` the session's own is used."""
    import uuid
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    with shuffles_dropped(df.sparkSession):
        (df.write.option("compression", codec) if codec else df.write).mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._sifter_path = path  # type: ignore[attr-defined]
    return out


def discard(*tables: DataFrame) -> None:
    """Delete intermediate tables written by :func:`materialize` or :func:`materialize_clustered` once nothing
    reads them any more: all that was derived from them has to be stored itself."""
    for table in tables:
        name = getattr(table, "_sifter_table", None)
        if name:
            table.sparkSession.sql(f"DROP TABLE IF EXISTS `{name}`")
        path = getattr(table, "_sifter_path", None)
        if path:
            jvm, spark = table.sparkSession._jvm, table.sparkSession
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


def materialize_bucketed(df: DataFrame, name: str, key: str = "doc_id",
                         buckets: int | None = None) -> DataFrame:
    """Write ``df`` as an external parquet table bucketed by ``key`` in the
    shared checkpoint folder and read it back through the catalog.

    Spark then knows the table is hash-partitioned by ``key``: later
    aggregations and joins on ``key`` (postings -> per-document scores, index
    joins) run without an exchange. Writing needs no shuffle: each task writes
    its rows into the bucket files. ``buckets`` defaults to the session's
    shuffle partitions.
    """
    import uuid
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
    with shuffles_dropped(spark):
        df.write.bucketBy(n, key).option("compression", CODEC).option("path", scratch_path(spark, table)).saveAsTable(table)
    return spark.table(table)


def materialize_clustered(df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` as an external table bucketed and sorted by ``keys``, one file a bucket: the rows are
    dealt to the buckets by one exchange first, so tasks do not write a file for every bucket each."""
    import uuid
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
    path = scratch_path(spark, table)
    with shuffles_dropped(spark):
        df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("compression", CODEC).option(
            "path", path).saveAsTable(table)
    out = spark.table(table)
    out._sifter_path, out._sifter_table = path, table  # type: ignore[attr-defined]
    return out
