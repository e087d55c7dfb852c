"""File-system helpers through Hadoop's FileSystem API (works for local
paths, HDFS and object stores alike; no machine-local assumptions)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def is_folder(spark: SparkSession, pattern: str) -> bool:
    """Whether a path, or any match of a pattern, is a folder."""
    fs, p = _fs(spark, pattern)
    return any(st.isDirectory() for st in fs.globStatus(p) or [])


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True)) if fs.exists(p) else False


def rename_path(spark: SparkSession, src: str, dst: str) -> bool:
    fs, s = _fs(spark, src)
    _, d = _fs(spark, dst)
    return bool(fs.rename(s, d))


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder (none when it is absent)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory())


def escape_name(spark: SparkSession, name: str) -> str:
    """A value as Spark writes it into a partition folder's name."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """(path, total length, newest modification time) of a file or folder."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return (path, -1, -1)
    total, newest = 0, 0
    it = fs.listFiles(p, True)
    while it.hasNext():
        st = it.next()
        total += st.getLen()
        newest = max(newest, st.getModificationTime())
    return (path, total, newest)
