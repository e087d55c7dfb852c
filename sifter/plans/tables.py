"""Readers for the provided tables (declared schemas, column-pruned by Catalyst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.plans.sizing import ensure_parallelism

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


# Tables whose rows carry per-row work (text, vectors, logs).
_ROW_HEAVY = {"documents", "pages", "conversations", "events", "embeddings", "labels"}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as its files are dealt, for jobs that deal the rows themselves."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = scan(spark, sf_dir, name)
    return ensure_parallelism(df) if name in _ROW_HEAVY else df


def literal_names(spark: SparkSession, col: str, names: list[str]) -> DataFrame:
    """A request: names that a user types, as a table of one column."""
    return spark.createDataFrame([(n,) for n in names], f"{col} string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``benchmark`` table as a question set: ``question_id, question``."""
    return load(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"))
