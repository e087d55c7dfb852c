"""A training-data pipeline over ``documents``: each stage calls one operator.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written and read again as the next one's
``docs``. All but the last keep the columns of ``documents``.

Defined results: null texts go in the first stage, null languages and sources are ordinary values, rows without
an id stay apart from each other; ties and repeated rows go as each operator's docstring says; an
empty table gives an empty result; further columns travel with their rows, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm import language_id
from sifter.llm.best_fit import best_fit_pack
from sifter.llm.common import stored, table
from sifter.llm.exact_dedup import exact_dedup
from sifter.llm.minmax_dedup import near_dedup
from sifter.llm.mixing import mixed_documents
from sifter.llm.queries import TOKENIZER


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, and those without one word in the script of a learned
    language (score 0), go."""
    model = language_id.train(docs.filter(~language_id.held_out()))
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        language_id.language_of(F.col("text"), model, spark).alias("p"))
    return found.filter((F.col("p.lang") != language_id.UNKNOWN) & (F.col("p.score") > 0)).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the largest id stays."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the smallest id of every component stays. Five-word
    shingles and a similarity of 0.8 or more, as no contract fixes the stage's;
    30 bands of 4 miss a pair at 0.8 with probability 1e-7."""
    return near_dedup(docs, width=5, percent=80, bands=30, rows=4)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Source mixing, lossless: every document stays, those of small sources
    stand up to one and a half times on average."""
    return mixed_documents(docs, lossless=True, max_repeats=1.5)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of at most 4096 tokens."""
    return best_fit_pack(docs, TOKENIZER)


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage),
          ("near_dedup", near_stage), ("source_mixing", mixing_stage),
          ("best_fit_packing", packing_stage)]

# Trained models and tokenizers are not SQL; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
