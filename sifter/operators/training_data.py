"""Training-data preparation as table jobs.

The exact-size split (L8) avoids a single-task global ``row_number``: rows are
ordered by a seeded hash, cut into range buckets by the hash's high bits,
ranked inside each bucket (one window per bucket, uniform by construction)
and offset by the prefix sum of bucket sizes (a small table).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sifter.functions import formatting as fmt
from sifter.functions.text import strip_ws

SEED = 42
TEST_SIZE = 0.1
MAX_SEQ_LENGTH = 512
CALIBRATION_SAMPLES = 128
TEXT_FIELD = "text"
_HASH_BITS = 60  # 15 hex digits of md5
MIN_BUCKET_BITS = 8


def seeded_hash(id_col, seed: int = SEED) -> Column:
    """Deterministic 60-bit hash of (seed, id)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string"))),
                              1, 15), 16, 10).cast("bigint")


def python_round(x: float) -> int:
    """Round half to even, as the reference's sample size does."""
    return int(round(x))


def exact_split(df: DataFrame, id_col: str, test_size: float = TEST_SIZE, seed: int = SEED,
                rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Adds ``split`` = 'train' for exactly round(n*(1-test_size)) rows, else 'eval'.

    test_size <= 0 puts every row in train. Rows are chosen by smallest
    seeded hash (id breaks ties).
    """
    h = df.withColumn("_h", seeded_hash(id_col, seed))
    if test_size <= 0:
        return h.drop("_h").withColumn("split", F.lit("train"))
    n = df.count()
    k = python_round(n * (1 - test_size))
    # Always buckets, whatever the size: no task ranks more than one of them.
    bits = max(MIN_BUCKET_BITS, math.ceil(math.log2(max(1, n / rows_per_bucket))))
    h = h.withColumn("_b", F.shiftright("_h", _HASH_BITS - bits))
    sizes = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # At most 2^bits rows: the bucket table is bounded by construction.
    offsets = F.broadcast(sizes.select(
        "_b", (F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off")).fillna(0, ["_off"]))
    ranked = h.withColumn("_r", F.row_number().over(
        Window.partitionBy("_b").orderBy("_h", id_col)))
    return (ranked.join(offsets, "_b")
            .withColumn("split", F.when(F.col("_off") + F.col("_r") <= k, "train").otherwise("eval"))
            .drop("_h", "_b", "_r", "_off"))


def format_dataset(df: DataFrame, dataset_format: str, text_field: str = TEXT_FIELD) -> DataFrame:
    """One text column by dataset format (instruction / chat / completion /
    classification); any other format keeps the rows unchanged."""
    cols = set(df.columns)

    def col(name):
        return F.col(name) if name in cols else F.lit("")

    if dataset_format == "instruction":
        expr = fmt.instruction_text(col("instruction"), col("input"), col("output"))
    elif dataset_format == "chat":
        expr = fmt.chat_text(F.col("messages") if "messages" in cols
                             else F.array().cast(fmt.MESSAGE_TYPE))
    elif dataset_format == "completion":
        expr = fmt.completion_text(col("prompt"), col("completion"))
    elif dataset_format == "classification":
        expr = fmt.classification_text(col("text"), col("label"))
    else:
        return df
    return df.select(expr.alias(text_field))


def tokenize_fixed(df: DataFrame, text_col: str = TEXT_FIELD, max_length: int = MAX_SEQ_LENGTH,
                   tokenizer=fmt.hashed_token_ids, keep: list[str] | None = None) -> DataFrame:
    """L10 + H42 + B6: input_ids / attention_mask / labels of exactly max_length."""
    ids = df.select(*(keep or []), tokenizer(F.col(text_col)).alias("_ids"))
    out = ids.select(*(keep or []),
                     fmt.pad_truncate("_ids", max_length).alias("input_ids"),
                     fmt.attention_mask("_ids", max_length).alias("attention_mask"))
    return out.withColumn("labels", fmt.lm_labels("input_ids", "attention_mask"))


def calibration_sample(df: DataFrame, order_col: str, n: int = CALIBRATION_SAMPLES,
                       fields: tuple[str, ...] = ("text", "content", "instruction", "prompt"),
                       ) -> DataFrame:
    """First n rows by ``order_col`` *then* drop blank/unusable ones, so
    fewer than n may return (the limit is taken before the filter)."""
    present = [f for f in fields if f in df.columns]
    text = F.coalesce(*[F.col(f).cast("string") for f in present]) if present else F.lit(None)
    head = df.orderBy(order_col).limit(n)
    return (head.select(F.col(order_col), strip_ws(text).alias("text"))
            .where(F.col("text").isNotNull() & (F.col("text") != "")))


def validate_classification(df: DataFrame) -> DataFrame:
    """B1: one-row report ``ok, reason, rows`` for a text-classification table."""
    cols = set(df.columns)
    if "text" not in cols:
        reason = "CSV must have 'text' column"
    elif "target" not in cols and "label" not in cols:
        reason = "CSV must have 'target' or 'label' column"
    else:
        reason = None
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(reason is None).alias("ok"), F.lit(reason).cast("string").alias("reason"), "rows")


def to_training_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """B2: ``label`` -> ``target`` (text stays text)."""
    mapping = mapping or {"label": "target"}
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})
