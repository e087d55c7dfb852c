"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.session import materialize, scratch_path

# Fixed value: the white space that separates words, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
WORD_RE = "[^\\x20\\x09-\\x0D]+"
# Settings while an intermediate table is written.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
           "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder inside the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back (lineage cut that
    outlives lost executors). Its shuffle files go once the table stands, and
    Arrow batches are small: long texts are copied on both sides of a batch."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in WRITING}
    for key, value in WRITING.items():
        conf.set(key, value)
    try:
        return materialize(df, name, codec=None)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the JVM's fast path, the
    rest a character map (``lower`` would also touch accented capitals)."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, low))


_KEPT: dict = {}
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _TRIM = None


def kept(name: str, make):
    """An object that a Python worker keeps between tasks. It goes when another one is asked for, so a worker that
    has served several operators holds the last one's table alone."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def release() -> None:
    """Give unused memory of this worker back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidy(run):
    """An Arrow function that gives memory back at the end of its task: workers live on, and their sizes add up."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


BLOOM_BITS = 1 << 26


def prefiltered(rows: DataFrame, wanted: DataFrame, *keys: str, bits: int = BLOOM_BITS) -> DataFrame:
    """``rows`` whose ``keys`` may be among those of ``wanted``, for an exact join behind it (an inner one with
    distinct keys: the optimizer would push a semi join below this filter): rows
    that cannot match are not shuffled. The filter has one bit a key in a table of ``bits`` / 64 words, which
    is broadcast: its size is fixed, whatever ``wanted`` holds (with many more keys than bits it merely keeps more)."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(bits))
    words = wanted.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_set"))
    marked = rows.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(words), "_word")
    held = F.expr("shiftrightunsigned(_set, cast(_bit & 63 as int)) & 1") == 1
    return marked.filter(held).select(*rows.columns)


class WordHashes(dict):
    """Word (bytes) -> 64-bit xxhash as a signed integer, kept for words seen
    before. At ``limit`` words it starts anew, so a worker's memory is bounded."""

    def __init__(self, limit: int = 400_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        h -= (h >> 63) << 64
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(text: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most_bytes`` of text each (one row at least), so
    that a task's working memory does not follow the batch size."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False),
                     dtype=np.int64)
    at, before = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield at, to
        at, before = to, ends[to - 1]
