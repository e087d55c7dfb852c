r"""Line dedup: lines that many documents share go, except in one document.

Every text is split at ``\n``; a line's key is the line without ``[\x20\x09-\x0D]``
at both ends, A-Z lower-cased. Lines explode to (document, position, 128-bit
hash of the key); documents are counted per hash, and a hash found in
``min_docs`` documents or more marks its lines everywhere but in the largest
document that holds it. The marks go back to their documents as positions and
the text is put together again by position. Keys under ``min_chars`` code points
are never dropped. One document's copies of a line are merged before
the count, and map tasks add up before the shuffle, so a line that a third of
all documents hold is one row per task; its marks are joined back through
Spark's skew-split join.

Defined results: null or empty text is one empty line; a null ``doc_id`` ranks
below every other id; repeated rows (same id and same text) are one document
and get the same result each; rows that share an id but not the text are
documents of their own, and count once per id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import BLANKS, ascii_lower, stored

MIN_CHARS = 40
MIN_DOCS = 5
NULL_ID = -(2 ** 63)


def _document_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"),
        F.xxhash64("text").alias("v"))


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Marks ``k, v, positions``: lines to drop, by document (id and text hash)."""
    lines = (_document_key(docs, id_col, text_col)
             .select("k", "v", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
             .filter(F.length("line") >= min_chars)
             .select("k", "v", "pos", ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("key"))
             .filter(F.length("key") >= min_chars)
             .select("k", "v", "pos", F.xxhash64("key").alias("h1"),
                     F.xxhash64(F.lit(7), "key").alias("h2")))
    lines = stored(lines, "lines")
    shared = (lines.groupBy("h1", "h2", "k").agg(F.lit(1).alias("one"))
              .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("home"))
              .filter(F.col("n") >= min_docs).select("h1", "h2", "home"))
    return (lines.join(shared, ["h1", "h2"]).filter(F.col("k") < F.col("home"))
            .groupBy("k", "v").agg(F.collect_set("pos").alias("positions")))


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, positions = b.column("text"), b.column("positions")
        cut = [None] * b.num_rows
        for r in np.flatnonzero(positions.is_valid().to_numpy(zero_copy_only=False)):
            drop = set(positions[r].as_py())
            cut[r] = "\n".join(x for i, x in enumerate(text[r].as_py().split("\n"))
                               if i not in drop)
        n = pc.fill_null(pc.list_value_length(positions), 0)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pc.coalesce(pa.array(cut, text.type), text),
             b.column("n_lines"), n.cast(pa.int64())],
            names=["doc_id", "kept_text", "n_lines", "n_dropped"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, kept_text, n_lines, n_dropped``, one row per input row. A text
    that loses all its lines keeps an empty string."""
    marks = shared_lines(docs, id_col, text_col, min_chars, min_docs)
    rows = _document_key(docs, id_col, text_col).select(
        "*", (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
        .cast("bigint").alias("n_lines"))
    return rows.join(marks, ["k", "v"], "left").select(
        "doc_id", "text", "n_lines", "positions").mapInArrow(
        _reassemble, "doc_id bigint, kept_text string, n_lines bigint, n_dropped bigint")
