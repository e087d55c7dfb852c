"""SentencePiece encoding and decoding through a table of distinct chunks.

*Chunks.* The library turns blanks into the marker U+2581 and puts one in front of the text.
When no vocabulary piece has a marker behind another character, and no longer piece holds a
newline, pieces cannot reach across ``x|marker`` or around a newline. The text then falls into
chunks (a run of markers with the word behind it, a word at a line's start, a newline) that are
segmented independently: the ids of a text are those of its chunks, in order. These
conditions, and the normaliser's being the identity with a dummy prefix, are read from the model
file; for any other model a whole text is its only chunk.

*Table.* A task cuts a slice of texts into chunks, and the slice's distinct chunks that its
table does not hold yet are segmented, and decoded, in one call each. Ids and decoded strings
are joined back by position. The table belongs to the Python worker and starts anew at
``TABLE_LIMIT`` chunks, so its memory is bounded whatever the vocabulary of the corpus; chunks
over ``LONG_CHUNK`` characters are segmented but not kept. (A table over the whole corpus would be
shuffled to every slice and back to save a few thousand segmentations a task.)

A chunk is segmented behind a newline, which nothing merges with, so that the library's dummy
prefix stays outside it; decoding uses the same barrier.

Defined results: null text counts as empty; an empty text has no ids and decodes to empty;
a null ``doc_id`` stays null; repeated rows are coded each; an empty table gives an empty result;
a text that holds U+2581 decodes it as a blank, as the library does; very long texts are cut and
segmented ``CHUNKS_AT_ONCE`` chunks at a time, and only their ids and decoded text are held whole, in one
task. Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from sifter.llm.common import kept, slices, tidy

MARKER = "▁"
TABLE_LIMIT = 250_000
LONG_CHUNK = 64
CHUNKS_AT_ONCE = 200_000
SLICE_BYTES = 2 << 20
_CHUNK_RE = re.compile(f"[ {MARKER}]*[^ {MARKER}\n]+|[ {MARKER}]+|\n")


def separable(model: bytes) -> bool:
    """Whether pieces of this model stay within chunks."""
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model)
    norm = spec.normalizer_spec
    if (norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix
            or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix):
        return False
    ordinary = [p.piece for p in spec.pieces if p.type in (1, 4, 5)]  # normal, user-defined, unused
    return not any(MARKER in p.lstrip(MARKER) or ("\n" in p and len(p) > 1) for p in ordinary)


class ChunkTable:
    """Distinct chunk -> (little-endian 32-bit ids, decoded text)."""

    def __init__(self, model: bytes, limit: int = TABLE_LIMIT):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.limit, self.separable = limit, separable(model)
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}
        self.barrier = self.library.encode("\n") if self.separable else []

    def segment(self, chunks: list[str]) -> tuple[dict[str, bytes], dict[str, str]]:
        """Every chunk once, in one call of the library for each direction."""
        skip, lead = len(self.barrier), "\n" if self.separable else ""
        coded = self.library.encode([lead + c for c in chunks], num_threads=1)
        texts = self.library.decode(coded, num_threads=1)
        if any(ids[:skip] != self.barrier or not t.startswith(lead) for ids, t in zip(coded, texts)):
            raise ValueError("a piece reached across the barrier")
        return ({c: np.array(ids[skip:], "<i4").tobytes() for c, ids in zip(chunks, coded)},
                {c: t[len(lead):] for c, t in zip(chunks, texts)})

    def _join(self, chunks: list[str]) -> tuple[bytes, str]:
        unseen = set(chunks).difference(self.ids)
        if not unseen:
            ids, decoded = self.ids, self.decoded
        else:
            new_ids, new_decoded = self.segment(sorted(unseen))
            long = [c for c in unseen if len(c) > LONG_CHUNK]
            if len(self.ids) + len(unseen) > self.limit:
                keep = set(chunks)
                self.ids = {c: v for c, v in self.ids.items() if c in keep}
                self.decoded = {c: v for c, v in self.decoded.items() if c in keep}
            self.ids.update(new_ids)
            self.decoded.update(new_decoded)
            out = (b"".join(map(self.ids.__getitem__, chunks)),
                   "".join(map(self.decoded.__getitem__, chunks)))
            for c in long:
                del self.ids[c], self.decoded[c]
            return out
        return b"".join(map(ids.__getitem__, chunks)), "".join(map(decoded.__getitem__, chunks))

    def code(self, text: str) -> tuple[bytes, str]:
        """Ids and decoded text of a whole text."""
        if not text:
            return b"", ""
        if not self.separable:
            ids = self.library.encode(text)
            return np.array(ids, "<i4").tobytes(), self.library.decode(ids)
        text = " " + text  # the dummy prefix
        if len(text) <= CHUNKS_AT_ONCE:
            ids, decoded = self._join(_CHUNK_RE.findall(text))
            return ids, decoded[1:]
        parts, some = [], []
        for found in _CHUNK_RE.finditer(text):
            some.append(found.group())
            if len(some) == CHUNKS_AT_ONCE:
                parts.append(self._join(some))
                some = []
        parts.append(self._join(some))
        return b"".join(p[0] for p in parts), "".join(p[1] for p in parts)[1:]


def _coder(model):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(f"pieces {hash(model.value)}", lambda: ChunkTable(model.value))
        for batch in batches:
            for at, to in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(at, to - at)
                coded = [table.code(t or "") for t in part.column("text").to_pylist()]
                ends = np.cumsum([0] + [len(c[0]) // 4 for c in coded])
                ids = np.frombuffer(b"".join(c[0] for c in coded), "<i4")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ends), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                     pa.array([c[1] for c in coded], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])

    return tidy(code)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids ARRAY<INT>, decoded``: the library's ids of every text, without
    begin or end ids, and what its ``decode`` makes of them."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).alias("text")).mapInArrow(
        _coder(model), "doc_id bigint, n_tokens bigint, ids array<int>, decoded string")


def ids_digest(ids: str = "ids") -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")), 256)
