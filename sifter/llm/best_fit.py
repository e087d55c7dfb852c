"""Best-fit packing of tokenised documents into fixed-length sequences.

*Pieces.* Every document becomes token ids plus an end id; only documents longer
than ``capacity`` are cut, into full pieces and a rest. A word (a run between
ASCII white space) has the same ids wherever it stands, so a worker keeps the
ids of words it has seen, up to a fixed number, in two generations: a full one becomes the older one, and a word met
there moves to the younger, so frequent words stay however many rare ones pass. Unseen words go through the
tokenizers library.

*Packing.* Pieces spread by hash over shards of about ``per_shard`` pieces, so
no task grows with the input. A shard is a stream in order of arrival (id, piece) for
bounded-space online best-fit: at most ``open_bins`` sequences are open, in a bitset keyed by
their free space; one shift and one lowest-bit look-up find the tightest that fits,
and when a new one would be one too many, the fullest closes for good. (Sorting by length first would pack
a little tighter, but only with thousands of open sequences; see the README for counts.)

Defined results: null or empty text is the end id alone; repeated rows are packed
each; a null ``doc_id`` is packed like any other row; equal ids arrive in order of their pieces' content;
an empty table gives an empty result; the ids of one text are made in one task (4 bytes each), then cut. Only the
id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from sifter.llm.common import kept, stored, tidy

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 64
PER_SHARD = 20_000
CACHED_WORDS = 300_000     # of each generation

# Words of printable ASCII and accented Latin letters need no Unicode
# normalisation; they split by the tokenizer file's own pattern.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class _Kept(dict):
    """Key -> its ids (bytes): at most ``limit`` in the dict itself and as many in the generation before."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def made(self, key) -> bytes:
        raise NotImplementedError

    def __missing__(self, key) -> bytes:
        out = self.older.get(key)
        if out is None:
            out = self.made(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


class _Parts(_Kept):
    """Part of a word -> its ids (bytes), by the tokenizer's BPE model."""

    def __init__(self, tokenizer: Tokenizer, limit: int):
        super().__init__(limit)
        self.model = tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        chars = [chr(c) for c in range(0x21, 0x100) if _PLAIN.fullmatch(chr(c))]
        self.bytes_as_chars = {ord(c): level.pre_tokenize_str(c)[0][0] for c in chars}

    def made(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part.translate(self.bytes_as_chars))]
        return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(_Kept):
    """Word (bytes, no ASCII white space) -> little-endian 32-bit ids (bytes)."""

    def __init__(self, definition: str, limit: int = CACHED_WORDS):
        super().__init__(limit)
        self.tokenizer = Tokenizer.from_str(definition)
        self.parts = _Parts(self.tokenizer, limit)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")

    def made(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN.fullmatch(text) and not self.special.search(text):
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def _cutter(definition, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(f"ids {hash(definition.value)}", lambda: WordIds(definition.value))
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(),
                                 b.column("text").cast(pa.binary())):
                ids = words.of(text.as_py() or b"") + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part),
                                part if with_ids else None))
                if len(out) >= 5_000:
                    yield _pieces(out, with_ids)
                    out = []
            if out:
                yield _pieces(out, with_ids)

    return tidy(cut)


def _pieces(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc, piece, start, length, crc, ids = zip(*rows)
    cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
            pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
    return pa.RecordBatch.from_arrays(cols, names=names)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``
    (little-endian unsigned 32-bit)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).alias("text")).mapInArrow(
        _cutter(definition, capacity, end_id, with_ids), schema + ", ids binary" * with_ids)


class OpenBins:
    """Open sequences by free space: a bitset of the sizes, a stack for each."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.count, self.opened = 0, 0, 0
        self.stacks: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        number = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        fitting = self.bits >> length
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + length
            number = self._take(free)
        else:
            free, number = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.stacks.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.count += 1
            if self.count > self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - free


def _packer(capacity: int, open_bins: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, None
        for b in batches:
            sequence, offset = [], []
            for shard, length in zip(b.column("shard").to_pylist(), b.column("length").to_pylist()):
                if shard != now:
                    now, bins = shard, OpenBins(capacity, open_bins)
                number, at = bins.place(length)
                sequence.append((shard << 32) + number)
                offset.append(at)
            rest = b.drop_columns(["shard"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*rest.schema.names, "sequence_id", "offset"])

    return tidy(pack)


def pack(found: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         per_shard: int = PER_SHARD) -> DataFrame:
    """Adds ``sequence_id, offset`` to pieces (``doc_id, piece, length, ids_crc32``
    and any others). ``found`` should be a stored table: it is read twice."""
    shards = max(1, -(-found.count() // per_shard))
    tasks = max(shards, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards))
    return (found.withColumn("shard", key).repartition(tasks, "shard")
            .sortWithinPartitions("shard", "doc_id", "piece", "ids_crc32")
            .mapInArrow(_packer(capacity, open_bins),
                        schema + ", sequence_id bigint, offset bigint"))


def best_fit_pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                  text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
                  per_shard: int = PER_SHARD, end_id: int = END_ID,
                  with_ids: bool = False) -> DataFrame:
    """One row per piece: where its ids come from and where they stand."""
    found = stored(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids),
                   "pieces")
    return pack(found, capacity, open_bins, per_shard)
