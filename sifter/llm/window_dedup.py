"""Substring dedup over fixed-length word windows.

Every window of ``width`` consecutive words gets a Rabin-Karp hash (a polynomial
over 64-bit word hashes, from one running sum per document). A window whose
words also start in a document with a smaller id is repeated; all words
under repeated windows go, and touching windows merge into maximal intervals.

Counting in Spark without a shuffled row per window:

1. A task takes its documents in chunks of about ``CHUNK`` windows and sorts a
   chunk's hashes. Of the documents in the chunk that hold a window, all but
   the smallest id are repeated whatever other chunks hold: settled at once. Only
   the smallest document's window goes on, so a passage that a third of
   all documents share is one entry per chunk, not one per document.
2. Entries travel as packed columns (hash bytes by significance, document, position), one
   row per chunk and hash range. The task that owns a range sorts its hashes,
   finds the smallest document of each, and returns the windows of the others.
3. The windows found, and the first ones they were found with, are counted once more, by the other polynomial (the
   first one is the check now). Only what both rounds find is repeated.
4. Repeated positions go back to their documents; a running count of open
   windows turns them into maximal intervals.

In each round two windows are the same when a 64-bit polynomial over independent word hashes and an 8-bit check of the other
polynomial agree. A window is removed wrongly only if it collides in both rounds: 144 bits in all.

Defined results: null text has no words; texts shorter than ``width`` have no
window and stay; a null ``doc_id`` ranks below every other id; repeated
rows (same id, same text) are the same document and get the same result each,
rows that share an id never remove each other's windows; an empty table gives an
empty result; very long texts are hashed in one pass and counted chunk by chunk. Only the id and text columns are
read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import WordHashes, mix64, prefiltered, stored

WIDTH = 50
CHUNK = 400_000       # windows a task sorts at once
PER_RANGE = 600_000     # windows a hash range should hold
CHARS_PER_WORD = 6      # only sizes the ranges
RANGES_A_TASK = 4
BASE, CHECK_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
NULL_ID = -(2 ** 63)

_WORKER: dict[str, WordHashes] = {}  # kept by a Python worker between tasks


def _word_hashes(again: bool) -> WordHashes:
    """Hashes of a round's own seed; a worker keeps one round's."""
    name = f"words{again:d}"
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = WordHashes(seed=int(again))
    return _WORKER[name]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2 ** 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_POWERS = (_Powers(BASE), _Powers(CHECK_BASE))


def rolling_hashes(words: np.ndarray, width: int, powers: _Powers) -> np.ndarray:
    """Polynomial hash of every window, mixed: sum of word[i+j] * inverse**j."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers.grow(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64),
                           np.cumsum(words * powers.down[:len(words)], dtype=np.uint64)])
    return mix64((sums[width:] - sums[:-width]) * powers.up[:n])


def _planes(values: np.ndarray, n_bytes: int) -> bytes:
    """Bytes of the values, most significant of all first: sorted values leave
    long runs that compress away in the shuffle."""
    raw = values.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(len(values), -1)
    return np.ascontiguousarray(raw[:, -n_bytes:].T).tobytes()


def _unplanes(raw: bytes, n: int, n_bytes: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, 8 - n_bytes:] = np.frombuffer(raw, np.uint8).reshape(n_bytes, n).T
    return out.view(">u8").reshape(n).astype(np.uint64)


PACKED = ("range_id bigint, n bigint, hashes binary, checks binary, owners binary, "
          "positions binary, docs binary, settled boolean, first boolean")
_SCHEMA = pa.schema([("range_id", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()),
                     ("checks", pa.binary()), ("owners", pa.binary()),
                     ("positions", pa.binary()), ("docs", pa.binary()), ("settled", pa.bool_()),
                     ("first", pa.bool_())])


def _smallest(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal (hash, check) together and, in that order, whether a smaller doc holds the
    window (gone), and whether it is the smallest doc's of one that others hold (lead)."""
    order = np.argsort(h)
    hs, cs = h[order], c[order]
    same = hs[1:] == hs[:-1]
    if (same & (cs[1:] != cs[:-1])).any():  # one hash, two checks: sort by both
        order = np.lexsort((c, h))
        hs, cs = h[order], c[order]
        same = (hs[1:] == hs[:-1]) & (cs[1:] == cs[:-1])
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    sizes = np.diff(np.append(starts, len(h)))
    gone = doc[order] > np.repeat(np.minimum.reduceat(doc[order], starts), sizes)
    return order, gone, ~gone & np.repeat(np.logical_or.reduceat(gone, starts), sizes)


def _hashed(width: int, ranges: int, again: bool, hash_bits: int = 64):
    """Windows of documents -> packed rows. ``again``: the second round, over the given starts, with the polynomials'
    parts exchanged. Fewer ``hash_bits`` make collisions, for tests."""
    def emit(docs, h, c, owner, position) -> Iterator[pa.RecordBatch]:
        """One chunk: settled windows, then a packed row per range."""
        ids = np.array([d for d, _ in docs], np.int64)
        order, gone, lead = _smallest(h, c, ids[owner])
        owner, position, h, c = owner[order], position[order], h[order], c[order]
        table = np.array(docs, np.int64).reshape(-1, 2)
        cut = (h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        bounds = np.searchsorted(cut, np.arange(ranges + 1, dtype=np.uint64))
        rows, step = [], CHUNK // 8
        for first, some in ((False, gone), (True, lead)):
            rows += [_row(int(i) % ranges, True, table, owner[some][lo:lo + step], position[some][lo:lo + step],
                          None, None, first) for i, lo in enumerate(range(0, int(some.sum()), step))]
        for r in range(ranges):
            lo, hi = bounds[r], bounds[r + 1]
            on = ~gone[lo:hi]
            if on.any():
                rows.append(_row(r, False, table, owner[lo:hi][on], position[lo:hi][on],
                                 h[lo:hi][on], c[lo:hi][on]))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_hashes(again)
        docs, parts, size = [], [], 0
        for b in batches:
            picked = b.column("starts") if again else [None] * b.num_rows
            for k, v, text, starts in zip(b.column("k").to_pylist(), b.column("v").to_pylist(),
                                          b.column("text").cast(pa.binary()), picked):
                w = words.of((text.as_py() or b"").split())
                h = rolling_hashes(w, width, _POWERS[again])
                c = (rolling_hashes(w, width, _POWERS[not again]) >> np.uint64(56)).astype(np.uint8)
                if hash_bits < 64:
                    h, c = h >> np.uint64(64 - hash_bits) << np.uint64(64 - hash_bits), c * 0
                place = np.arange(len(h), dtype=np.int32)
                if starts is not None:
                    at = starts.values.to_numpy(zero_copy_only=False)
                    place = np.unique(np.where(at < 0, -1 - at, at)).astype(np.int32)
                    h, c = h[place], c[place]
                for at in range(0, len(h), CHUNK):
                    docs.append((k, v))
                    n = len(h[at:at + CHUNK])
                    parts.append((h[at:at + CHUNK], c[at:at + CHUNK],
                                  np.full(n, len(docs) - 1, np.int32), place[at:at + CHUNK]))
                    size += n
                    if size >= CHUNK:
                        yield from emit(docs, *map(np.concatenate, zip(*parts)))
                        docs, parts, size = [], [], 0
        if size:
            yield from emit(docs, *map(np.concatenate, zip(*parts)))

    return run


def _row(range_id, settled, table, owner, position, h, c, first=False) -> dict:
    """A packed row; documents are numbered anew, in order of first use. ``first``: leads, not repeated windows."""
    used, owner = np.unique(owner, return_inverse=True)
    wide = 2 if len(used) <= 2 ** 16 else 4
    return {"range_id": range_id, "n": len(owner), "settled": settled, "first": first,
            "hashes": None if h is None else _planes(h, 8),
            "checks": None if c is None else c.tobytes(),
            "owners": bytes([wide]) + _planes(owner.astype(np.uint64), wide),
            "positions": _position_bytes(position), "docs": table[used].tobytes()}


def _position_bytes(position: np.ndarray) -> bytes:
    wide = max(1, (int(position.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + _planes(position.astype(np.uint64), wide)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return _unplanes(raw[1:], n, raw[0]).astype(np.int64)


def _packed(k: np.ndarray, v: np.ndarray, position: np.ndarray) -> pa.RecordBatch:
    """Window starts as one row of three lists; -1 - start for a lead."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), pa.array(x))
             for x in (k, v, position.astype(np.int32))]
    return pa.RecordBatch.from_arrays(lists, names=["k", "v", "start"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range after another (sorted): the repeated windows of each."""
    def judged(rows):
        owners, docs, base = [], [], 0
        for r in rows:
            table = np.frombuffer(r["docs"], np.int64).reshape(-1, 2)
            owners.append(_unpack(r["owners"], r["n"]) + base)
            docs.append(table)
            base += len(table)
        table, owner = np.concatenate(docs), np.concatenate(owners)
        position = np.concatenate([_unpack(r["positions"], r["n"]) for r in rows])
        h = np.concatenate([_unplanes(r["hashes"], r["n"], 8) for r in rows])
        c = np.concatenate([np.frombuffer(r["checks"], np.uint8) for r in rows])
        order, gone, lead = _smallest(h, c, table[owner, 0])
        start = np.where(gone, position[order], -1 - position[order])
        some = gone | lead
        kept = order[some]
        return table[owner[kept], 0], table[owner[kept], 1], start[some]

    pending, now = [], None
    for b in batches:
        for i in range(b.num_rows):
            r = {name: b.column(name)[i].as_py() for name in b.schema.names}
            if r["settled"]:
                table = np.frombuffer(r["docs"], np.int64).reshape(-1, 2)
                owner, start = _unpack(r["owners"], r["n"]), _unpack(r["positions"], r["n"])
                yield _packed(table[owner, 0], table[owner, 1], -1 - start if r["first"] else start)
                continue
            if pending and r["range_id"] != now:
                k, v, position = judged(pending)
                pending = []
                if len(k):
                    yield _packed(k, v, position)
            now = r["range_id"]
            pending.append(r)
    if pending:
        k, v, position = judged(pending)
        if len(k):
            yield _packed(k, v, position)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"),
        F.xxhash64("text").alias("v"))


def _found(rows: DataFrame, windows: int, width: int, per_range: int, again: bool, hash_bits: int = 64) -> DataFrame:
    """One round: ``k, v, starts`` of the documents with repeated windows or leads (-1 - start)."""
    ranges = max(1, min(2 ** 31, -(-windows // per_range)))
    packed = rows.mapInArrow(_hashed(width, int(ranges), again, hash_bits), PACKED)
    # A few ranges a task, however many there are.
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(-(-ranges // RANGES_A_TASK)))
    found = (packed.repartition(tasks, "range_id").sortWithinPartitions("range_id")
             .mapInArrow(_judge, "k array<bigint>, v array<bigint>, start array<int>"))
    return stored(stored(found, "windows").select(F.inline(F.arrays_zip("k", "v", "start")))
                  .groupBy("k", "v").agg(F.collect_set("start").alias("starts")), "marks")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     width: int = WIDTH, per_range: int = PER_RANGE, hash_bits: int = 64) -> DataFrame:
    """``k, v, starts``: word positions at which a repeated window starts, one
    row per document (id and text hash) that has any."""
    rows = _rows(docs, id_col, text_col).select("k", "v", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    once = _found(rows, -(-size // CHARS_PER_WORD), width, per_range, False, hash_bits)
    left = once.agg(F.sum(F.size("starts"))).first()[0] or 0
    some = prefiltered(rows, once.select("k", "v"), "k", "v").join(once, ["k", "v"])
    twice = _found(some, left, width, per_range, True)
    both = once.join(twice.withColumnRenamed("starts", "others"), ["k", "v"]).select(
        "k", "v", F.array_intersect(F.filter("starts", lambda x: x >= 0), "others").alias("starts"))
    return both.filter(F.size("starts") > 0)


def _remove(width: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, total, gone = [], [], []
            for text, starts in zip(b.column("text").cast(pa.binary()), b.column("starts")):
                words = text.as_py().split()
                total.append(len(words))
                if starts.is_valid:
                    at = starts.values.to_numpy(zero_copy_only=False)  # each start once
                    edge = np.zeros(len(words) + 1, np.int64)
                    edge[at] += 1
                    edge[at + width] -= 1
                    under = np.cumsum(edge[:-1]) > 0
                    gone.append(int(under.sum()))
                    words = [w for w, u in zip(words, under) if not u]
                else:
                    gone.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"])

    return remove


def window_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = WIDTH, per_range: int = PER_RANGE) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` (kept words joined by one blank),
    one row per input row."""
    if width < 1:
        raise ValueError("width must be at least 1")
    marks = repeated_windows(docs, id_col, text_col, width, per_range)
    return (_rows(docs, id_col, text_col).join(marks, ["k", "v"], "left")
            .select("doc_id", "text", "starts")
            .mapInArrow(_remove(width), "doc_id bigint, n_words bigint, n_removed bigint, "
                                        "kept_text string"))
