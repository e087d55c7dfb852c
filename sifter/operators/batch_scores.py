"""Scores of Arrow batches of index rows against a checked question side.

Spark deals the index to tasks, merges the tasks' ranked lists (a window over at most k rows per question and task) and
their ranges; inside a task a batch of documents meets all questions (of its group) at once: cosines are one matrix
product, BM25 sums the postings that hold a question term. Rows that are ranked below the task's own k-th are not
returned, by the same rounding and the same ties as :func:`sifter.operators.retrieval.top_k`.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_type

from sifter.functions.text import tokenize

# Tasks get these functions by value: executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 1024              # documents of one step
CELLS = 2_000_000        # (document, question) pairs of one step
DIGITS = 6               # places a score is ranked at


@dataclass
class Asked:
    """The questions of one group: ids, sparse vectors (row, dimension, weight), terms by their question and weight."""
    ids: pa.Array
    rows: np.ndarray
    dims: np.ndarray
    weights: np.ndarray
    norms: np.ndarray
    terms: pa.Array | None = None
    codes: np.ndarray | None = None       # of the terms, ascending
    coded: np.ndarray | None = None       # the term of every code
    starts: np.ndarray | None = None
    askers: np.ndarray | None = None
    gains: np.ndarray | None = None
    avgdl: float | None = None
    ranges: np.ndarray | None = None      # bm25_min, bm25_max, semantic_min, semantic_max by question

    def part(self, first: int, last: int) -> "Asked":
        """Some of the questions, with all terms."""
        mine = (self.rows >= first) & (self.rows < last)
        out = Asked(self.ids.slice(first, last - first), self.rows[mine] - first, self.dims[mine], self.weights[mine],
                    self.norms[first:last], ranges=None if self.ranges is None else self.ranges[:, first:last])
        if self.terms is not None:
            held = (self.askers >= first) & (self.askers < last)
            out.terms, out.codes, out.coded, out.avgdl = self.terms, self.codes, self.coded, self.avgdl
            out.starts = np.concatenate([[0], np.cumsum(held)])[self.starts]
            out.askers, out.gains = self.askers[held] - first, self.gains[held]
        return out


def _lists(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and values of a list column's entries (a null list has none)."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return np.repeat(np.arange(len(col)), sizes), pc.list_flatten(col)


def _floats(col: pa.Array) -> np.ndarray:
    return np.asarray(col.to_numpy(zero_copy_only=False), dtype=np.float64)


def group_rows(batch: pa.RecordBatch, group: str | None) -> list[tuple]:
    """The rows of a batch by group."""
    if not group:
        return [(None, batch)]
    coded = batch.column(group).dictionary_encode()
    codes = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)
    return [(coded.dictionary[int(c)].as_py() if c < len(coded.dictionary) else None,
             batch.take(pa.array(np.nonzero(codes == c)[0]))) for c in np.unique(codes)]


def _group_values(col: pa.Array | None, n: int) -> list:
    return [None] * n if col is None else col.to_pylist()


def asked_by_group(side: pa.Table, group: str | None, ranges: pa.Table | None = None) -> dict:
    """The collected question side as one :class:`Asked` a group."""
    side = side.combine_chunks()
    col = lambda t, c: (pa.concat_arrays(t[c].chunks) if t[c].num_chunks != 1 else t[c].chunk(0))
    if side.num_rows == 0:
        return {}
    found: dict = {}
    groups = np.array([repr(g) for g in _group_values(col(side, group) if group else None, side.num_rows)], dtype=object)
    names = dict(zip(groups, _group_values(col(side, group) if group else None, side.num_rows)))
    for name in names:
        mine = side.take(pa.array(np.nonzero(groups == name)[0]))
        ids = col(mine, "query_id")
        rows, entries = _lists(col(mine, "qvec"))
        asked = Asked(ids, rows, np.asarray(entries.field("i"), dtype=np.int64), _floats(entries.field("w")),
                      _floats(col(mine, "qnorm")))
        if "qterms" in mine.column_names:
            who, terms = _lists(col(mine, "qterms"))
            coded = terms.field("term").dictionary_encode()
            order = np.argsort(coded.indices.to_numpy(), kind="stable")
            asked.terms = coded.dictionary
            codes = term_codes(asked.terms)
            asked.coded = np.argsort(codes, kind="stable")
            asked.codes = codes[asked.coded]
            asked.starts = np.searchsorted(coded.indices.to_numpy()[order], np.arange(len(coded.dictionary) + 1))
            asked.askers, asked.gains = who[order], _floats(terms.field("w"))[order]
            asked.avgdl = col(mine, "avgdl")[0].as_py()
        found[names[name]] = asked
    if ranges is not None:
        for name, asked in found.items():
            places = {q: i for i, q in enumerate(asked.ids.to_pylist())}
            asked.ranges = np.full((4, len(places)), np.nan)
            rows = zip(_group_values(ranges[group] if group else None, ranges.num_rows), ranges["query_id"].to_pylist(),
                       *[ranges[c].to_pylist() for c in RANGES])
            for g, q, *ends in rows:
                if g == name:
                    asked.ranges[:, places[q]] = [np.nan if e is None else e for e in ends]
    return found


def by_question(plans: dict, rows: pa.Table, group: str | None):
    """``plan, places of its questions, rows`` of every group."""
    names = rows.column(group).to_pylist() if group else [None] * rows.num_rows
    asked = rows.column("query_id").to_pylist()
    held: dict = {}
    for i, name in enumerate(names):
        held.setdefault(name, []).append(i)
    for name, mine in held.items():
        plan = plans.get(name)
        if plan is not None:
            places = {q: i for i, q in enumerate(plan.asked.ids.to_pylist())}
            yield plan, np.array([places[asked[i]] for i in mine], dtype=np.int64), rows.take(pa.array(mine))


RANGES = ["bm25_min", "bm25_max", "semantic_min", "semantic_max"]


def _dense(vec: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix (short rows end in zeros), and the rows' lengths."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = _floats(pc.list_flatten(vec))
    dense = np.zeros((len(vec), int(sizes.max()) if len(vec) else 0))
    dense[np.repeat(np.arange(len(vec)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return dense, sizes


def cosines(asked: Asked, vec: pa.Array, vnorm: pa.Array) -> np.ndarray:
    """Documents x questions; NaN where a document has no vector."""
    n, n_q = len(vec), len(asked.ids)
    dense, sizes = _dense(vec)
    width = dense.shape[1]
    if len(asked.dims) and asked.dims.max() >= (sizes[sizes > 0].min() if (sizes > 0).any() else 0) and (sizes > 0).any():
        raise ValueError("a question vector is wider than a document's")
    q = np.zeros((width, n_q))
    if width:
        q[asked.dims, asked.rows] = asked.weights
    with np.errstate(all="ignore"):
        if (dense == np.rint(dense)).all() and (q == np.rint(q)).all():
            dots = dense @ q                          # whole numbers: exact in any order
        else:
            dots = np.zeros((n, n_q))                 # in dimension order, as the row expression adds
            for d in range(width):
                dots += q[d][None, :] * dense[:, d][:, None]
        dn = _floats(vnorm)
        out = dots / (asked.norms[None, :] * dn[:, None])
    zero = (asked.norms[None, :] == 0) | (dn[:, None] == 0)
    return np.where(zero, 0.0, out)


def keyword_scores(asked: Asked, dl: pa.Array, tf: pa.Array, k1: float, b: float) -> np.ndarray:
    """BM25, documents x questions; 0 without a shared term."""
    n, n_q = len(tf), len(asked.ids)
    if asked.terms is None or len(asked.terms) == 0:
        return np.zeros((n, n_q))
    offsets = tf.offsets.to_numpy()
    first, size = int(offsets[0]), int(offsets[-1] - offsets[0])    # a slice keeps the whole child arrays
    keys, items = tf.keys.slice(first, size), tf.items.slice(first, size)
    row = np.repeat(np.arange(n), np.diff(offsets))
    codes = pc.index_in(keys, value_set=asked.terms)
    hit = np.nonzero(codes.is_valid().to_numpy(zero_copy_only=False))[0]
    code = codes.take(pa.array(hit)).to_numpy(zero_copy_only=False).astype(np.int64)
    return _summed(asked, dl, row[hit], code, _floats(items.take(pa.array(hit))), k1, b)


def coded_scores(asked: Asked, dl: pa.Array, postings: pa.Array, k1: float, b: float) -> np.ndarray:
    """:func:`keyword_scores` of stored postings: the question terms' codes belong to no other term of the index
    (``retrieval.prepare_questions`` looks)."""
    if asked.terms is None or len(asked.terms) == 0:
        return np.zeros((len(postings), len(asked.ids)))
    ends, flat = _bytes(postings)
    flat = flat[ends[0]:ends[-1]].view(POSTING)
    row, codes = np.repeat(np.arange(len(postings)), np.diff(ends) // POSTING.itemsize), flat["code"]
    sieve = getattr(asked, "_sieve", None)
    if sieve is None:
        sieve = asked._sieve = np.zeros(1 << 16, dtype=bool)
        sieve[asked.codes & 0xFFFF] = True
    hit = np.nonzero(sieve[codes & 0xFFFF])[0]
    held = codes[hit]
    place = np.minimum(np.searchsorted(asked.codes, held), len(asked.codes) - 1)
    same = asked.codes[place] == held
    hit = hit[same]
    return _summed(asked, dl, row[hit], asked.coded[place[same]], flat["n"][hit].astype(np.float64), k1, b)


def _summed(asked: Asked, dl: pa.Array, row: np.ndarray, code: np.ndarray, count: np.ndarray, k1: float, b: float) -> np.ndarray:
    """Contributions of (document, term, count) added up by document and question."""
    n, n_q = len(dl), len(asked.ids)
    share = count + k1 * ((1 - b) + b * _floats(dl)[row] / asked.avgdl)
    many = asked.starts[code + 1] - asked.starts[code]
    rep = np.repeat(np.arange(len(code)), many)
    at = asked.starts[code][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
    part = asked.gains[at] * (count * (k1 + 1))[rep] / share[rep]
    sums = np.bincount(row[rep] * n_q + asked.askers[at], weights=part, minlength=n * n_q)
    return sums.astype(np.float64).reshape(n, n_q)    # whole numbers come back where nothing was added


def ranked_value(x: np.ndarray) -> np.ndarray:
    """``round(score, 6)`` as Spark rounds: the shortest decimal form, half away from zero."""
    scale = 10.0 ** DIGITS
    with np.errstate(invalid="ignore"):
        y = np.abs(x) * scale
        low = np.floor(y + 0.5)
        out = np.copysign(low, x) / scale
        near = np.isfinite(x) & (np.abs(y - np.floor(y) - 0.5) < 1e-3)
    out = np.where(np.isfinite(x), out, x)
    for i in np.nonzero(near)[0]:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP))
    return out


def first_rows(who: np.ndarray, score: np.ndarray, ids: pa.Array, n_q: int, k: int, value: np.ndarray | None = None) -> np.ndarray:
    """Every question's first k rows by rounded score and id."""
    place = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    order = np.lexsort((place, -(ranked_value(score) if value is None else value), who))
    starts = np.searchsorted(who[order], np.arange(n_q))
    return order[np.arange(len(who)) - starts[who[order]] < k]


class Best:
    """The first k documents of every question of a group among those seen, by rounded score and id."""

    def __init__(self, asked: Asked, k: int):
        self.asked, self.k = asked, k
        self.floor = np.full(len(asked.ids), -np.inf)    # nothing below is among the first k
        self.who, self.score, self.ids, self.waiting, self.steps = [], [], [], 0, 0

    def add(self, scores: np.ndarray, ids: pa.Array, empty: np.ndarray) -> None:
        """``empty`` marks documents without a vector: they rank last, with a null score; NaN ranks first."""
        seen = np.where(np.isnan(scores), np.inf, scores)
        seen[empty] = -np.inf
        cut = self.floor
        if len(seen) > self.k and not np.isfinite(cut).all():
            kth = np.partition(seen, len(seen) - self.k, axis=0)[len(seen) - self.k]
            cut = np.maximum(cut, np.where(np.isfinite(kth), kth - 1.5 * 10.0 ** -DIGITS, kth))
        row, col = np.nonzero(seen >= cut[None, :])
        self.keep(col, seen[row, col], ids.take(pa.array(row)))

    def keep(self, who: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """Rows by question; infinite scores stand for NaN and null as in :meth:`add`."""
        self.who.append(who)
        self.score.append(score)
        self.ids.append(ids)
        self.waiting += len(who)
        self.steps += 1
        if self.steps in (1, 8, 64) or self.waiting > 2 * self.k * len(self.asked.ids) + 50_000:
            self.prune()

    def prune(self) -> None:
        if not self.who:
            return
        who, score, ids = np.concatenate(self.who), np.concatenate(self.score), pa.concat_arrays(self.ids)
        value = ranked_value(score)
        chosen = first_rows(who, score, ids, len(self.asked.ids), self.k, value)
        who = who[chosen]
        last = np.arange(len(who)) - np.searchsorted(who, who) == self.k - 1
        floor = value[chosen[last]]
        self.floor[who[last]] = np.maximum(self.floor[who[last]], np.where(np.isfinite(floor), floor - 10.0 ** -DIGITS, floor))
        self.who, self.score, self.ids = [who], [score[chosen]], [ids.take(pa.array(chosen))]
        self.waiting = len(chosen)

    def rows(self) -> tuple[pa.Array, pa.Array, np.ndarray]:
        self.prune()
        if not self.who:
            return None
        return self.asked.ids.take(pa.array(self.who[0])), self.ids[0], self.score[0]


# ------------------------------------------------------------ index rows

# Latin-1 texts are split here, as ``text.tokenize`` does: lower case, letters, digits, ``_`` and white space stay.
_LATIN = [chr(c) for c in range(256)]
_LOWER = "".join(" " if c.isspace() else c.lower() for c in _LATIN).encode("latin-1")
_DROPPED = "".join(c for c in _LATIN if not (c.isalnum() or c.isspace() or c == "_")).encode("latin-1")
_PENDING = 1_000_000     # tokens held as Python objects


def _split(texts: pa.Array, others: pa.Array) -> pa.Array:
    """Token lists of Latin-1 texts; those of other texts come ready made, and a null in both is a null list."""
    sizes, done, waiting = [], [], []
    for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        if text is None:
            found = [t.encode() for t in others[i].as_py() or ()]
        elif text.isascii():
            found = text.translate(_LOWER, _DROPPED).split()
        else:
            found = text.decode().encode("latin-1").translate(_LOWER, _DROPPED).decode("latin-1").encode().split()
        sizes.append(len(found))
        waiting += found
        if len(waiting) >= _PENDING:
            done.append(pa.array(waiting, pa.binary()).cast(pa.string()))
            waiting = []
    done.append(pa.array(waiting, pa.binary()).cast(pa.string()))
    none = pc.and_(texts.is_null(), others.is_null())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.concat_arrays(done),
                                    mask=none)


_SHORT = 55             # bytes that md5 takes in one block
_STEP = 16_384           # tokens hashed at once
_SHIFTS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]


def _digest_heads(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """First 8 bytes (big-endian) of the md5 of strings of at most 55 bytes: one block each, all strings at once."""
    n = len(sizes)
    block = np.zeros((n, 64), dtype=np.uint8)
    row = np.repeat(np.arange(n), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    block[row, place] = flat[starts[row] + place]
    block[np.arange(n), sizes] = 0x80
    words = np.ascontiguousarray(block.view("<u4").T)
    words[14] = sizes * 8
    first = [np.full(n, x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = first
    for i in range(64):
        if i < 16:
            mixed, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, g = c ^ (b | ~d), (7 * i) % 16
        mixed += a
        mixed += words[g]
        mixed += _SINES[i]
        turn = _SHIFTS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + ((mixed << np.uint32(turn)) | (mixed >> np.uint32(32 - turn)))
    heads = np.empty((n, 2), dtype="<u4")
    heads[:, 0], heads[:, 1] = a + first[0], b + first[1]
    return heads.view(">i8").reshape(n).astype(np.int64)


def term_codes(terms: pa.Array) -> np.ndarray:
    """The first 8 bytes of every term's md5 as a whole number (``retrieval.term_code``)."""
    found = np.zeros(len(terms), dtype=np.int64)
    if len(terms) == 0:
        return found
    ends, flat = _bytes(terms)
    starts, sizes = ends[:-1], np.diff(ends)
    short = np.nonzero(sizes <= _SHORT)[0]
    for at in range(0, len(short), _STEP):
        some = short[at:at + _STEP]
        found[some] = _digest_heads(flat, starts[some], sizes[some])
    for i in np.nonzero(sizes > _SHORT)[0]:
        whole = flat[starts[i]:ends[i + 1]].tobytes()
        found[i] = int.from_bytes(md5(whole, usedforsecurity=False).digest()[:8], "big", signed=True)
    return found


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array without nulls."""
    held = col.cast(pa.binary())
    _, offsets, data = held.buffers()
    ends = np.frombuffer(offsets, np.int32)[held.offset:held.offset + len(held) + 1].astype(np.int64)
    return ends, np.frombuffer(data or b"", np.uint8)


def _token_codes(codes: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of every distinct token (``vectors.hashed_counts``)."""
    found = (codes >> 32) & 0xFFFFFFFF
    return found % dim, np.where((found // dim) % 2 == 0, 1.0, -1.0)


def _counted(tokens: pa.Array, dim: int | None, packed: bool = False) -> list[pa.Array]:
    """``dl``, ``tf`` (terms in byte order; with ``packed`` the columns of :data:`PACKED`) and, with ``dim``, the hashed
    vector of every token list."""
    n = len(tokens)
    row, flat = _lists(tokens)
    coded = flat.dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy()
    order = pc.sort_indices(terms).to_numpy().astype(np.int64)
    place = np.empty(len(terms), dtype=np.int64)
    place[order] = np.arange(len(terms))
    pairs, counts = np.unique(row * max(len(terms), 1) + place[code], return_counts=True)
    owner, term = pairs // max(len(terms), 1), order[pairs % max(len(terms), 1)] if len(terms) else pairs
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    held, hashes = terms.take(pa.array(term)), term_codes(terms) if dim or packed else None
    out = [pc.list_value_length(tokens).cast(pa.int32())]
    if packed:
        lists = lambda values: pa.ListArray.from_arrays(pa.array(offsets), values)
        posts = np.empty(len(term), dtype=POSTING)
        posts["code"], posts["n"] = hashes[term], counts
        ends = (offsets.astype(np.int64) * POSTING.itemsize).astype(np.int32)
        out += [pc.binary_join(lists(held), " "), lists(pa.array(counts.astype(np.int32))),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(posts.tobytes())])]
    else:
        out.append(pa.MapArray.from_arrays(pa.array(offsets), held, pa.array(counts.astype(np.int32))))
    if dim:
        at, sign = _token_codes(hashes, dim)
        vec = np.bincount(owner * dim + at[term], weights=sign[term] * counts, minlength=n * dim).astype(np.float64)
        out.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(vec)))
    return out


# What a stored index holds for ``tf``: its terms in byte order with a space between, their counts, and both as numbers
# that batch scores take as they are: code and count of every term, in the same order.
POSTING = np.dtype([("code", "<i8"), ("n", "<i4")])
PACKED = [ST.StructField("terms", ST.StringType()), ST.StructField("counts", ST.ArrayType(ST.IntegerType())),
          ST.StructField("postings", ST.BinaryType())]


def term_counts(packed: DataFrame) -> DataFrame:
    """``term, n``: documents of a batch that hold a term; a term has a row per batch."""
    def run(batches):
        for batch in batches:
            found = pc.list_flatten(pc.split_pattern(batch.column("terms"), " ")).value_counts()
            some = pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["term", "n"])
            yield some.filter(pc.not_equal(some.column("term"), ""))   # of a document without terms

    return packed.select("terms").mapInArrow(run, "term string, n bigint")


def count_rows(docs: DataFrame, text: str, dim: int | None, packed: bool = False) -> DataFrame:
    """``keep..., dl, tf, vec`` from ``keep...`` and the column ``text`` (and ``vec``, when ``dim`` is None); with
    ``packed``, :data:`PACKED` in place of ``tf``. Texts with characters beyond Latin-1 are tokenised by the row expression."""
    wide = F.col(text).rlike(r"[^\x00-\xFF]")
    tokens = docs.withColumn("_toks", F.when(wide, tokenize(text))).withColumn(
        "_text", F.when(~wide, F.col(text).cast("string")))
    tokens = tokens.drop(text) if text != "_text" else tokens
    keep = [f for f in tokens.schema.fields if f.name not in ("_text", "_toks", "vec")]
    schema = ST.StructType(keep + [
        ST.StructField("dl", ST.IntegerType()),
        *(PACKED if packed else [ST.StructField("tf", ST.MapType(ST.StringType(), ST.IntegerType()))]),
        ST.StructField("vec", ST.ArrayType(ST.DoubleType()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                split = _split(some.column("_text"), some.column("_toks"))
                cols = [some.column(f.name) for f in keep] + _counted(split, dim, packed)
                if dim is None:
                    cols.append(some.column("vec"))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return tokens.mapInArrow(run, schema)


# ----------------------------------------------------------- stored indexes

def nearest_cells(rows: DataFrame, centroids: list[tuple[int, list[float]]], no_cell: int) -> DataFrame:
    """``rows`` (with ``vec, vnorm``) and their ``cell`` (the last of equally near ones) and ``angle``; ``no_cell`` at angle
    0 without a direction. ``centroids``: (cell, unit vector)."""
    schema = ST.StructType(rows.schema.fields + [
        ST.StructField("cell", ST.IntegerType()), ST.StructField("angle", ST.DoubleType())])
    cells = np.array([c for c, _ in sorted(centroids)], dtype=np.int32)
    units = np.array([v for _, v in sorted(centroids)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                cell, angle = np.full(some.num_rows, no_cell, dtype=np.int32), np.zeros(some.num_rows)
                length = _floats(some.column("vnorm"))
                found = np.nonzero(length > 0)[0]
                if len(cells) and len(found):
                    dots = _dense(some.column("vec"))[0][found] @ units.T
                    best = len(cells) - 1 - np.argmax(dots[:, ::-1], axis=1)
                    cell[found] = cells[best]
                    angle[found] = np.arccos(np.clip(dots[np.arange(len(found)), best] / length[found], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays(some.columns + [pa.array(cell), pa.array(angle)], names=schema.names)

    return rows.mapInArrow(run, schema)


# ------------------------------------------------------------- ranked lists

def _steps(batches, asked_groups: dict, group: str | None):
    """``group, first question, questions, documents`` of every step: a batch is cut into rows of one group, and large
    question sets into parts."""
    parts: dict = {}
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            for name, docs in group_rows(some, group):
                asked = asked_groups.get(name)
                if asked is None or (group and name is None):   # a null group joins with nothing
                    continue
                if name not in parts:
                    size = max(1, CELLS // ROWS)
                    parts[name] = [(first, asked if len(asked.ids) <= size else asked.part(first, first + size))
                                   for first in range(0, len(asked.ids), size)]
                for first, part in parts[name]:
                    yield name, first, part, docs


def _scored(part: Asked, docs: pa.RecordBatch, kind: str, alpha: float, k1: float, b: float):
    """``bm25, semantic`` (either may be None) and the marks of documents without a vector."""
    bm = sem = None
    empty = np.zeros(docs.num_rows, dtype=bool)
    if kind != "semantic":
        bm = (coded_scores(part, docs.column("dl"), docs.column("postings"), k1, b)
              if "postings" in docs.schema.names else keyword_scores(part, docs.column("dl"), docs.column("tf"), k1, b))
    if kind != "keyword":
        sem = cosines(part, docs.column("vec"), docs.column("vnorm"))
        empty = docs.column("vec").is_null().to_numpy(zero_copy_only=False)
    return bm, sem, empty


def _schema(index: DataFrame, qside: DataFrame, group: str | None, more: list[str], doc: bool) -> ST.StructType:
    fields = [index.schema[group]] if group else []
    fields.append(ST.StructField("query_id", qside.schema["query_id"].dataType))
    if doc:
        fields.append(ST.StructField("doc_id", index.schema["doc_id"].dataType))
    return ST.StructType([ST.StructField(f.name, f.dataType) for f in fields]
                         + [ST.StructField(c, ST.DoubleType()) for c in more])


def score_columns(index: DataFrame, qside: DataFrame, group: str | None, kind: str) -> DataFrame:
    """What batch scores read of an index."""
    packed = getattr(index, "_sifter_packed", None)
    words = ["dl", "tf"]
    if packed is not None and getattr(qside, "_sifter_coded", None) is packed:
        index, words = packed, ["dl", "postings"]
    cols = [group] if group else []
    cols += ["doc_id"] + (words if kind != "semantic" else []) + (["vec", "vnorm"] if kind != "keyword" else [])
    return index.select(*cols)


def score_ranges(index: DataFrame, qside: DataFrame, asked: dict, group: str | None, k1: float, b: float) -> DataFrame:
    """``[group,] query_id`` and both scores' smallest and largest value, a row per question and task."""
    def run(batches):
        ends: dict = {}
        for name, first, part, docs in _steps(batches, asked, group):
            bm, sem, empty = _scored(part, docs, "both", 0.0, k1, b)
            sem = sem[~empty]
            found = [bm.min(0), bm.max(0)] + ([np.fmin.reduce(sem, 0), sem.max(0)] if len(sem) else
                                              [np.full(bm.shape[1], np.nan)] * 2)
            found = np.array(found)
            held = ends.get((name, first))
            if held is None:
                ends[(name, first)] = (part, found, len(sem) > 0)
            else:
                old = held[1]
                both = np.array([np.minimum(old[0], found[0]), np.maximum(old[1], found[1]),
                                 np.fmin(old[2], found[2]), old[3]])
                both[3] = np.maximum(old[3], found[3]) if held[2] and len(sem) else (found[3] if len(sem) else old[3])
                ends[(name, first)] = (part, both, held[2] or len(sem) > 0)
        for (name, _), (part, e, any_sem) in ends.items():
            cols = [pa.array([name] * len(part.ids), kind)] if group else []
            cols += [part.ids, pa.array(e[0]), pa.array(e[1])]
            cols += [pa.array(e[2]), pa.array(e[3])] if any_sem else [pa.nulls(len(part.ids), pa.float64())] * 2
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = _schema(index, qside, group, RANGES, False)
    names, kind = schema.names, to_arrow_type(schema[0].dataType)
    return score_columns(index, qside, group, "both").mapInArrow(run, schema)


def pair_scores(rows: DataFrame, qside: DataFrame, asked: dict, group: str | None, k1: float, b: float) -> DataFrame:
    """``[group,] query_id, doc_id, bm, sem`` of the questions in ``asked_by`` of every row (:func:`score_columns`)."""
    def run(batches):
        for name, first, part, docs in _steps(batches, asked, group):
            bm, sem, empty = _scored(part, docs, "both", 0.0, k1, b)
            row, who = _lists(docs.column("asked_by"))
            place = pc.index_in(who, value_set=part.ids)
            mine = np.nonzero(place.is_valid().to_numpy(zero_copy_only=False))[0]
            at, col = row[mine], place.take(pa.array(mine)).to_numpy(zero_copy_only=False).astype(np.int64)
            cols = [pa.array([name] * len(at), of_group)] if group else []
            yield pa.RecordBatch.from_arrays(
                cols + [part.ids.take(pa.array(col)), docs.column("doc_id").take(pa.array(at)), pa.array(bm[at, col]),
                        pa.array(sem[at, col], mask=empty[at])], names=names)

    schema = _schema(rows, qside, group, ["bm", "sem"], True)
    names, of_group = schema.names, to_arrow_type(schema[0].dataType)
    return rows.mapInArrow(run, schema)


def best_rows(index: DataFrame, qside: DataFrame, asked: dict, group: str | None, kind: str, k: int,
              alpha: float = 0.5, k1: float = 1.5, b: float = 0.75, eps: float = 1e-8) -> DataFrame:
    """``[group,] query_id, doc_id, score``: every task's k best documents of every question. ``kind`` is ``keyword``,
    ``semantic`` or ``both`` (the blend of the scores over their ranges)."""
    def run(batches):
        best: dict = {}
        for name, first, part, docs in _steps(batches, asked, group):
            bm, sem, empty = _scored(part, docs, kind, alpha, k1, b)
            if kind == "both":
                r = part.ranges
                scores = ((1.0 - alpha) * ((bm - r[0]) / (r[1] - r[0] + eps))
                          + alpha * ((sem - r[2]) / (r[3] - r[2] + eps)))
            else:
                scores = bm if kind == "keyword" else sem
            if (name, first) not in best:
                best[(name, first)] = Best(part, k)
            best[(name, first)].add(scores, docs.column("doc_id"), empty)
        for (name, _), found in best.items():
            rows = found.rows()
            if rows is None:
                continue
            who, ids, score = rows
            value = pa.array(np.where(np.isposinf(score), np.nan, score), mask=np.isneginf(score))
            cols = [pa.array([name] * len(who), of_group)] if group else []
            yield pa.RecordBatch.from_arrays(cols + [who, ids, value], names=names)

    schema = _schema(index, qside, group, ["score"], True)
    names, of_group = schema.names, to_arrow_type(schema[0].dataType)
    return score_columns(index, qside, group, kind).mapInArrow(run, schema)
