"""Posting segments: inverted lists of a few thousand documents, and the steps of a keyword search inside one.

A segment is what one task counted in a row, at most ``SEGMENT_DOCS`` documents of a group. Its rows are

* ``term ''``: the documents' ids and, in ``counts``, their lengths;
* one row a term: ``df``, ``peak`` (largest impact), ``places`` (the documents that hold it, as 2-byte numbers inside the
  segment), ``counts`` (a byte each, 4 where one is above 255) and ``bounds``: for every block of documents that holds the term
  a byte, the block's largest impact as a share of ``peak``, rounded up.

Impacts (the term-frequency part of BM25) are computed from counts and lengths when postings are read. A segment
holds its documents' postings whole, so the steps of a search run inside its task, for all questions at once, and only ranked rows leave it.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as ST

from sifter.operators.batch_scores import Asked, _bytes, _floats, _lists, first_rows, group_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEGMENT_DOCS = 4096      # at most 65,536: places take 2 bytes
WAITING = 4 * SEGMENT_DOCS   # documents that wait for their groups' segments to fill
PAIRS = 2_000_000        # (question, document) pairs of one step
DENSE = 64               # (question, document) pairs of one term that are added as a block
MARGIN = 2e-6            # scores are ranked at 6 places


# ------------------------------------------------------------------- index

def posting_segments(docs: DataFrame, group: str | None, k1: float, b: float, block_docs: int) -> DataFrame:
    """``[group,] segment, term, df, peak, bounds, places, counts, ids`` from ``[group,] doc_id, dl, avgdl`` and ``tf`` (or a stored
    index's ``terms, counts``); documents stay in their task."""
    fields = [docs.schema[group]] if group else []
    schema = ST.StructType(fields + [
        ST.StructField("segment", ST.LongType()), ST.StructField("term", ST.StringType()),
        ST.StructField("df", ST.IntegerType()), ST.StructField("peak", ST.FloatType()),
        ST.StructField("bounds", ST.BinaryType()), ST.StructField("places", ST.BinaryType()),
        ST.StructField("counts", ST.BinaryType()), ST.StructField("ids", ST.ArrayType(docs.schema["doc_id"].dataType))])
    size, most = SEGMENT_DOCS, WAITING

    def run(batches):
        task, made, waiting, held = TaskContext.get().partitionId(), 0, {}, {}

        def flush(name):
            nonlocal made
            rows = pa.Table.from_batches(waiting.pop(name)).combine_chunks().to_batches()[0]
            held.pop(name)
            made += 1
            return _segment(rows, group, (task << 32) + made - 1, k1, b, block_docs, schema)

        for batch in batches:
            for name, rows in group_rows(batch, group):
                while rows.num_rows:
                    some = rows.slice(0, size - held.get(name, 0))
                    rows = rows.slice(some.num_rows)
                    waiting.setdefault(name, []).append(some)
                    held[name] = held.get(name, 0) + some.num_rows
                    if held[name] == size:
                        yield from flush(name)
            while sum(held.values()) > most:
                yield from flush(max(held, key=held.get))
        for name in list(waiting):
            yield from flush(name)

    words = ["terms", "counts"] if "terms" in docs.columns else ["tf"]
    return docs.select(*([group] if group else []), "doc_id", "dl", "avgdl", *words).mapInArrow(run, schema)


def _counted_terms(rows: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, term and count of every posting."""
    if "terms" in rows.schema.names:
        terms = rows.column("terms")
        row, keys = _lists(pc.split_pattern(pc.if_else(pc.equal(terms, ""), pa.scalar(None, terms.type), terms), " "))
        return row, keys, _lists(rows.column("counts"))[1].to_numpy(zero_copy_only=False).astype(np.int64)
    tf = rows.column("tf")
    offsets = tf.offsets.to_numpy()
    first, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    return (np.repeat(np.arange(rows.num_rows), np.diff(offsets)), tf.keys.slice(first, size),
            tf.items.slice(first, size).to_numpy(zero_copy_only=False).astype(np.int64))


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()),
                                                              pa.py_buffer(flat.tobytes())])


def _impacts(count: np.ndarray, length: np.ndarray, avgdl, k1: float, b: float) -> np.ndarray:
    return count * (k1 + 1) / (count + k1 * ((1 - b) + b * length / avgdl))


def _packed_counts(count: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Counts of every term in a byte each, in 4 where one is larger."""
    sizes = np.diff(np.append(starts, len(count)))
    wide = np.maximum.reduceat(count, starts) > 255 if len(starts) else np.zeros(0, bool)
    width = np.where(wide, 4, 1)
    ends = np.concatenate([[0], np.cumsum(sizes * width)])
    flat = np.zeros(int(ends[-1]), dtype=np.uint8)
    of = np.repeat(np.arange(len(starts)), sizes)
    at = ends[:-1][of] + (np.arange(len(count)) - starts[of]) * width[of]
    flat[at] = count & 0xFF
    if wide.any():
        some = wide[of]
        for byte in (1, 2, 3):
            flat[at[some] + byte] = (count[some] >> (8 * byte)) & 0xFF
    return _binary(flat, ends)


def _segment(rows: pa.RecordBatch, group: str | None, segment: int, k1: float, b: float, block_docs: int,
             schema: ST.StructType):
    n, dl = rows.num_rows, _floats(rows.column("dl"))
    row, keys, count = _counted_terms(rows)
    coded = keys.dictionary_encode()
    code, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    order = pc.sort_indices(terms).to_numpy().astype(np.int64)
    place = np.empty(len(terms), dtype=np.int64)
    place[order] = np.arange(len(terms))
    by = np.argsort(place[code], kind="stable")
    owner, row, count = place[code][by], row[by], count[by]
    impact = _impacts(count, dl[row], _floats(rows.column("avgdl"))[row], k1, b)
    starts = np.nonzero(np.append(True, owner[1:] != owner[:-1]))[0] if len(owner) else np.zeros(0, np.int64)
    peak = np.nextafter(np.maximum.reduceat(impact, starts).astype(np.float32), np.float32(np.inf)) if len(starts) else \
        np.zeros(0, np.float32)
    block = row // block_docs
    b_starts = np.nonzero(np.append(True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])))[0] if len(owner) else starts
    best, top = (np.maximum.reduceat(impact, b_starts) if len(b_starts) else np.zeros(0)), peak.astype(np.float64)[owner[b_starts]]
    with np.errstate(all="ignore"):
        level = np.where(top > 0, np.clip(np.ceil(best / top * 255), 0, 255), 255)
    level = np.minimum(level + (level * (top / 255) < best), 255).astype(np.uint8)
    sizes = np.diff(np.append(starts, len(owner)))
    group_of = (lambda m: [pa.array([rows.column(group)[0].as_py()] * m, rows.column(group).type)]) if group else (lambda m: [])
    ends = np.append(starts, len(owner))
    none = pa.nulls(1, pa.binary())
    head = [*group_of(1), pa.array([segment], pa.int64()), pa.array([""]), pa.array([n], pa.int32()),
            pa.array([0.0], pa.float32()), none, none, _binary(dl.astype("<i4").view(np.uint8), np.array([0, 4 * n])),
            pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows.column("doc_id"))]
    yield pa.RecordBatch.from_arrays(head, names=schema.names)
    m = len(starts)
    if m == 0:
        return
    ids = pa.ListArray.from_arrays(pa.array(np.zeros(m + 1, np.int32)), rows.column("doc_id").slice(0, 0),
                                   mask=pa.array(np.ones(m, bool)))
    lists = [*group_of(m), pa.array(np.full(m, segment)), terms.take(pa.array(order)).cast(pa.string()),
             pa.array(sizes.astype(np.int32)), pa.array(peak), _binary(level, np.append(np.searchsorted(b_starts, starts), len(b_starts))),
             _binary(row.astype("<u2").view(np.uint8), 2 * ends), _packed_counts(count, starts), ids]
    whole = pa.RecordBatch.from_arrays(lists, names=schema.names)
    for at in range(0, m, 16_384):
        yield whole.slice(at, 16_384)


# ------------------------------------------------------------------ search

@dataclass
class Plan:
    """The questions of one group for one step: ``use`` names the term entries (of ``asked``) that count as active, ``theta`` the
    thresholds (NaN without one), ``slack`` what the other terms can add; ``seeds``: question, segment and place of promising documents."""
    asked: Asked
    use: np.ndarray
    theta: np.ndarray | None = None
    slack: np.ndarray | None = None
    seeds: tuple | None = None


@dataclass
class Entries:
    """Questions and weights by term."""
    starts: np.ndarray
    askers: np.ndarray
    gains: np.ndarray


def _entries(asked: Asked, use: np.ndarray, first: int = 0, last: int | None = None) -> Entries:
    last = len(asked.ids) if last is None else last
    held = use & (asked.askers >= first) & (asked.askers < last)
    return Entries(np.concatenate([[0], np.cumsum(held)])[asked.starts], asked.askers[held] - first, asked.gains[held])


class Segment:
    """A segment's rows of the asked terms."""

    def __init__(self, table: pa.Table, asked: Asked, k1: float, b: float, block_docs: int):
        rows = table.combine_chunks().to_batches()[0]
        term = rows.column("term")
        head = int(np.nonzero(pc.equal(term, "").to_numpy(zero_copy_only=False))[0][0])
        code = pc.index_in(term, value_set=asked.terms)
        known = np.nonzero(code.is_valid().to_numpy(zero_copy_only=False))[0]
        self.number = rows.column("segment")[0].as_py()
        self.ids = rows.column("ids")[head].values
        self.n, self.block_docs = len(self.ids), block_docs
        self.blocks = -(-self.n // block_docs)
        length = np.frombuffer(rows.column("counts")[head].as_py(), "<i4")
        mine = rows.take(pa.array(known))
        self.code = code.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64)
        df = mine.column("df").to_numpy().astype(np.int64)
        self.ends = np.concatenate([[0], np.cumsum(df)])
        ends, flat = _bytes(mine.column("places"))
        self.place = np.frombuffer(flat[ends[0]:ends[-1]].tobytes(), "<u2").astype(np.int64)
        ends, flat = _bytes(mine.column("counts"))
        width = np.diff(ends) // np.maximum(df, 1)
        of = np.repeat(np.arange(len(df)), df)
        at = ends[:-1][of] + (np.arange(len(of)) - self.ends[of]) * width[of]
        count = flat[at].astype(np.int64) if len(at) else np.zeros(0, np.int64)
        wide = width[of] == 4
        if wide.any():
            for byte in (1, 2, 3):
                count[wide] += flat[at[wide] + byte].astype(np.int64) << (8 * byte)
        self.impact = _impacts(count, length[self.place], asked.avgdl, k1, b)
        # Blocks of every term: where a posting's block differs from the one before.
        block = self.place // block_docs
        new = np.ones(len(block), dtype=bool)
        new[1:] = (block[1:] != block[:-1]) | (of[1:] != of[:-1])
        self.block, owner = block[new], of[new]
        ends, flat = _bytes(mine.column("bounds"))
        self.bound = flat[ends[0]:ends[-1]] * (mine.column("peak").to_numpy().astype(np.float64)[owner] / 255)
        self.block_ends = np.searchsorted(owner, np.arange(len(df) + 1))

    def sums(self, entries: Entries, n_q: int, ends: np.ndarray, at: np.ndarray, value: np.ndarray, width: int,
             positive: bool) -> tuple[np.ndarray, np.ndarray]:
        """``gain * value`` added up by question and place (or block), and where anything was added."""
        total = np.zeros((n_q, width))
        held = np.zeros((n_q, width), dtype=bool)
        many = entries.starts[self.code + 1] - entries.starts[self.code]
        size = np.diff(ends)
        gains = np.maximum(entries.gains, 0.0) if positive else entries.gains
        asked = np.nonzero(many)[0]
        dense = many[asked] * size[asked] >= DENSE
        for r in asked[dense]:
            e, s = slice(entries.starts[self.code[r]], entries.starts[self.code[r] + 1]), slice(ends[r], ends[r + 1])
            spot = np.ix_(entries.askers[e], at[s])
            total[spot] += gains[e][:, None] * value[s][None, :]
            held[spot] = True
        rare = asked[~dense]
        pairs = many[rare] * size[rare]
        of = np.repeat(rare, pairs)
        step = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        who = entries.starts[self.code[of]] + step // np.maximum(size[of], 1)
        spot = ends[:-1][of] + step % np.maximum(size[of], 1)
        flat = entries.askers[who] * width + at[spot]
        np.add.at(total.reshape(-1), flat, gains[who] * value[spot])
        held.reshape(-1)[flat] = True
        return total, held

    def added(self, entries: Entries, who: np.ndarray, place: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """``raw`` of the pairs (sorted by question) with the contributions of ``entries`` added."""
        raw, lows = raw.copy(), np.searchsorted(who, np.arange(int(who.max()) + 2 if len(who) else 1))
        dense = np.zeros(self.n)
        for r in np.nonzero(entries.starts[self.code + 1] > entries.starts[self.code])[0]:
            asks = [e for e in range(entries.starts[self.code[r]], entries.starts[self.code[r] + 1])
                    if entries.askers[e] + 1 < len(lows) and lows[entries.askers[e]] < lows[entries.askers[e] + 1]]
            if not asks:
                continue
            spot = self.place[self.ends[r]:self.ends[r + 1]]
            dense[spot] = self.impact[self.ends[r]:self.ends[r + 1]]
            for e in asks:
                s = slice(lows[entries.askers[e]], lows[entries.askers[e] + 1])
                raw[s] += entries.gains[e] * dense[place[s]]
            dense[spot] = 0.0
        return raw


def _most(part: np.ndarray, held: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Question and place of every question's ``n`` largest sums among the held."""
    seen = np.where(held, part, -np.inf)
    if seen.shape[1] > n:
        kth = np.partition(seen, seen.shape[1] - n, axis=1)[:, seen.shape[1] - n]
        cut = np.maximum(kth, -np.finfo(float).max)
        who, place = np.nonzero(seen >= cut[:, None])
        order = np.lexsort((place, -seen[who, place], who))
        who, place = who[order], place[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < n
        who, place = who[keep], place[keep]
        order = np.lexsort((place, who))
        return who[order], place[order]
    return np.nonzero(held)


def named(seg: Segment, plan: Plan, n: int):
    """Step 1: every question's ``n`` documents with the largest sums of its strong terms: question, place, sum."""
    size = max(1, PAIRS // max(seg.n, 1))
    for first in range(0, len(plan.asked.ids), size):
        last = min(first + size, len(plan.asked.ids))
        part, held = seg.sums(_entries(plan.asked, plan.use, first, last), last - first, seg.ends, seg.place, seg.impact, seg.n, False)
        who, place = _most(part, held, n)
        yield who + first, place, part[who, place]


def seed_scores(seg: Segment, plan: Plan):
    """Step 1: the promising documents scored whole: question, score."""
    who, segment, place = plan.seeds
    mine = np.nonzero(segment == seg.number)[0]
    mine = mine[np.argsort(who[mine], kind="stable")]
    whole = seg.added(_entries(plan.asked, np.ones(len(plan.asked.askers), bool)), who[mine], place[mine], np.zeros(len(mine)))
    return who[mine], whole


def found(seg: Segment, plan: Plan, k: int, seeds: int):
    """Steps 2 to 4: question, place, score of the segment's documents that may be among the first k, and the numbers of
    touched and whole scored documents by question."""
    size = max(1, PAIRS // max(seg.n, 1))
    for first in range(0, len(plan.asked.ids), size):
        last = min(first + size, len(plan.asked.ids))
        n_q, active = last - first, _entries(plan.asked, plan.use, first, last)
        weak = _entries(plan.asked, ~plan.use, first, last)
        theta, slack = plan.theta[first:last], plan.slack[first:last]
        needed = np.where(np.isnan(theta), -np.inf, theta - MARGIN - slack)
        bound, held = seg.sums(active, n_q, seg.block_ends, seg.block, seg.bound, seg.blocks, True)
        going = held & (bound >= needed[:, None])
        if not going.any():
            yield first, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(n_q, np.int64), np.zeros(n_q, np.int64)
            continue
        part, held = seg.sums(active, n_q, seg.ends, seg.place, seg.impact, seg.n, False)
        held &= np.repeat(going, seg.block_docs, axis=1)[:, :seg.n]
        touched = held.sum(1)
        held &= part >= needed[:, None]
        # The sums themselves name better candidates for the threshold.
        who, place = _most(part, held, seeds)
        raw = seg.added(weak, who, place, part[who, place])
        order = np.lexsort((-raw, who))
        kth = order[np.arange(len(who)) - np.searchsorted(who, who) == k - 1]    # who is sorted
        floor = np.where(np.isnan(theta), -np.inf, theta)
        floor[who[kth]] = np.maximum(floor[who[kth]], np.where(raw[kth] > 0, raw[kth], -np.inf))
        held &= part >= (floor - MARGIN - slack)[:, None]
        done = np.zeros_like(held)
        done[who, place] = True
        more, spot = np.nonzero(held & ~done)
        rest = seg.added(weak, more, spot, part[more, spot])
        scored = np.bincount(who, minlength=n_q) + np.bincount(more, minlength=n_q)
        who, place, raw = np.append(who, more), np.append(place, spot), np.append(raw, rest)
        keep = raw >= (floor - MARGIN)[who]
        who, place, raw = who[keep], place[keep], raw[keep]
        best = first_rows(who, raw, seg.ids.take(pa.array(place)), n_q, k)
        yield first, who[best], place[best], raw[best], touched, scored
