"""Repair of conversation structure: the cheapest edits that make the roles alternate.

A conversation is a list of (role, text) rows. Every row is kept, given the role user or
assistant, or deleted; empty user or assistant rows may be inserted anywhere. The roles' first
letters must then read ``(s?(ua)+)?``. Costs are parameters (``Costs``); blank and duplicate rows must go,
and a truncated row that stays costs extra. Of the cheapest audits (the edits' letters in order) the least in ASCII
order is returned.

*Persistent audits.* The dynamic programme has four states (nothing yet, after s, after u, after a).
An audit is a linked node: a letter, a parent, a depth, ancestors at distances 1, 2, 4, ...
and a rolling hash, so states share their prefixes and nothing is copied. Equal costs are settled by
the audits' longest common prefix: both nodes climb to the same depth, then by halving distances to where their hashes
first agree. Agreement of hashes is verified: the two prefixes are walked back letter by letter until they meet in a
shared node, and a difference found on the way (a collision) makes the walk's own answer count.

*Many tasks for one conversation.* Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of
any length is spread over neighbouring partitions. One that lies inside a partition is finished there. Of the first
and last one of each partition the segment is written to a table; duplicates across segments come from a grouped
minimum over (conversation, role, text digest), the programme runs per segment from every state it may be entered in,
and the segments' cost tables are put together in order. That is exact: insertions belong to the row
behind them (or to the end), so audits of a segment are prefix-free and the least of a concatenation is the
concatenation of the least ones. Only costs and audits are brought together per conversation; texts stay in their
segments, and digests read the segments as a stream.

Defined results: null roles, texts, ids and turns read as one space in keys and comparisons (so a null text is blank and
a null role has to go or to be given another); null turns come first and do not count for gaps; rows of equal
turn stand in (role, text) order; repeated rows are duplicates of the first; null ``conv_id`` is a conversation of its own;
an empty table gives an empty result; long texts are read once and held only in their row. Only the four columns are
read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import stored

BLANK_CHARS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT},
        ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
ROLE_OF = {"u": "user", "a": "assistant"}
HASH_MOD, HASH_BASE = (1 << 61) - 1, 1_000_003
SEEN_WHOLE = 200  # texts up to this length are compared themselves, longer ones by SHA-256


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Audit:
    """A letter behind a shared prefix."""

    __slots__ = ("letter", "up", "depth", "hash")

    def __init__(self, letter: str, parent: Audit | None):
        self.letter = letter
        if parent is None:
            self.up, self.depth, self.hash = (), 0, 0
            return
        up, k = [parent], 0
        while k < len(up[k].up):          # the 2**(k+1)th ancestor is the 2**k-th one's
            up.append(up[k].up[k])
            k += 1
        self.up, self.depth = tuple(up), parent.depth + 1
        self.hash = (parent.hash * HASH_BASE + ord(letter)) % HASH_MOD

    def at(self, depth: int) -> Audit:
        """The prefix of that many letters."""
        node = self
        while node.depth > depth:
            node = node.up[(node.depth - depth).bit_length() - 1]
        return node

    def text(self) -> str:
        letters, node = [], self
        while node.depth:
            letters.append(node.letter)
            node = node.up[0]
        return "".join(reversed(letters))


def _first_difference(x: Audit, y: Audit) -> tuple[str, str] | None:
    """The letters at which two prefixes of equal depth first differ, by walking to the root or a shared node."""
    found = None
    while x is not y and x.depth:
        if x.letter != y.letter:
            found = (x.letter, y.letter)
        x, y = x.up[0], y.up[0]
    return found


def audit_less(x: Audit, y: Audit) -> bool:
    """Whether audit x comes before y in ASCII order."""
    depth = min(x.depth, y.depth)
    a, b = x.at(depth), y.at(depth)
    if a.hash == b.hash:
        differ = _first_difference(a, b)
        return x.depth < y.depth if differ is None else differ[0] < differ[1]
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and a.up[k].hash != b.up[k].hash:
            a, b = a.up[k], b.up[k]
    # Parents agree by hash: verify, and let a collision's walk decide.
    differ = _first_difference(a.up[0], b.up[0]) or (a.letter, b.letter)
    return differ[0] < differ[1]


def _offer(states: dict, state: int, cost: int, node: Audit, letter: str) -> None:
    held = states.get(state)
    if held is not None and held[0] < cost:
        return
    made = Audit(letter, node)
    if held is None or cost < held[0] or audit_less(made, held[1]):
        states[state] = (cost, made)


def _inserted(states: dict, costs: Costs) -> dict:
    """States reachable by inserting rows, each with its cheapest audit (three in a row reach every state)."""
    out, step = dict(states), states
    for _ in range(3):
        grown: dict = {}
        for state, (cost, node) in step.items():
            for letter, to in NEXT[state].items():
                held = out.get(to)
                if letter in ROLE_OF and (held is None or cost + costs.insert <= held[0]):
                    _offer(grown, to, cost + costs.insert, node, "I")
        step = {}
        for state, (cost, node) in grown.items():
            held = out.get(state)
            if held is None or cost < held[0] or audit_less(node, held[1]):
                out[state] = step[state] = (cost, node)
        if not step:
            break
    return out


def cheapest(rows: list[tuple[str, bool, bool]], entry: int, costs: Costs, last: bool) -> dict:
    """Exit state -> (cost, audit node) for rows of (role's first letter, must go, truncated)."""
    states = {entry: (0, Audit("", None))}
    for initial, gone, cut in rows:
        stay, after = costs.truncated * cut, {}
        for state, (cost, node) in states.items():  # insertions stand behind deleted rows: D < I
            _offer(after, state, cost + costs.delete, node, "D")
        if not gone:
            for state, (cost, node) in _inserted(states, costs).items():
                for letter, to in NEXT[state].items():
                    if letter == initial:
                        _offer(after, to, cost + stay, node, "K")
                    elif letter in ROLE_OF:
                        _offer(after, to, cost + stay + costs.rerole, node, "R")
        states = after
    return _inserted(states, costs) if last else states


def repaired_rows(rows: list[tuple[str, str]], audit: str, entry: int) -> Iterator[tuple[str, str]]:
    """The rows that an audit leaves, in order."""
    state, at = entry, 0
    for letter in audit:
        if letter == "I":
            initial = "a" if state == USER else "u"
            yield ROLE_OF[initial], ""
            state = NEXT[state][initial]
            continue
        role, text = rows[at]
        at += 1
        if letter == "D":
            continue
        if letter == "R":
            role = ROLE_OF["a" if state == USER else "u"]
        yield role, text
        state = NEXT[state][role[:1]]


def _text_of(rows) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


# -- damage and order ---------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the registered query, native: ``conv_id, turn, role, text, copies``; ``copies`` is 0 for a
    dropped row (it keeps its conversation listed) and 2 for a repeated one."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = space("text")
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(space("role")).alias("role"),
        F.when(kind == 0, F.lit("")).when(kind == 1, F.lit(""))
        .when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


# -- segments -----------------------------------------------------------------

def _key(role: str, text: str) -> tuple:
    return role, text if len(text) <= SEEN_WHOLE else hashlib.sha256(text.encode()).digest()


class _Segment:
    """Consecutive rows of a conversation in one partition."""

    def __init__(self, conv):
        self.conv, self.turns, self.roles, self.texts = conv, [], [], []

    def add(self, turn, role, text, copies):
        for _ in range(copies):
            self.turns.append(turn)
            self.roles.append(role)
            self.texts.append(text)

    def seen_before(self) -> list[bool]:
        seen, out = set(), []
        for role, text in zip(self.roles, self.texts):
            key = _key(role, text)
            out.append(key in seen)
            seen.add(key)
        return out


def _faults(roles, texts, repeated) -> tuple[list, int, int, int]:
    """Rows for the programme, and the counts of blank, duplicate and truncated ones."""
    out, counts = [], [0, 0, 0]
    for role, text, again in zip(roles, texts, repeated):
        end = text.rstrip(BLANK_CHARS)[-1:]
        fault = 0 if not end else 1 if again else 2 if end not in ".!?" else None
        if fault is not None:
            counts[fault] += 1
        out.append((role[:1], fault in (0, 1), fault == 2))
    return out, *counts


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _turn_span(turns) -> tuple:
    """(least, largest, distinct) of the turns that are not null."""
    known = [t for t in turns if t is not None]
    return (min(known), max(known), len(set(known))) if known else (None, None, 0)


_STATS = ("blank bigint, duplicate bigint, truncated bigint, illegal bigint")
_DONE = f"conv_id bigint, gaps bigint, {_STATS}, cost bigint, audit string, repaired string"
_SEG = f"seg int, {_DONE}, turns array<bigint>, roles array<string>, texts array<string>"
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(),
          "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
          "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _best_final(table: dict) -> tuple[int, Audit]:
    best = None
    for state in FINAL:
        found = table.get(state)
        if found and (best is None or found[0] < best[0]
                      or (found[0] == best[0] and audit_less(found[1], best[1]))):
            best = found
    return best


def _finished(s: _Segment, costs: Costs) -> tuple:
    rows, blank, again, cut = _faults(s.roles, s.texts, s.seen_before())
    cost, node = _best_final(cheapest(rows, START, costs, True))
    audit = node.text()
    low, high, distinct = _turn_span(s.turns)
    return (s.conv, high - low + 1 - distinct if distinct else 0, blank, again, cut,
            _illegal([r[0] for r in rows]), cost, audit,
            _text_of(repaired_rows(list(zip(s.roles, s.texts)), audit, START)))


def _cutter(costs: Costs, flush_chars: int = 4 << 20):
    """Sorted rows -> finished conversations (``seg`` null), and the first and last one of the partition as segments."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId()
        out, size, now, first = [], 0, None, True

        def segment(s):
            return (seg, s.conv, *(None,) * 8, s.turns, s.roles, s.texts)

        for b in batches:
            for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(segment(now) if first else
                                   (None, *_finished(now, costs), None, None, None))
                        first = False
                    now = _Segment(conv)
                now.add(turn, role, text, copies)
                size += len(text)
                if size > flush_chars and out:
                    yield _batch(out, _SEG)
                    out, size = [], 0
        if now is not None:
            out.append(segment(now))
        if out:
            yield _batch(out, _SEG)

    return cut


# Insertions that end a conversation from each state.
FINAL_TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

_TABLE = f"conv_id bigint, seg int, {_STATS}, first string, last string, low bigint, high bigint, turns bigint, " \
    "entries array<int>, exits array<int>, costs array<bigint>, audits array<string>"


def _segment_tables(costs: Costs):
    """Segments with their repeated rows known -> cost tables over (entry, exit), without texts. ``last`` letters
    (insertions at the very end) are added when segments are put together."""
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                again = set(r["repeated"] or ())
                rows, blank, dup, cut = _faults(r["roles"], r["texts"],
                                                [i in again for i in range(len(r["roles"]))])
                low, high, distinct = _turn_span(r["turns"])
                found = [(e, x, c, n.text()) for e in range(4)
                         for x, (c, n) in cheapest(rows, e, costs, False).items()]
                entries, exits, cost, audits = map(list, zip(*found))
                initials = [x[0] for x in rows]
                out.append((r["conv_id"], r["seg"], blank, dup, cut, _illegal(initials),
                            initials[0] if rows else None, initials[-1] if rows else None,
                            low, high, distinct, entries, exits, cost, audits))
            if out:
                yield _batch(out, _TABLE)

    return tables


_CHOSEN = f"conv_id bigint, gaps bigint, {_STATS}, cost bigint, audit string, segs array<int>, " \
    "entries array<int>, pieces array<string>, tail string"


def _composer(costs: Costs):
    """Cost tables of a conversation, in order -> totals, the audit, and each segment's part of it."""
    def finish(conv, parts):
        states = {START: (0, "", ())}  # state -> (cost, audit, entry states so far)
        for p in parts:
            after: dict = {}
            for e, x, c, a in zip(p["entries"], p["exits"], p["costs"], p["audits"]):
                if e in states:
                    new = (states[e][0] + c, states[e][1] + a, (*states[e][2], (e, a)))
                    if x not in after or new[:2] < after[x][:2]:
                        after[x] = new
            states = after
        best = None
        for state, (cost, audit, path) in states.items():
            letters = FINAL_TAIL[state]
            new = (cost + costs.insert * len(letters), audit + letters, path, letters)
            if best is None or new[:2] < best[:2]:
                best = new
        known = [p for p in parts if p["turns"]]
        distinct = sum(p["turns"] for p in known) - sum(
            a["high"] == b["low"] for a, b in zip(known, known[1:]))
        gaps = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
        filled = [p for p in parts if p["first"] is not None]
        illegal = sum(p["illegal"] for p in parts) + sum(
            _illegal([a["last"], b["first"]]) for a, b in zip(filled, filled[1:]))
        return (conv, gaps, *(sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated")),
                illegal, best[0], best[1], [p["seg"] for p in parts], [e for e, _ in best[2]],
                [a for _, a in best[2]], best[3])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if parts and r["conv_id"] != now:
                    out.append(finish(now, parts))
                    parts = []
                now = r["conv_id"]
                parts.append(r)
            if out:
                yield _batch(out, _CHOSEN)
        if parts:
            yield _batch([finish(now, parts)], _CHOSEN)

    return compose


def _rewriter():
    """Segments with their part of the audit -> the repaired text of each."""
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                rows = list(repaired_rows(list(zip(r["roles"], r["texts"])), r["piece"], r["entry"]))
                out.append((r["conv_id"], r["seg"], len(rows), _text_of(rows)))
            if out:
                yield _batch(out, "conv_id bigint, seg int, n bigint, repaired string")

    return rewrite


def _digester():
    """Repaired segments in order -> one SHA-256 a conversation, as a stream."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, some, begun = None, None, False, False
        for b in batches:
            out = []
            for r in b.to_pylist():
                if not begun or r["conv_id"] != now:
                    if begun:
                        out.append((now, sha.hexdigest()))
                    now, sha, some, begun = r["conv_id"], hashlib.sha256(), False, True
                if r["n"]:
                    sha.update((b"\n" if some else b"") + r["repaired"].encode())
                    some = True
            if out:
                yield _batch(out, "conv_id bigint, repaired_sha256 string")
        if begun:
            yield _batch([(now, sha.hexdigest())], "conv_id bigint, repaired_sha256 string")

    return digest


@dataclass
class Repair:
    """``whole``: conversations that one task saw (with their repaired text); ``spread``: those of several segments;
    ``pieces``: the latter's repaired text by segment (``conv_id, seg, n, repaired``; n rows)."""
    whole: DataFrame
    spread: DataFrame
    pieces: DataFrame


def repair(rows: DataFrame, costs: Costs = Costs()) -> Repair:
    """``rows``: ``conv_id, turn, role, text, copies``, as :func:`damaged` gives them."""
    ordered = (rows.select("conv_id", "turn", "role", "text", "copies")
               .repartitionByRange("conv_id", "turn", "role", "text")
               .sortWithinPartitions("conv_id", "turn", "role", "text"))
    segments = stored(ordered.mapInArrow(_cutter(costs), _SEG), "turn-segments")
    whole = segments.filter("seg IS NULL").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")
    parts = segments.filter("seg IS NOT NULL").select("conv_id", "seg", "turns", "roles", "texts")
    # Rows seen earlier: not the first of their (conversation, role, text).
    rows_of = parts.select("conv_id", "seg", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "r")).select(
        "conv_id", "seg", "at", F.struct("seg", "at").alias("place"), F.col("r.roles").alias("role"),
        F.sha2(F.col("r.texts"), 256).alias("sha"))
    firsts = (rows_of.groupBy("conv_id", "role", "sha")
              .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    a, b = rows_of.alias("a"), firsts.alias("b")
    repeated = (a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
                       & (F.col("a.role") == F.col("b.role")) & (F.col("a.sha") == F.col("b.sha")))
                .filter(F.col("a.place") > F.col("b.first"))
                .groupBy("a.conv_id", "a.seg").agg(F.collect_list("a.at").alias("repeated")))
    p, q = parts.alias("p"), repeated.alias("q")
    same = F.col("p.conv_id").eqNullSafe(F.col("q.conv_id")) & (F.col("p.seg") == F.col("q.seg"))
    known = p.join(q, same, "left").select("p.*", "q.repeated")
    tables = stored(known.mapInArrow(_segment_tables(costs), _TABLE), "turn-tables")
    chosen = stored(tables.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
                    .mapInArrow(_composer(costs), _CHOSEN), "turn-chosen")
    picked = chosen.select("conv_id", F.explode(F.arrays_zip("segs", "entries", "pieces")).alias("x")).select(
        "conv_id", F.col("x.segs").alias("seg"), F.col("x.entries").alias("entry"), F.col("x.pieces").alias("piece"))
    c = picked.alias("c")
    same = F.col("p.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("p.seg") == F.col("c.seg"))
    pieces = (parts.alias("p").join(c, same).select("p.conv_id", "p.seg", "p.roles", "p.texts", "c.entry", "c.piece")
              .mapInArrow(_rewriter(), "conv_id bigint, seg int, n bigint, repaired string"))
    tail = chosen.filter(F.length("tail") > 0).select(
        "conv_id", F.lit(2 ** 31 - 1).alias("seg"), F.length("tail").cast("bigint").alias("n"),
        F.when(F.col("tail") == "I", "assistant:").otherwise("user:\nassistant:").alias("repaired"))
    return Repair(whole, chosen.drop("segs", "entries", "pieces", "tail"), pieces.unionByName(tail))


def repair_digest(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``."""
    made = repair(rows, costs)
    shas = (made.pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
            .mapInArrow(_digester(), "conv_id bigint, repaired_sha256 string"))
    whole = made.whole.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")
    s, d = made.spread.alias("s"), shas.alias("d")
    spread = s.join(d, F.col("s.conv_id").eqNullSafe(F.col("d.conv_id"))).select("s.*", "d.repaired_sha256")
    return whole.unionByName(spread)
