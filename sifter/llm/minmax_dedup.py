"""Near duplicates by min-max hashing, confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct ``width``-word shingles
(A-Z lower-cased); a shorter text is one shingle, a text without words is the
empty set and links with nothing. Documents link when 100 * intersection >=
``percent`` * union.

1. *Signature.* Each permutation keeps both its minimum and its maximum, so
   ``BANDS * ROWS`` values cost half as many hash evaluations. A band hashes
   ``ROWS`` values; at a similarity of 0.85 two sets share none of the 24 bands with
   probability 8e-7.
2. *Classes.* Equal sets (count and 128-bit digest) become one class with one
   representative; copies are never paired.
3. *Star round.* A bucket's members are compared with one leader, the member
   with the most bucket mates over all bands (the centre of its copies). Links are
   confirmed on the full sets; connected components follow. Pairs already
   in one component add nothing and are not made.
4. *Remainder.* For the sets in buckets that still mix components, an exact prefix join
   finds every link between components: with shingles ordered rarest first, two sets over the
   threshold share one of their first n - ceil(percent * n / 100) + 1, and from
   its places in both sets follows how large the intersection can be at most. Holders
   of a shingle meet as kinds (component, size, place), and only kinds that pass expand to
   pairs, which are confirmed on the full sets.

The rows between steps are stored in the shared folder. Hot buckets are joined, never
gathered: counts and leaders are aggregates, and Spark splits skewed joins.

Rows go by a key of their id and a hash of their text, so that rows without an id stay apart.

Defined results: null text counts as empty; a null ``doc_id`` ranks behind every
other id, so a component is named null only if it holds no id; rows without an id are documents of their own;
repeated rows are copies with one result; rows that
share an id are taken for one document when components form; an empty table gives an
empty result; long texts are hashed in blocks. Only the id and text columns are read (:func:`near_dedup` carries
whole rows as one value), so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sifter.llm.common import WordHashes, kept, mix64, prefiltered, stored, tidy

WIDTH = 3
PERCENT = 85
BANDS, ROWS = 24, 5
NULL_ID = 2 ** 63 - 1  # ranks behind every other id
KEY = "struct<id:bigint,h:bigint>"
_BLOCK = 8192
WORDS_KEPT = 200_000   # hashes of words that a worker keeps


def shingles(text: bytes, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    w = words.of(text.lower().split())
    if len(w) == 0:
        return w
    size = min(width, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h = mix64(h + w[j:j + len(h)])
    return np.unique(h)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240501).integers(0, 2 ** 63, (2, n), dtype=np.int64)
    draw = draw.view(np.uint64)
    return (draw[0] * np.uint64(2) + np.uint64(1))[:, None], (draw[1] * np.uint64(2))[:, None]


def min_max(values: np.ndarray, multiply: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """All minima, then all maxima, of the permuted values."""
    low = np.full(len(multiply), 2 ** 64 - 1, np.uint64)
    high = np.zeros(len(multiply), np.uint64)
    for at in range(0, len(values), _BLOCK):
        p = (values[None, at:at + _BLOCK] ^ flip) * multiply
        np.minimum(low, p.min(axis=1), out=low)
        np.maximum(high, p.max(axis=1), out=high)
    return np.concatenate([low, high])


def _signer(width: int, bands: int, rows: int):
    multiply, flip = _permutations(bands * rows // 2)
    number = np.arange(bands, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept("words", lambda: WordHashes(WORDS_KEPT))
        for b in batches:
            n, d1, d2, keys = [], [], [], []
            for text in b.column("text").cast(pa.binary()):
                s = shingles(text.as_py() or b"", width, words)
                n.append(len(s))
                d1.append(int(mix64(s ^ np.uint64(0x51ED27)).sum(dtype=np.uint64)))
                d2.append(int(mix64(s + np.uint64(0x7A3B91)).sum(dtype=np.uint64)))
                if len(s):
                    values = min_max(s, multiply, flip).reshape(bands, rows)
                    k = number
                    for j in range(rows):
                        k = mix64(k + values[:, j])
                    keys.append(k)
            sizes = np.where(np.array(n) > 0, bands, 0)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), pa.array(n, pa.int64()),
                 pa.array(np.array(d1, np.uint64).view(np.int64)),
                 pa.array(np.array(d2, np.uint64).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))],
                names=["k", "n", "d1", "d2", "bands"])

    return tidy(sign)


def _setter(width: int):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept("words", lambda: WordHashes(WORDS_KEPT))
        for b in batches:
            sets = [shingles(t.as_py() or b"", width, words).view(np.int64)
                    for t in b.column("text").cast(pa.binary())]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["k", "shingles"])

    return tidy(collect)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node points to one centre and no centre points on."""
    roles = (edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
             .unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"),
                                       F.lit(1).alias("into"))))
    return (roles.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
            .filter("out > 1 or (out = 1 and into = 1)").isEmpty())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of the pairs
    ``a, b``: alternate large-star and small-star steps until only stars are left."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a <> b").distinct(), "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = (both.filter("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a"))
                                             .otherwise(F.col("b")).alias("a"),
                                             F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        edges = stored(small, "edges")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold."""
    one = sets.select(F.col("k").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("k").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).alias("common")
    total = (F.size("sa") + F.size("sb")).alias("total")
    return (pairs.join(one, "a").join(two, "b").select("a", "b", common, total)
            .filter(100 * F.col("common") >= percent * (F.col("total") - F.col("common")))
            .select("a", "b"))


def _size_fits(percent: int):
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b``: every member of a bucket with the bucket's leader."""
    top = members.groupBy("band", "key").agg(F.max("score").alias("score"))
    leader = (members.join(top, ["band", "key", "score"]).groupBy("band", "key")
              .agg(F.min("k").alias("b")))
    size = members.select(F.col("k").alias("b"), F.col("n").alias("nb")).distinct()
    return (members.withColumnsRenamed({"k": "a", "n": "na"})
            .join(leader.join(size, "b"), ["band", "key"])
            .filter((F.col("a") != F.col("b")) & _size_fits(percent)).select("a", "b").distinct())


def links_between(reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links ``a, b`` that connect every component of the class
    representatives ``k, n, bands``; ``texts`` has ``k, text``."""
    slots = stored(reps.select("k", "n", F.posexplode("bands").alias("band", "key")), "bands")
    shared = (slots.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"))
              .filter("size > 1"))
    members = stored(slots.join(shared, ["band", "key"]), "members")
    score = members.groupBy("k").agg(F.sum("size").alias("score"))
    members = stored(members.drop("size").join(score, "k"), "members")
    wanted = members.select("k").distinct()
    # Only the texts of candidates are moved to the exact join.
    sets = stored(prefiltered(texts, wanted, "k").join(wanted, "k")
                  .mapInArrow(_setter(width), f"k {KEY}, shingles array<bigint>")
                  .dropDuplicates(["k"]), "sets")
    links = stored(_confirmed(_star_pairs(members, percent), sets, percent), "links")
    found = components(links).withColumnsRenamed({"node": "k", "component": "found"})
    members = (members.join(found, "k", "left")
               .select("k", "n", "band", "key", F.coalesce("found", "k").alias("label")))
    return links.unionByName(_remainder(members, sets, percent))


def _remainder(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every link between the components that buckets still mix, by an exact
    prefix join."""
    members = stored(members, "members")
    mixed = (members.groupBy("band", "key")
             .agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .filter("lo <> hi").select("band", "key"))
    open_ = stored(members.join(mixed, ["band", "key"]).select("k", "n", "label").distinct(), "open")
    held = stored(sets.join(open_, "k").select("k", "n", "label", F.explode("shingles").alias("s")),
                  "held")
    common = held.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = Window.partitionBy("k")
    held = (held.join(common, "s").withColumn("n_common", F.count(F.lit(1)).over(own))
            .withColumn("rank", F.row_number().over(own.orderBy("df", "s")))
            # Rare first: shingles that no other open set holds stand before all others.
            .withColumn("place", F.col("n") - F.col("n_common") + F.col("rank"))
            .filter(F.col("place") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1))
    prefix = stored(held.select("s", "k", "n", "label", "place"), "prefix")
    # Kinds of holders (component, size, place) meet before the holders do.
    kinds = prefix.select("s", "label", "n", "place").distinct()
    mixed = (kinds.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .filter("lo <> hi").select("s"))
    kinds = kinds.join(mixed, "s")
    one = kinds.select("s", F.col("label").alias("la"), F.col("n").alias("na"), F.col("place").alias("pa"))
    two = kinds.select("s", F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    most = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    # common >= percent / 100 * (na + nb - common)
    fits = (100 + percent) * most >= percent * (F.col("na") + F.col("nb"))
    kinds = one.join(two, "s").filter((F.col("la") < F.col("lb")) & _size_fits(percent) & fits)
    a = prefix.select("s", F.col("k").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"),
                      F.col("place").alias("pa"))
    b = prefix.select("s", F.col("k").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"),
                      F.col("place").alias("pb"))
    pairs = (stored(kinds, "kinds").join(a, ["s", "la", "na", "pa"]).join(b, ["s", "lb", "nb", "pb"])
             .select("a", "b").distinct())
    return stored(_confirmed(pairs, sets, percent), "links")


def _key(id_col: str, text_col: str):
    """Key of a row: its id (the largest number without one), and a hash of its text."""
    return F.struct(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("id"),
                    F.xxhash64(F.col(text_col)).alias("h")).alias("k")


def _judged(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int,
            bands: int, rows: int) -> DataFrame:
    """``k, n, c, kept`` per input row: its key, its shingles, its component's smallest key."""
    if bands * rows % 2:
        raise ValueError("bands * rows must be even: each permutation gives two values")
    texts = docs.select(_key(id_col, text_col), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_signer(width, bands, rows),
                                     f"k {KEY}, n bigint, d1 bigint, d2 bigint, "
                                     "bands array<bigint>"), "signatures")
    full = signed.filter("n > 0")
    classes = full.groupBy("n", "d1", "d2").agg(F.min("k").alias("rep"))
    rows_ = stored(full.select("k", "n", "d1", "d2").join(classes, ["n", "d1", "d2"])
                   .select("k", "n", "rep"), "classes")
    reps = (full.join(classes.select(F.col("rep").alias("k"), "n", "d1", "d2"),
                      ["k", "n", "d1", "d2"], "left_semi")
            .dropDuplicates(["k"]).select("k", "n", "bands"))
    links = links_between(reps, texts, width, percent)
    named = rows_.filter(F.col("k.id") != NULL_ID).select(F.col("k.id").alias("id"), "rep")
    first = named.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    one_id = named.join(first, "id").select(F.col("rep").alias("a"), F.col("lo").alias("b"))
    found = components(links.unionByName(one_id)).withColumnRenamed("node", "rep")
    out = (rows_.join(found, "rep", "left").select("k", "n", F.coalesce("component", "rep").alias("c"))
           .unionByName(signed.filter("n = 0").select("k", "n", F.col("k").alias("c"))))
    same_id = (F.col("k.id") == F.col("c.id")) & (F.col("k.id") != NULL_ID)
    return out.withColumn("kept", same_id | (F.col("k") == F.col("c")))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = WIDTH, percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row."""
    back = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return _judged(docs, id_col, text_col, width, percent, bands, rows).select(
        back("k.id").alias("doc_id"), F.col("n").alias("n_shingles"),
        back("c.id").alias("component_id"), "kept")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               width: int = WIDTH, percent: int = PERCENT,
               bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` (all their columns) that stay: one document per component."""
    keep = _judged(docs, id_col, text_col, width, percent, bands, rows).filter("kept").select("k")
    whole = docs.select(_key(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.join(keep, "k", "left_semi").select("row.*")
