"""Exact duplicates through an extendible-hash index on shared files.

Texts are equal when their bytes are, after lower-casing A-Z only. DataFrame
operations only:

1. *Entries.* Rows are grouped by (64-bit hash, text). Map tasks combine equal
   texts first, so a text held by a third of all rows leaves each task once.
   Grouping on the text compares bytes; different texts with one hash stay
   apart and form a chain under that hash, numbered in text order.
2. *Directory.* A slot of depth d holds the hashes with the same top d bits. As long
   as one bucket holds more than ``capacity`` entries under two hashes or more, the
   directory doubles: full buckets split on the next bit, the others keep
   their local depth. (Entries of one hash cannot be split: they are a chain.)
3. *Index files.* Every entry goes to the bucket that the directory names for its hash; owner tasks
   hold whole buckets and write them to the shared folder.
4. *Probe.* A row's hash is looked up in the directory, and the row meets the chain of its hash in that bucket.
   A chain of one entry is the row's own (its texts were compared when it was built); in a longer one the row's text
   is compared with the entries' texts. The few entries that hold a thousandth of the rows or more
   are broadcast, so their rows do not meet in one task.

Defined results: null text counts as empty; a null ``doc_id`` never beats
another id (a group with null ids only keeps null); repeated rows count each;
a row is kept when its id is the group's largest, so identical ids stay together;
an empty table gives an empty result; a text of any length is one value of one row and is hashed and
compared whole in one task. Only the id and text columns are read,
so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import ascii_lower, prefiltered, stored

CAPACITY = 50_000
MAX_DEPTH = 60
LARGE_SHARE = 1000  # entries with this part of the rows are broadcast: there are at most so many
NULL_ID = -(2 ** 63)  # a null id ranks below every other


def _keyed(docs: DataFrame, id_col: str, text_col: str, hash_bits: int) -> DataFrame:
    norm = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    h = F.xxhash64("norm")
    if hash_bits < 64:  # fewer bits make collisions, for tests
        h = F.shiftleft(h, 64 - hash_bits)
    return norm.select("doc_id", "norm", h.alias("h"))


def _slot(depth) -> F.Column:
    """Top ``depth`` bits of the hash (0 for depth 0)."""
    return F.shiftrightunsigned(F.shiftrightunsigned("h", 1), 63 - depth)


def build_entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  hash_bits: int = 64) -> DataFrame:
    """Step 1: one row per distinct text: ``h, text_sha256, keep_id, group_size``."""
    found = (_keyed(docs, id_col, text_col, hash_bits).groupBy("h", "norm")
             .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return stored(found.select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"),
                  "exact-entries")


def directory(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Step 2: the leaves ``depth, slot, entries, chains``, one row per bucket."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")

    def buckets(depth: int, within: DataFrame | None) -> DataFrame:
        rows = entries.select("h")
        if within is not None:
            rows = rows.join(within.select(F.col("slot").alias("_up")),
                             _slot(depth - 1) == F.col("_up"), "left_semi")
        return stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
                      .groupBy(_slot(depth).alias("slot"))
                      .agg(F.sum("n").alias("entries"), F.count(F.lit(1)).alias("chains"))
                      .select(F.lit(depth).alias("depth"), "slot", "entries", "chains"),
                      "exact-directory")

    full = (F.col("entries") > capacity) & (F.col("chains") > 1)
    depth, leaves, level = 0, [], buckets(0, None)
    while depth < MAX_DEPTH and not level.filter(full).isEmpty():
        leaves.append(level.filter(~full))
        depth += 1
        level = buckets(depth, level.filter(full))
    out = level
    for leaf in leaves:
        out = out.unionByName(leaf)
    return out


def with_bucket(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` (with ``h``) and the ``bucket_depth, bucket`` that own them, one look-up a depth: a hash lies in one
    leaf. The leaves are a row per ``capacity`` entries, so Spark chooses how to join them."""
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())  # at most 61 rows
    parts = []
    for d in depths:
        own = leaves.filter(F.col("depth") == d).select(F.col("slot").alias("bucket"))
        parts.append(rows.withColumn("bucket", _slot(d)).join(own, "bucket", "left_semi")
                     .withColumn("bucket_depth", F.lit(d)))
    if not parts:
        return rows.withColumn("bucket", F.lit(0).cast("bigint")).withColumn("bucket_depth", F.lit(0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_index(entries: DataFrame, leaves: DataFrame) -> DataFrame:
    """Step 3: the entries in their buckets, whole buckets in one file, chains in hash order."""
    owned = with_bucket(entries, leaves)
    return stored(owned.repartition("bucket_depth", "bucket")
                  .sortWithinPartitions("bucket_depth", "bucket", "h"), "exact-index")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256,
    bucket_depth, bucket`` (the directory's leaf that owns the text)."""
    entries = build_entries(docs, id_col, text_col, hash_bits)
    leaves = directory(entries, capacity)
    index = build_index(entries, leaves)
    keyed = _keyed(docs, id_col, text_col, hash_bits)
    rows = stored(with_bucket(keyed.select("doc_id", "h"), leaves), "exact-rows")
    key, found = ["bucket_depth", "bucket", "h"], ["keep_id", "group_size", "text_sha256"]
    chained = stored(index.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "exact-chains")
    single = index.join(chained, "h", "left_anti").select(*key, *found)
    large = F.col("group_size") * LARGE_SHARE >= F.lit(rows.count())
    # At most LARGE_SHARE entries can hold that share of the rows.
    met = rows.join(F.broadcast(single.filter(large)), key, "left")
    out = (met.filter("group_size is not null").select("doc_id", *key, *found)
           .unionByName(met.filter("group_size is null").select("doc_id", *key)
                        .join(single.filter(~large), key).select("doc_id", *key, *found)))
    if not chained.isEmpty():
        # Only rows whose hash has a chain are compared, by their text.
        some = with_bucket(prefiltered(keyed, chained, "h").join(chained, "h"), leaves)
        texts = some.select("h", "norm").distinct().withColumn("text_sha256", F.sha2("norm", 256))
        chains = index.join(texts, ["h", "text_sha256"]).select(*key, "norm", *found)
        out = out.unionByName(some.join(chains, [*key, "norm"]).select("doc_id", *key, *found))
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256", "bucket_depth", "bucket")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` (all their columns) that stay: of equal texts the one
    with the largest id; of repeated rows with that id, one."""
    keep = (exact_groups(docs, id_col, text_col, capacity).filter("kept")
            .select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"),
                    F.col("text_sha256").alias("sha")))
    # The whole row travels as one struct, so no column name can clash, and
    # the join's partitioning serves the removal of repeated rows as well.
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("k"),
        F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256).alias("sha"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return (rows.join(keep, ["k", "sha"], "left_semi").dropDuplicates(["k", "sha"])
            .select("row.*"))
