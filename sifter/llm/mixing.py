"""Mixing sources to target weights, DataFrame operations only.

1. Tokens (words and an end mark) are summed per source; p is a source's share.
2. Weights are p ** a, normalised. The exponent a is bisected in [0, 1]: the
   largest one whose entropy is at least ``entropy_share`` of the highest
   possible, raised as far as the repetition limit (no source more than
   ``max_repeats`` times) needs. Each bisection job sums p ** a over the sources for
   15 exponents at once, four halvings in one pass.
3. A source's quota, its weight of the budget, is realised in blocks. Every full
   block is a permutation of all its documents; the last block is the start
   of a permutation, as many documents as fit the rest of the quota. The permutation
   is the order of a hash, so the last block is all hashes up to a threshold.
   The threshold comes from running sums on three levels (groups of
   buckets, buckets, the rows of one bucket), so no source is ordered in one task.
4. One pass over the documents emits a row per block. ``place`` in [0, 1) orders the
   mixture: each source's blocks follow one another, spread evenly over it.

The budget is ``budget_tokens``, or the table's own number of tokens; with
``lossless`` it is the smallest budget at which every source fills a block or more, so
no document is left out. Leaving documents of a large source out of a smaller quota
is the operator's purpose.

Defined results: a null source counts as the source with an empty name; null
text counts as empty (one token); repeated rows are documents of their own and fall
on the same side of a threshold; equal hashes stand together; an empty table gives an
empty result; one source alone gets weight 1. If the limit cannot be met by any
exponent, the proportional mixture (a = 1) is used and its budget cut to the limit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sifter.llm.common import WORD_RE, stored

ENTROPY_SHARE = 0.95
MAX_REPEATS = 4.0
SEED = 20240501
BUCKET_ROWS = 5_000      # rows a threshold bucket should hold
GROUP_BUCKETS = 1_000    # buckets summed together
BROADCAST_SOURCES = 10_000
_GRID, _ROUNDS = 15, 8


@dataclass(frozen=True)
class Mixture:
    exponent: float
    budget: int
    sources: DataFrame  # s, n_docs, n_tokens, weight, quota, blocks, rest


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"),
        _hash(F.lit(seed), F.col(id_col).cast("bigint"), text).alias("u"), text.alias("text"))


def _hash(*cols: Column) -> Column:
    """63 uniform bits."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def _uniform(u: Column) -> Column:
    """[0, 1) from 53 of the bits."""
    return F.shiftrightunsigned(u, 10).cast("double") / float(2 ** 53)


def _evaluate(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(sum of p ** a, sum of p ** a * ln p) for each exponent."""
    cols = []
    for i, a in enumerate(exponents):
        power = F.pow("p", F.lit(a))
        cols += [F.sum(power).alias(f"z{i}"), F.sum(power * F.ln("p")).alias(f"s{i}")]
    r = shares.agg(*cols).first()
    return [(r[f"z{i}"], r[f"s{i}"]) for i in range(len(exponents))]


def solve_exponent(shares: DataFrame, entropy_share: float, max_repeats: float,
                   budget_ratio: float | None) -> tuple[float, float]:
    """(exponent, sum of p ** exponent) for a stored table with column ``p``.
    ``budget_ratio``: budget over all tokens, or None for a lossless one."""
    ends = shares.agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("lo"),
                      F.max("p").alias("hi")).first()
    target = entropy_share * math.log(ends["n"]) if ends["n"] > 1 else 0.0

    def entropy_met(a: float, z: float, s: float) -> bool:
        return math.log(z) - a * s / z >= target - 1e-12

    def limit_met(a: float, z: float, s: float) -> bool:
        if budget_ratio is None:
            return (ends["hi"] / ends["lo"]) ** (1 - a) <= max_repeats * (1 + 1e-12)
        return budget_ratio * ends["lo"] ** (a - 1) / z <= max_repeats * (1 + 1e-12)

    # Both conditions are monotone: entropy falls with a, repetition falls too.
    entropy, limit = (0.0, 1.0), (0.0, 1.0)
    for _ in range(_ROUNDS):
        grid = [lo + (hi - lo) * (i + 1) / (_GRID + 1) for lo, hi in (entropy, limit)
                for i in range(_GRID)]
        found = list(zip(grid, _evaluate(shares, grid)))
        for a, (z, s) in found[:_GRID]:
            entropy = (max(entropy[0], a), entropy[1]) if entropy_met(a, z, s) else (
                entropy[0], min(entropy[1], a))
        for a, (z, s) in found[_GRID:]:
            limit = (limit[0], min(limit[1], a)) if limit_met(a, z, s) else (
                max(limit[0], a), limit[1])
    ends_met = _evaluate(shares, [0.0, 1.0])
    by_entropy = 1.0 if entropy_met(1.0, *ends_met[1]) else entropy[0]
    by_limit = 0.0 if limit_met(0.0, *ends_met[0]) else limit[1]
    a = round(max(by_entropy, by_limit), 6)
    return a, _evaluate(shares, [a])[0][0]


def _thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``s, last``: largest hash of the last block (-1: the last block is empty)."""
    rows = (rows.join(sources.select("s", "rest", "n_docs").filter("rest > 0"), "s")
            .withColumn("buckets", F.ceil(F.col("n_docs") / BUCKET_ROWS))
            .withColumn("bucket", F.floor(_uniform(F.col("u")) * F.col("buckets"))))
    sums = (rows.groupBy("s", "rest", "bucket").agg(F.sum("tokens").alias("t"))
            .withColumn("grp", F.floor(F.col("bucket") / GROUP_BUCKETS)))
    sums = stored(sums, "mix-buckets")
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(
        Window.unboundedPreceding, -1)
    groups = (sums.groupBy("s", "grp").agg(F.sum("t").alias("t"))
              .select("s", "grp", F.coalesce(F.sum("t").over(before("s", "grp")),
                                             F.lit(0)).alias("g0")))
    cut = (sums.withColumn("b0", F.coalesce(F.sum("t").over(before("s", "grp", "bucket")),
                                            F.lit(0)))
           .join(groups, ["s", "grp"])
           .withColumn("left", F.col("rest") - F.col("g0") - F.col("b0"))
           .filter((F.col("left") >= 0) & (F.col("left") < F.col("t")))
           .select("s", "bucket", "left"))
    inside = rows.join(cut, ["s", "bucket"]).withColumn(
        "run", F.sum("tokens").over(Window.partitionBy("s", "bucket").orderBy("u")
                                    .rangeBetween(Window.unboundedPreceding, 0)))
    # Nothing of the cut bucket fits: every hash of the buckets below it does.
    floor = (F.floor(F.col("bucket") / F.col("buckets") * F.lit(float(2 ** 53)))
             .cast("bigint") * 1024 - 1)
    last = inside.groupBy("s").agg(
        F.coalesce(F.max(F.when(F.col("run") <= F.col("left"), F.col("u"))),
                   F.max(F.when(F.col("bucket") > 0, floor).otherwise(F.lit(-1)))).alias("last"))
    return last


def plan_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source", entropy_share: float = ENTROPY_SHARE,
                 max_repeats: float = MAX_REPEATS, budget_tokens: int | None = None,
                 lossless: bool = False, seed: int = SEED) -> Mixture | None:
    """Weights, quotas and thresholds by source; None for an empty table."""
    rows = stored(_keyed(docs, id_col, text_col, source_col, seed).select(
        "s", "u", (F.regexp_count("text", F.lit(WORD_RE)) + 1).cast("bigint").alias("tokens")),
        "mix-rows")
    totals = stored(rows.groupBy("s").agg(F.count(F.lit(1)).alias("n_docs"),
                                          F.sum("tokens").alias("n_tokens")), "mix-sources")
    total = totals.agg(F.sum("n_tokens")).first()[0]
    if total is None:
        return None
    shares = stored(totals.withColumn("p", F.col("n_tokens") / F.lit(float(total))), "mix-shares")
    asked = None if lossless else (budget_tokens or total)
    a, z = solve_exponent(shares, entropy_share, max_repeats,
                          None if lossless else asked / total)
    high = shares.agg(F.max("p")).first()[0]
    budget = math.ceil(total * high ** (1 - a) * z - 1e-6) if lossless else asked
    budget = min(budget, math.floor(total * max_repeats))
    weighted = shares.withColumn("weight", F.pow("p", F.lit(a)) / F.lit(z))
    quota = F.round(F.col("weight") * F.lit(float(budget))).cast("bigint")
    if lossless:  # rounding must not take a document from the largest source
        quota = F.greatest(quota, F.col("n_tokens"))
    weighted = stored(weighted.withColumn("quota", quota)
                      .withColumn("blocks", F.expr("quota div n_tokens"))
                      .withColumn("rest", F.expr("quota % n_tokens")), "mix-weights")
    sources = stored(weighted.join(_thresholds(rows, weighted), "s", "left")
                     .withColumn("last", F.coalesce("last", F.lit(-1))), "mix-plan")
    return Mixture(a, budget, sources)


def _emitted(docs: DataFrame, plan: Mixture, id_col: str, text_col: str, source_col: str,
             seed: int) -> DataFrame:
    """``row, s, block, place``: one row per document and block."""
    sources = plan.sources.select("s", "blocks", "last", "quota", "n_tokens")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)  # checked: a few hundred kilobytes at most
    taken = F.col("blocks") + F.when(F.col("u") <= F.col("last"), 1).otherwise(0)
    rows = (_keyed(docs, id_col, text_col, source_col, seed).join(sources, "s")
            .select("row", "s", "u", "blocks", "quota", "n_tokens", taken.alias("taken"))
            .filter("taken > 0")
            .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("taken") - 1))
                    .alias("block")))
    # The last block's order is the one its threshold cuts.
    turn = F.when(F.col("block") == F.col("blocks"), F.col("u")).otherwise(
        _hash(F.lit(seed), "block", "u"))
    place = (F.col("block") + _uniform(turn)) * F.col("n_tokens") / F.col("quota")
    return rows.select("row", "s", F.col("block").cast("int").alias("block"),
                       F.least(place, F.lit(1 - 2.0 ** -53)).alias("place"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", **options) -> DataFrame:
    """``doc_id, source, block, place``, one row per document and block; options
    as for ``plan_mixture``."""
    plan = plan_mixture(docs, id_col, text_col, source_col, **options)
    if plan is None:
        return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                           F.lit("").alias("source"), F.lit(0).alias("block"),
                           F.lit(0.0).alias("place"))
    out = _emitted(docs, plan, id_col, text_col, source_col, options.get("seed", SEED))
    return out.select(F.col(f"row.`{id_col}`").cast("bigint").alias("doc_id"),
                      F.col("s").alias("source"), "block", "place")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", **options) -> DataFrame:
    """The mixture as rows of ``docs``: a document stands once per block."""
    plan = plan_mixture(docs, id_col, text_col, source_col, **options)
    if plan is None:
        return docs
    return _emitted(docs, plan, id_col, text_col, source_col,
                    options.get("seed", SEED)).select("row.*")
