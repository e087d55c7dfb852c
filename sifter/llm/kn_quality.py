"""Text quality by an interpolated modified Kneser-Ney n-gram model.

The model reads characters (white space runs count as one blank) in n-grams of
``ORDER``, trained on trusted text: all documents labelled good and not toxic, whole,
but for the fifth of their ids that sets the limits.

*Counts.* Tasks count the highest order of their documents; the totals, and from
them the continuation counts of every lower order (how many different characters
stand before an n-gram), are grouped by n-gram in Spark. The three discounts of each
order come from its counts of counts; a context's total and its numbers of n-grams
seen once, twice and more often are joined to the n-grams on the context, the next lower order
on the rest of the n-gram. All tables stay in Spark, partitioned (sharded) by n-gram or context;
an n-gram's key is its characters, 21 bits each in two numbers.

*Scores.* The most frequent n-grams of the highest order, at most ``CACHED``, are shipped to the
tasks with the losses (negative logarithms in whole 1 / ``UNIT``) that the join would give. The n-grams of a document
that are not among them are listed with it, counted; their distinct n-grams are joined with the sharded tables, highest
order first, and the losses summed by document. So the shipped table only
saves rows of that join and does not change a result. Only the texts of trusted documents are moved
(a filter of fixed size stands before the join that finds them).

*Threshold.* Perplexities of all trusted documents that the model was not trained on (a
fifth of the trusted ids never is) give a quantile per language;
``TOLERANCE`` times that quantile is the limit. Short texts are noisy: the compared value is
shrunk towards the language's trusted mean, as if ``PRIOR_CHARS`` average characters were added.

The alphabet is every code point of the trusted text.

Defined results: null or empty text has no characters, perplexity null, and is not
kept; a null language is a language of its own; languages without trusted documents use
the quantile of all trusted documents; without any trusted document every document with
text is kept; repeated rows get equal results and are each counted in training (logarithms are added as whole numbers of
1 / ``UNIT``); ties with the limit are kept; an empty table gives an empty result; one text of any
length is counted and looked up whole in one task. Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import BLANKS, mix64, prefiltered, slices, stored
from sifter.plans.sizing import bounded_broadcast

ORDER = 5
CACHED = 1_000_000
QUANTILE = 0.99
TOLERANCE = 1.05
PRIOR_CHARS = 100.0
SLICE_BYTES = 2_000_000
BITS, UNIT = 21, 2 ** 24
START = 0  # character numbers: code point + 1


class GramTable:
    """n-gram key -> loss in an open hash table of arrays."""

    def __init__(self, keys: np.ndarray, loss: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(len(keys) * 2 + 1))))
        self.mask = np.int64(2 ** bits - 1)
        self.keys = np.full(2 ** bits, -1, np.int64)
        self.loss = np.zeros(2 ** bits + 1, np.int64)  # the last: not found
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]  # of several, the last stays
            done = self.keys[slot] == keys[left]
            self.loss[slot[done]] = loss[left[done]]
            left, slot = left[~done], (slot[~done] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return mix64(keys.view(np.uint64)).view(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; one past the end where it is missing."""
        slot = self._slot(keys)
        at = self.keys[slot]
        open_ = np.flatnonzero((at != keys) & (at != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            at[open_] = self.keys[slot[open_]]
            open_ = open_[(at[open_] != keys[open_]) & (at[open_] != -1)]
        slot[at == -1] = len(self.keys)
        return slot


@dataclass(frozen=True)
class KneserNey:
    order: int
    alphabet: np.ndarray  # code points, sorted
    probabilities: list   # per order, 1 first: DataFrame hi, lo, p
    weights: list         # per order, 2 first: DataFrame hi, lo (of the context), w
    unseen: float         # probability of a character that the model has not seen
    cached: GramTable     # the most frequent n-grams of the highest order


def _characters(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Character numbers of the texts, each after order - 1 starts; lengths."""
    clean = [" ".join(t.split()) for t in texts]
    lengths = np.array([len(t) for t in clean], np.int64)
    points = np.frombuffer("".join(clean).encode("utf-32-le"), np.uint32)
    pad = order - 1
    out = np.full(len(points) + pad * len(texts), START, np.int64)
    out[np.arange(len(points)) + pad * (np.repeat(np.arange(len(texts)), lengths) + 1)] = points.astype(np.int64) + 1
    return out, lengths


def _keys(numbers: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Key ``hi, lo`` of the n-gram that ends at each position: ``BITS`` a character,
    the last three in ``lo``."""
    hi, lo = np.zeros(len(at), np.int64), numbers[at]
    for j in range(1, order):
        part = hi if j > 2 else lo
        part |= numbers[at - j] << np.int64(BITS * (j % 3))
    return hi, lo


def _slots(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A 63-bit hash of keys, for the table of cached n-grams."""
    h = mix64(hi.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (mix64(h ^ lo.view(np.uint64)) >> np.uint64(1)).view(np.int64)


def _counted(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, sorted by the first, the next, ..., and how often each stands."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns], np.diff(np.append(starts, len(order)))


def _ends(lengths: np.ndarray, order: int) -> np.ndarray:
    """Positions of real characters in the padded numbers."""
    return np.arange(int(lengths.sum())) + (order - 1) * (np.repeat(np.arange(len(lengths)), lengths) + 1)


def _gram_counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column("text"), SLICE_BYTES):
                numbers, lengths = _characters(b.column("text").slice(lo, hi - lo).to_pylist(), order)
                (high, low), n = _counted(*_keys(numbers, _ends(lengths, order), order))
                yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.array(n)],
                                                 names=["hi", "lo", "c"])

    return count


def _context(hi="hi", lo="lo") -> list:
    """Key of an n-gram without its last character."""
    return [F.shiftright(hi, BITS).alias("xh"),
            F.shiftright(lo, BITS).bitwiseOR(
                F.shiftleft(F.col(hi).bitwiseAND(2 ** BITS - 1), 2 * BITS)).alias("xl")]


def _rest(order: int) -> list:
    """Key of an n-gram of ``order`` without its first character."""
    return [F.col("hi").bitwiseAND(2 ** (BITS * max(0, order - 4)) - 1).alias("rh"),
            F.col("lo").bitwiseAND(2 ** (BITS * min(3, order - 1)) - 1).alias("rl")]


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts (Chen and Goodman)."""
    r = counts.agg(*[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(1, r[f"n{i}"]) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(i - 0.05, max(0.05, i - (i + 1) * y * b / a))
                 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def train(trusted: DataFrame, order: int = ORDER) -> KneserNey | None:
    """Fit the model on all texts of ``trusted`` (column ``text``); None if they
    have no characters."""
    texts = trusted.select("text").filter(F.length(F.btrim("text", F.lit(BLANKS))) > 0)
    counts = {order: stored(texts.mapInArrow(_gram_counter(order),
                                             "hi bigint, lo bigint, c bigint")
                            .groupBy("hi", "lo").agg(F.sum("c").alias("c")), "grams")}
    for k in range(order, 1, -1):
        counts[k - 1] = stored(counts[k].select(*_rest(k)).groupBy(F.col("rh").alias("hi"), F.col("rl").alias("lo"))
                               .agg(F.count(F.lit(1)).alias("c")), "grams")
    n, seen = counts[1].agg(F.sum("c"), F.count(F.lit(1))).first()
    if not seen:
        return None
    alphabet = np.array(sorted(r["lo"] - 1 for r in counts[1].select("lo").collect()), np.uint32)
    # Half a count more for every character, and half for those not seen.
    mass = n + 0.5 * (seen + 1)
    probabilities = [stored(counts[1].select("hi", "lo", ((F.col("c") + 0.5) / mass).alias("p")), "model")]
    weights = []
    for k in range(2, order + 1):
        d1, d2, d3 = _discounts(counts[k])
        grams = counts[k].select("hi", "lo", "c", *_context(), *_rest(k))
        contexts = stored(grams.groupBy("xh", "xl").agg(
            F.sum("c").alias("total"), F.count(F.when(F.col("c") == 1, 1)).alias("a1"),
            F.count(F.when(F.col("c") == 2, 1)).alias("a2"),
            F.count(F.when(F.col("c") > 2, 1)).alias("a3"))
            .select("xh", "xl", "total", ((d1 * F.col("a1") + d2 * F.col("a2") + d3 * F.col("a3"))
                                          / F.col("total")).alias("w")), "contexts")
        weights.append(contexts.select(F.col("xh").alias("hi"), F.col("xl").alias("lo"), "w"))
        lower = probabilities[-1].select(F.col("hi").alias("rh"), F.col("lo").alias("rl"),
                                         F.col("p").alias("below"))
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        probabilities.append(stored(
            grams.join(contexts, ["xh", "xl"]).join(lower, ["rh", "rl"])
            .select("hi", "lo", "c", ((F.col("c") - discount) / F.col("total")
                                      + F.col("w") * F.col("below")).alias("p")), "model"))
    return KneserNey(order, alphabet, probabilities, weights, 0.5 / mass, _cache(probabilities[-1]))


def _cache(grams: DataFrame) -> GramTable:
    """The most frequent of ``hi, lo, c, p``: whole steps of an eighth of a doubling, ``CACHED`` at most."""
    step = F.floor(F.log2("c") * 8)
    least, room = None, CACHED
    for r in grams.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    top = grams.filter(F.lit(False) if least is None else step >= least).select("hi", "lo", _loss().alias("q")).toArrow()
    return GramTable(_slots(top["hi"].to_numpy(), top["lo"].to_numpy()), top["q"].to_numpy())


def _loss():
    """A probability's negative logarithm in whole 1 / ``UNIT``."""
    return F.rint(-F.log("p") * UNIT).cast("bigint")


def _resolved(asked: DataFrame, model: KneserNey) -> DataFrame:
    """``hi, lo, p`` of n-grams of the highest order (distinct rows ``hi, lo``): an
    n-gram that the model has not seen takes its context's weight times the next lower order."""
    left = asked.select("hi", "lo", F.col("hi").alias("gh"), F.col("lo").alias("gl"), F.lit(1.0).alias("f"))
    done = []
    for k in range(model.order, 0, -1):
        found = model.probabilities[k - 1].select("hi", "lo", "p")
        left = stored(left.join(found, ["hi", "lo"], "left"), "asked")
        if k == 1:
            left = left.fillna(model.unseen, ["p"])
        done.append(left.filter("p is not null").select(
            F.col("gh").alias("hi"), F.col("gl").alias("lo"), (F.col("f") * F.col("p")).alias("p")))
        if k > 1:
            weight = model.weights[k - 2].select(F.col("hi").alias("xh"), F.col("lo").alias("xl"), "w")
            left = (left.filter("p is null").select("hi", "lo", "gh", "gl", "f", *_context())
                    .join(weight, ["xh", "xl"], "left")
                    .select("gh", "gl", (F.col("f") * F.coalesce("w", F.lit(1.0))).alias("f"), *_rest(k))
                    .withColumnsRenamed({"rh": "hi", "rl": "lo"}))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _looked_up(texts: list[str], order: int, cached: GramTable):
    """Per text: characters, and the loss (in 1 / ``UNIT``) of its cached n-grams. Then the
    others: text, ``hi``, ``lo``, times."""
    numbers, lengths = _characters(texts, order)
    hi, lo = _keys(numbers, _ends(lengths, order), order)
    slot = cached.find(_slots(hi, lo))
    known = slot < len(cached.keys)
    loss = np.zeros(len(slot) + 1, np.int64)
    loss[1:][known] = cached.loss[slot[known]]
    total, ends = np.cumsum(loss), np.cumsum(lengths)
    text = np.repeat(np.arange(len(texts)), lengths)[~known]
    return lengths, total[ends] - total[ends - lengths], *_counted(text, hi[~known], lo[~known])


def log_probabilities(texts: list[str], model: KneserNey) -> tuple[np.ndarray, np.ndarray]:
    """Per text: characters, and the negative logarithm of their probability."""
    spark = model.probabilities[0].sparkSession
    rows = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)],
                                 "doc_id bigint, lang string, text string")
    found = sorted(_losses(rows, model).select("doc_id", "n_chars", "loss").collect())
    return np.array([r["n_chars"] for r in found]), np.array([r["loss"] for r in found])


def _scorer(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, cached = shipped.value
        for b in batches:
            for lo, hi in slices(b.column("text"), SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                n, loss, (text, high, low), times = _looked_up(
                    [t or "" for t in part.column("text").to_pylist()], order, cached)
                offsets = pa.array(np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32))
                # The table is stored once, so a row's number may be drawn.
                row = uuid.uuid4().int % 2 ** 62 + np.arange(len(n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row.astype(np.int64)), part.column("doc_id"), part.column("lang"),
                     pa.array(n), pa.array(loss),
                     *[pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (high, low, times)]],
                    names=["row", "doc_id", "lang", "n_chars", "loss", "hi", "lo", "times"])

    return run


def _losses(rows: DataFrame, model: KneserNey) -> DataFrame:
    """``doc_id, lang, n_chars, loss`` of every row ``doc_id, lang, text``."""
    shipped = rows.sparkSession.sparkContext.broadcast((model.order, model.cached))
    found = stored(rows.mapInArrow(
        _scorer(shipped), "row bigint, doc_id bigint, lang string, n_chars bigint, loss bigint, "
        "hi array<bigint>, lo array<bigint>, times array<bigint>"), "looked-up")
    others = found.select("row", F.explode(F.arrays_zip("hi", "lo", "times")).alias("g")).select("row", "g.*")
    answers = stored(_resolved(others.select("hi", "lo").distinct(), model).select(
        "hi", "lo", _loss().alias("q")), "answers")
    more = others.join(answers, ["hi", "lo"]).groupBy("row").agg(F.sum(F.col("q") * F.col("times")).alias("more"))
    return stored(found.select("row", "doc_id", "lang", "n_chars", "loss").join(more, "row", "left").select(
        "doc_id", "lang", "n_chars", ((F.col("loss") + F.coalesce("more", F.lit(0))) / UNIT).alias("loss")),
        "scores")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE,
                   tolerance: float = TOLERANCE, order: int = ORDER) -> DataFrame:
    """``doc_id, lang, n_chars, perplexity, score, threshold, kept``, one row per
    input row. ``labels``: ``doc_id, quality, toxic``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                       F.col(text_col).alias("text"))
    good = (labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
            .select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct())
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(5)) != 0
    wanted = stored(good.filter(chosen), "chosen")
    model = train(prefiltered(rows, wanted, "doc_id").join(wanted, "doc_id"), order)
    if model is None:
        n = F.coalesce(F.length(F.btrim("text", F.lit(BLANKS))), F.lit(0)).cast("bigint")
        none = F.lit(None).cast("double")
        return rows.select("doc_id", F.nullif("lang", F.lit("")).alias("lang"), n.alias("n_chars"),
                           none.alias("perplexity"), none.alias("score"), none.alias("threshold"),
                           (n > 0).alias("kept"))
    scored = _losses(rows, model)
    # Limits come from trusted documents that the model has not seen.
    known = (scored.filter("n_chars > 0").join(good.filter(~chosen), "doc_id", "left_semi"))
    means = known.groupBy("lang").agg((F.sum("loss") / F.sum("n_chars")).alias("mean"))
    overall = known.agg((F.sum("loss") / F.sum("n_chars")).alias("m")).first()["m"]
    if overall is None:  # the model was trained on all trusted documents
        known = scored.filter("n_chars > 0").join(good, "doc_id", "left_semi")
        means = known.groupBy("lang").agg((F.sum("loss") / F.sum("n_chars")).alias("mean"))
        overall = known.agg((F.sum("loss") / F.sum("n_chars")).alias("m")).first()["m"]
    shrunk = ((F.col("loss") + PRIOR_CHARS * F.coalesce("mean", F.lit(overall)))
              / (F.col("n_chars") + PRIOR_CHARS))
    # A row a language: with the means broadcast, the quantiles combine where the rows are.
    means = bounded_broadcast(stored(means, "means"))
    limits = (known.join(means, "lang").withColumn("score", shrunk).groupBy("lang")
              .agg(F.percentile_approx("score", quantile, 10_000).alias("q"), F.first("mean").alias("mean")))
    limits = stored(limits, "limits")
    pooled = (known.join(means, "lang").withColumn("score", shrunk)
              .agg(F.percentile_approx("score", quantile, 10_000)).first()[0])
    out = (scored.join(bounded_broadcast(limits), "lang", "left").withColumn("score", F.exp(shrunk))
           .withColumn("threshold", F.exp(F.coalesce("q", F.lit(pooled)) * tolerance)))
    some = F.col("n_chars") > 0
    return out.select(
        "doc_id", F.nullif("lang", F.lit("")).alias("lang"), "n_chars",
        F.when(some, F.exp(F.col("loss") / F.col("n_chars"))).alias("perplexity"),
        F.when(some, F.col("score")).alias("score"), "threshold",
        (some & (F.col("score") <= F.col("threshold"))).alias("kept"))
