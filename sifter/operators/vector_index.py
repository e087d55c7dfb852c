"""Vector search through cells of coarse centroids.

*Index.* Centroids are fitted on a sample of at most ``SAMPLE_PER_CELL`` vectors a cell; every vector goes to the nearest one
and is stored by (cell, ring, salt): rings are steps of the angle to the centroid, and a ring with many vectors (copies,
say) is dealt to as many salts as keep a part at about ``PART_ROWS`` rows. ``parts`` holds the smallest and largest
angle of every (cell, ring) and its number of vectors.

*Exact search.* Angles between directions are a metric. A vector at angle r from a centroid which is at angle f
from the question lies at |f - r| or more from the question. The nearest parts are searched until they
hold enough vectors; the k-th best cosine there is the threshold, and only parts whose angles allow it are visited, in
which only vectors whose own angle allows it can be ranked. Vectors meet the questions in Arrow batches
(:mod:`sifter.operators.cell_scores`); a task returns its k best per question. The rows are those of the full scan.

*Approximate search* visits the parts of a question's ``probes`` nearest cells and nothing else. The number of probes
is calibrated when it isn't given: a sample of at most ``CALIBRATION`` indexed vectors asks for its exact neighbours, and as
many cells are visited as hold the wanted share of them. :func:`recall` measures a result against the exact one. On
vectors without any clusters neither way can leave much out: the exact one then visits nearly all parts, and the calibrated
number of probes comes out large.

Zero vectors have no direction: they score 0 with everything, as in the full scan, and stand in a part of their own
(cell -1). A question without a direction scores 0 everywhere, so its result is the smallest ids.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_type

from sifter.functions.vectors import dense_entries, entries_dot_dense, l2_normalize
from sifter.operators import batch_scores as B
from sifter.operators import retrieval as R
from sifter.operators.cell_scores import Reach, nearest_parts, seek
from sifter.plans.sizing import bounded_broadcast, mark_bounded
from sifter.session import cut_lineage, discard, materialize, materialize_clustered

MAX_CELLS = 4096
SAMPLE_PER_CELL = 64
PART_ROWS = 20_000
RING = 0.05            # radians
MARGIN = 2e-6          # cosines are ranked at 6 places; angles are compared with the same slack
SEED_FACTOR = 4        # vectors looked at for the threshold, in multiples of k
NO_CELL = -1
CALIBRATION = 64
TARGET_RECALL = 0.95   # of the calibration's sample, to stay above 0.9 elsewhere


@dataclass
class VectorIndex:
    """``vectors``: ``[group,] cell, ring, salt, doc_id, vec, vnorm, angle``; ``parts``: ``[group,] cell, ring, low, high,
    n, salts``; ``centroids``: ``cell, centroid`` (unit vectors, at most ``MAX_CELLS``)."""
    vectors: DataFrame
    parts: DataFrame
    centroids: DataFrame
    group_col: str | None
    n_cells: int
    n_parts: int   # (cell, ring, salt) combinations


def fit_centroids(index: DataFrame, n_cells: int | None = None, seed: int = 7) -> DataFrame:
    """``cell, centroid`` from a sample of the directions: ``n_cells`` defaults to the square root of the number of
    vectors, at most ``MAX_CELLS``, and the sample has at most about ``SAMPLE_PER_CELL`` rows a cell."""
    some = index.where("vnorm > 0 and not isnan(vnorm)")
    n = some.count()
    if n == 0:
        return index.sparkSession.createDataFrame([], "cell int, centroid array<double>")
    cells = max(1, min(n_cells or math.isqrt(n), MAX_CELLS))
    share = min(1.0, cells * SAMPLE_PER_CELL / n)
    keep = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = cut_lineage((some if share == 1.0 else some.where(keep)).select(
        array_to_vector(l2_normalize("vec")).alias("features")))
    model = KMeans(k=cells, seed=seed, maxIter=8, initSteps=2).fit(sample)
    found = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]  # at most MAX_CELLS rows
    unit = index.sparkSession.createDataFrame(found, "cell int, c array<double>").select(
        "cell", l2_normalize("c").alias("centroid"))
    return cut_lineage(unit.where(F.exists("centroid", lambda x: x != 0)))


def _angle(cosine):
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def build_vector_index(index: DataFrame, group_col: str | None = None, centroids: DataFrame | None = None,
                       n_cells: int | None = None) -> VectorIndex:
    """From document rows (``[group,] doc_id, vec, vnorm``) to stored cells. Every row is indexed."""
    g = R._g(group_col)
    centroids = fit_centroids(index, n_cells) if centroids is None else centroids
    held = [(r["cell"], r["centroid"]) for r in centroids.collect()]  # at most MAX_CELLS rows
    rows = B.nearest_cells(index.select(*g, "doc_id", "vec", "vnorm"), held, NO_CELL)
    rows = materialize(rows.withColumn("ring", F.floor(F.col("angle") / RING).cast("int")), "vector-rows")
    parts = rows.groupBy(*g, "cell", "ring").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n"))
    parts = cut_lineage(parts.withColumn("salts", F.ceil(F.col("n") / PART_ROWS).cast("int")))
    crowded = parts.where("salts > 1").select(*g, "cell", "ring", F.col("salts").alias("_salts"))
    salted = rows.join(crowded, g + ["cell", "ring"], "left").withColumn(
        "salt", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.coalesce("_salts", F.lit(1))).cast("int"))
    vectors = materialize_clustered(salted.drop("_salts"), "vector_cells", ["cell", "ring", "salt"])
    discard(rows)
    n_parts = parts.agg(F.sum("salts")).first()[0] or 0
    return VectorIndex(vectors, parts, centroids, group_col, len(held), n_parts)


def _visits(vindex: VectorIndex, qside: DataFrame) -> DataFrame:
    """``keys, cell, ring, salts, n, nearest, phi``: every part's least possible angle to every question. Questions
    x parts is the size of the index's directory, not of the collection."""
    keys = R._keys(qside)
    size = max(vindex.n_cells, 1)
    side = R._keep_bound(qside.select(*keys, "qvec", "qnorm"), qside)
    n_q = getattr(qside, "_sifter_rows", None)
    cosine = entries_dot_dense("qvec", "centroid") / F.col("qnorm")
    angles = side.where("qnorm > 0").crossJoin(F.broadcast(vindex.centroids)).select(
        *keys, "cell", _angle(cosine).alias("phi"))
    angles = mark_bounded(angles, n_q * size) if n_q is not None else angles
    near = vindex.parts.join(angles, R._g(vindex.group_col) + ["cell"]).select(
        *keys, "cell", "ring", "salts", "n", "phi", F.greatest(
            F.lit(0.0), F.col("phi") - F.col("high"), F.col("low") - F.col("phi")).alias("nearest"))
    # Vectors without a direction: always a right angle away, so to speak (score 0).
    none = vindex.parts.where(F.col("cell") == NO_CELL)
    flat = (none.join(side.where("qnorm > 0").select(*keys), vindex.group_col) if vindex.group_col
            else none.crossJoin(side.where("qnorm > 0").select(*keys)))
    return near.unionByName(flat.select(*keys, "cell", "ring", "salts", "n", F.lit(0.0).alias("phi"),
                                        F.lit(math.pi / 2).alias("nearest")))


def _scored(vindex: VectorIndex, qside: DataFrame, visits: DataFrame, keys: list[str], reach: bool) -> DataFrame:
    """``keys, doc_id, raw`` for the visited parts; with ``reach``, only vectors whose own angle lies within
    it of the question."""
    g = R._g(vindex.group_col)
    spots = visits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "n", "nearest")
    side = bounded_broadcast(R._keep_bound(qside.select(*keys, "qvec", "qnorm"), qside))
    n_q = getattr(qside, "_sifter_rows", None)
    if n_q is not None:
        spots = bounded_broadcast(mark_bounded(spots, n_q * vindex.n_parts))
    rows = vindex.vectors.join(spots, g + ["cell", "ring", "salt"])
    if reach:
        rows = rows.where((F.col("cell") == NO_CELL) | (F.abs(F.col("phi") - F.col("angle")) <= F.col("reach")))
    dn = F.col("vnorm")
    raw = F.when(dn == 0, F.lit(0.0)).otherwise(entries_dot_dense("qvec", "vec") / (F.col("qnorm") * dn))
    return rows.join(side, keys).select(*keys, "doc_id", raw.alias("raw"))


def _directionless(vindex: VectorIndex, qside: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The smallest ids at score 0 for questions without a direction."""
    none = qside.where("qnorm = 0").select(*keys)
    ids = vindex.vectors.select(*R._g(vindex.group_col), "doc_id")
    if vindex.group_col:
        w = Window.partitionBy(vindex.group_col).orderBy("doc_id")
        ids = ids.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
        pairs = none.join(ids, vindex.group_col)
    else:
        pairs = none.crossJoin(ids.orderBy("doc_id").limit(k))
    return pairs.select(*keys, "doc_id", F.lit(0.0).alias("raw"))


def _ranked(scored: DataFrame, k: int, keys: list[str]) -> DataFrame:
    return R.top_k(scored.withColumn("score", F.col("raw")), k, part_col=keys).select(
        *keys, "rank", "doc_id", "score", "raw")


@dataclass
class VectorResult:
    """``ranked``: ``[group,] query_id, rank, doc_id, score, raw``; ``work``: vectors in visited parts and vectors
    multiplied, per question."""
    ranked: DataFrame
    work: DataFrame


def _plans(qside: DataFrame) -> dict:
    return {name: Reach(asked) for name, asked in B.asked_by_group(
        qside.select(*R._keys(qside), "qvec", "qnorm").toArrow(), R._group_of(qside)).items()}


def _first_parts(vindex: VectorIndex, qside: DataFrame, units: dict, wanted: int) -> DataFrame:
    """``keys, cell, ring``: the parts nearest to every question, until they hold ``wanted`` vectors. Questions meet the index's
    directory (of their group), not its vectors."""
    group, keys = vindex.group_col, R._keys(qside)
    side = qside.select(*keys, "qvec", "qnorm")
    schema = ST.StructType([side.schema[c] for c in keys] + [
        ST.StructField("cell", ST.IntegerType()), ST.StructField("ring", ST.IntegerType())])
    names = schema.names
    parts = vindex.parts.select(*R._g(group), "cell", "ring", "low", "high", "n")

    def first(asked: pa.Table, held: pa.Table) -> pa.Table:
        made = [pa.table({c: asked.column(c).slice(0, 0) for c in keys} | {c: pa.array([], pa.int32()) for c in ("cell", "ring")})]
        cells, rings = held["cell"].to_numpy().astype(np.int64), held["ring"].to_numpy().astype(np.int64)
        for mine in B.asked_by_group(asked, group).values():
            who, part = nearest_parts(mine, cells, held["low"].to_numpy(), held["high"].to_numpy(), held["n"].to_numpy(), rings,
                                      units, NO_CELL, wanted)
            cols = {group: pa.array([asked[group][0].as_py()] * len(who), asked[group].type)} if group else {}
            made.append(pa.table(cols | {"query_id": mine.ids.take(pa.array(who)), "cell": pa.array(cells[part].astype(np.int32)),
                                         "ring": pa.array(rings[part].astype(np.int32))}))
        return pa.concat_tables([t.select(names).cast(made[0].select(names).schema) for t in made])

    if group:
        return side.groupBy(group).cogroup(parts.groupBy(group)).applyInArrow(
            lambda asked, held: first(asked, held), schema)
    held = parts.toArrow()  # at most MAX_CELLS x the rings of a half turn

    def run(batches):
        for batch in batches:
            yield from first(pa.Table.from_batches([batch]), held).to_batches()

    return side.mapInArrow(run, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _sought(vindex: VectorIndex, vectors: DataFrame, qside: DataFrame, plans: dict, units: dict, k: int) -> DataFrame:
    """``keys, doc_id, raw``: every task's k best among the vectors in reach, and rows that count its work: ``keys, visited,
    multiplied``."""
    group = vindex.group_col
    fields = [vectors.schema[group]] if group else []
    fields += [ST.StructField("query_id", qside.schema["query_id"].dataType), ST.StructField("doc_id", vectors.schema["doc_id"].dataType)]
    schema = ST.StructType([ST.StructField(f.name, f.dataType) for f in fields] + [
        ST.StructField("raw", ST.DoubleType()), ST.StructField("visited", ST.LongType()), ST.StructField("multiplied", ST.LongType())])
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in schema]

    def run(batches):
        for name, rows, seeker in seek(batches, plans, units, NO_CELL, k, group):
            of = lambda n: [pa.array([name] * n, kinds[0])] if group else []
            if rows is not None:
                who, ids, score = rows
                value = pa.array(np.where(np.isposinf(score), np.nan, score), mask=np.isneginf(score))
                yield pa.RecordBatch.from_arrays(of(len(who)) + [who, ids, value] + [pa.nulls(len(who), pa.int64())] * 2, names=names)
            some = np.nonzero(seeker.visited)[0]
            yield pa.RecordBatch.from_arrays(
                of(len(some)) + [seeker.plan.asked.ids.take(pa.array(some)), pa.nulls(len(some), kinds[-4]),
                                 pa.nulls(len(some), pa.float64()), pa.array(seeker.visited[some]),
                                 pa.array(seeker.multiplied[some])], names=names)

    return vectors.select(*R._g(group), "cell", "ring", "doc_id", "vec", "vnorm", "angle").mapInArrow(run, schema)


def _found(vindex: VectorIndex, qside: DataFrame, units: dict, k: int) -> DataFrame:
    """The threshold from the nearest parts, then all that lies in its reach."""
    group, keys, g = vindex.group_col, R._keys(qside), R._g(vindex.group_col)
    plans = _plans(qside)
    seeds = _first_parts(vindex, qside, units, SEED_FACTOR * k).toArrow()
    for plan in plans.values():
        plan.seeds = {}
    for plan, who, rows in B.by_question(plans, seeds, group):
        spots = list(zip(rows["cell"].to_pylist(), rows["ring"].to_pylist()))
        for i, spot in enumerate(spots):
            plan.seeds.setdefault(spot, []).append(who[i])
        plan.seeds = {spot: np.array(mine) for spot, mine in plan.seeds.items()}
    named = qside.sparkSession.createDataFrame(seeds.select([*g, "cell", "ring"]).group_by([*g, "cell", "ring"]).aggregate([])) \
        if seeds.num_rows else vindex.parts.select(*g, "cell", "ring").limit(0)
    near = vindex.vectors.join(bounded_broadcast(mark_bounded(named, seeds.num_rows)), g + ["cell", "ring"], "left_semi")
    best = R.top_k(_sought(vindex, near, qside, plans, units, k).where("raw is not null and not isnan(raw)").withColumn(
        "score", F.col("raw")), k, part_col=keys)
    least = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("least")).where(F.col("n") == k).toArrow()
    for plan in plans.values():
        plan.seeds, plan.theta = None, np.full(len(plan.asked.ids), np.nan)
    for plan, who, rows in B.by_question(plans, least, group):
        plan.theta[who] = rows["least"].to_numpy()
    for plan in plans.values():
        plan.reach = np.where(np.isnan(plan.theta), 4.0, np.arccos(np.clip(plan.theta - MARGIN, -1.0, 1.0)) + MARGIN)
    return materialize(_sought(vindex, vindex.vectors, qside, plans, units, k), "vector-found")


def exact_search(vindex: VectorIndex, qside: DataFrame, k: int = R.DEFAULT_TOP_K) -> VectorResult:
    """The k nearest vectors of every question (``retrieval.prepare_questions``), as the full scan gives them. Only each
    task's k best in reach are stored and ranked, never the pairs."""
    keys = R._keys(qside)
    units = {r["cell"]: r["centroid"] for r in vindex.centroids.collect()}  # at most MAX_CELLS rows
    n_q = getattr(qside, "_sifter_rows", None)
    seeds = 40 * SEED_FACTOR * k * (qside.count() if n_q is None else n_q)
    found = [_found(vindex, part, units, k) for part in R.dealt(qside, R._side_bytes(qside) + seeds)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    ranked = _ranked(rows.where("visited is null").select(*keys, "doc_id", "raw").unionByName(
        _directionless(vindex, qside, k, keys)), k, keys)
    work = rows.where("visited is not null").groupBy(*keys).agg(
        F.sum("visited").alias("visited"), F.sum("multiplied").alias("multiplied"))
    out = VectorResult(cut_lineage(ranked), cut_lineage(work))
    discard(*found)  # ranks and counts are stored
    return out


def _cell_order(visits: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, cell, place``: every question's cells, nearest first."""
    cells = visits.where(F.col("cell") != NO_CELL).select(*keys, "cell", "phi").distinct()
    w = Window.partitionBy(*keys).orderBy("phi", "cell")
    return cells.withColumn("place", F.row_number().over(w)).drop("phi")


def calibrate_probes(vindex: VectorIndex, k: int = R.DEFAULT_TOP_K, target: float = TARGET_RECALL) -> int:
    """Cells to visit so that a sample of indexed vectors finds ``target`` of its exact k neighbours."""
    g = R._g(vindex.group_col)
    sample = vindex.vectors.where("vnorm > 0").orderBy(
        F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(CALIBRATION)
    asked = mark_bounded(cut_lineage(sample.select(
        *g, F.monotonically_increasing_id().alias("query_id"), dense_entries("vec").alias("qvec"),
        F.col("vnorm").alias("qnorm"))), CALIBRATION)
    asked._sifter_group = vindex.group_col  # type: ignore[attr-defined]
    keys = R._keys(asked)
    exact = exact_search(vindex, asked, k).ranked.select(*keys, "doc_id")
    homes = vindex.vectors.select(*g, "doc_id", "cell").join(F.broadcast(exact), g + ["doc_id"])  # 64 x k rows
    places = homes.join(_cell_order(_visits(vindex, asked), keys), keys + ["cell"]).select("place")
    found = places.agg(F.expr(f"percentile_disc({target}) within group (order by place)")).first()[0]
    return int(found or 1)


def approximate_search(vindex: VectorIndex, qside: DataFrame, k: int = R.DEFAULT_TOP_K,
                       probes: int | None = None) -> VectorResult:
    """The k best of the vectors in every question's ``probes`` nearest cells (calibrated by default)."""
    keys = R._keys(qside)
    probes = calibrate_probes(vindex, k) if probes is None else probes
    visits = cut_lineage(_visits(vindex, qside))
    near = _cell_order(visits, keys).where(F.col("place") <= probes).drop("place")
    going = visits.join(near, keys + ["cell"])
    found = _scored(vindex, qside, going, keys, False)
    work = going.groupBy(*keys).agg(F.sum("n").alias("visited")).withColumn("multiplied", F.col("visited"))
    return VectorResult(_ranked(found, k, keys), work)


def recall(found: DataFrame, exact: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: the share of the exact results that were found (a result as good as the exact list's last
    score counts, whichever of equal vectors it is)."""
    keys = keys or ["query_id"]
    last = exact.groupBy(*keys).agg(F.min("score").alias("_last"), F.count(F.lit(1)).alias("_k"))
    hits = found.select(*keys, "score").join(last, keys, "right").groupBy(*keys, "_k").agg(
        F.sum(F.coalesce((F.col("score") >= F.col("_last")).cast("int"), F.lit(0))).alias("_hit"))
    return hits.agg((F.sum(F.least("_hit", "_k")) / F.sum("_k")).alias("recall"))
