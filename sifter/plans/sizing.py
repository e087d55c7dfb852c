"""Size checks in front of every broadcast.

A side is broadcast only when its row count is proven to be under a bound;
otherwise the plan is left to Catalyst (sort-merge join / cartesian product),
which scales with the data instead of with driver memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default bound for query-side tables (questions, candidates, dimensions).
DEFAULT_BROADCAST_ROWS = 200_000


def mark_bounded(df: DataFrame, rows: int) -> DataFrame:
    """Record a proven row bound on ``df`` (e.g. one row per checked question)."""
    df._sifter_rows = rows  # type: ignore[attr-defined]
    return df


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Return ``broadcast(df)`` when ``df`` has at most ``max_rows`` rows, else ``df``.

    A bound recorded with :func:`mark_bounded` is used as is; otherwise the
    count runs on this side alone, and ``limit(max_rows + 1)`` keeps the check
    cheap even when the side turns out to be large.
    """
    n = getattr(df, "_sifter_rows", None)
    if n is None:
        n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def literal_dimension(df: DataFrame) -> DataFrame:
    """Broadcast a table built from literals in code (fixed, tiny by construction)."""
    return F.broadcast(df)


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan that yields fewer partitions than the cluster has cores.

    Small inputs stored as one file/row group would otherwise run every
    per-row operator in one task. On large inputs the scan already has more
    partitions than cores and this is a no-op (no shuffle is added).
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
