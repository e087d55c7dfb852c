"""Dense-vector column builders (H36, H37) and the default hashed embedder.

Vectors are ``ARRAY<DOUBLE>`` columns; all arithmetic is done with
higher-order functions, so scoring never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sifter.functions.text import _c, let, tokenize, value_counts

# Width of the default hashed embedding.
HASH_DIM = 64


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0).cast("double"),
                       lambda acc, v: acc + v)


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def cosine(a, b) -> Column:
    """Cosine similarity in DOUBLE; a zero vector gives 0.

    Both operands and norms are bound once (they may be whole embedding
    expressions)."""
    return let(_c(a), lambda x: let(_c(b), lambda y: let(norm(x), lambda na: let(
        norm(y), lambda nb: F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(
            dot(x, y) / (na * nb))))))


def cosine_with_norms(a, b, na, nb) -> Column:
    """Cosine when both norms are precomputed columns (the scoring hot path)."""
    na, nb = _c(na), _c(nb)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def l2_normalize(a) -> Column:
    """Divide by the L2 norm; a zero vector stays zero."""
    return let(_c(a).cast("array<double>"), lambda v: let(
        norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))


def token_hash(t: Column) -> Column:
    """First 8 hex digits of md5(token) as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint")


def hashed_counts(tokens, dim: int = HASH_DIM) -> Column:
    """J1 default embedder, un-normalised: per dimension the sum of token signs.

    dim = h % D, sign = +1 when floor(h / D) is even else -1. The counts are
    integers, so every later sum is exact and independent of order.
    """
    codes = F.transform(_c(tokens), lambda t: let(
        token_hash(t), lambda h: (h % dim) * 2 + (F.floor(h / dim) % 2)))
    return let(value_counts(codes, "bigint"), lambda counts: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda d: (F.coalesce(counts[d.cast("bigint") * 2], F.lit(0))
                   - F.coalesce(counts[d.cast("bigint") * 2 + 1], F.lit(0))).cast("double")))


def hashed_embedding(text, dim: int = HASH_DIM) -> Column:
    """Normalised hashed bag-of-tokens embedding of a text column."""
    return l2_normalize(hashed_counts(tokenize(text), dim))


ENTRY_TYPE = "array<struct<i:int,w:double>>"


def hashed_entries(tokens, dim: int = HASH_DIM) -> Column:
    """Sparse form of :func:`hashed_counts`: non-zero ``(i, w)`` entries in
    dimension order. A short text touches few dimensions, so sparse dot
    products are much cheaper than dense ones, with identical (integer) sums."""
    codes = F.transform(_c(tokens), lambda t: let(
        token_hash(t), lambda h: (h % dim) * 2 + (F.floor(h / dim) % 2)))

    def from_counts(counts):
        dims = F.array_distinct(F.transform(F.map_keys(counts), lambda c: F.floor(c / 2)))
        ent = F.transform(dims, lambda d: F.struct(
            d.cast("int").alias("i"),
            (F.coalesce(counts[d * 2], F.lit(0)) - F.coalesce(counts[d * 2 + 1], F.lit(0)))
            .cast("double").alias("w")))
        return F.filter(ent, lambda e: e["w"] != 0)

    return let(value_counts(codes, "bigint"), from_counts)


def dense_entries(vec) -> Column:
    """Non-zero ``(i, w)`` entries of a dense vector."""
    return F.filter(F.transform(_c(vec), lambda x, i: F.struct(i.cast("int").alias("i"),
                                                                x.cast("double").alias("w"))),
                    lambda e: e["w"] != 0)


def entries_norm(entries) -> Column:
    return F.sqrt(F.aggregate(_c(entries), F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))


def entries_dot_dense(entries, vec) -> Column:
    """Dot product of sparse entries with a dense vector (O(non-zeros))."""
    v = _c(vec)
    return F.aggregate(_c(entries), F.lit(0.0),
                       lambda a, e: a + e["w"] * F.element_at(v, e["i"] + 1))


def entries_dot(a, b) -> Column:
    """Dot product of two sparse entry lists (both in dimension order)."""
    return let(_c(b), lambda bb: F.aggregate(_c(a), F.lit(0.0), lambda acc, e: acc + e["w"] * F.coalesce(
        F.try_element_at(F.filter(bb, lambda x: x["i"] == e["i"]), F.lit(1))["w"], F.lit(0.0))))


def entries_cosine(a, b) -> Column:
    """Cosine of two sparse entry lists; 0 when either is empty."""
    return let(_c(a), lambda x: let(_c(b), lambda y: let(entries_norm(x), lambda nx: let(
        entries_norm(y), lambda ny: F.when((nx == 0) | (ny == 0), F.lit(0.0)).otherwise(
            entries_dot(x, y) / (nx * ny))))))
