"""Column builders for tokens, sentences and term statistics.

Everything here is a native Spark expression (regex + higher-order
functions), so it stays in the JVM and needs no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``\w``/``\s`` are Unicode-aware; Java's are ASCII-only. Letters and
# numbers are named by Unicode property, and whitespace is spelled out as the
# set Python's ``str.isspace`` accepts (same class in the DuckDB oracle).
WS = (r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}")
_NOT_WORD_OR_SPACE = rf"[^\p{{L}}\p{{N}}_{WS}]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(text) -> Column:
    """H1: lowercase, delete every char that is not word/space, split on whitespace.

    Punctuation is deleted, not turned into a separator: ``a-b`` -> ``ab``.
    """
    cleaned = F.regexp_replace(F.lower(_c(text)), _NOT_WORD_OR_SPACE, "")
    return F.filter(F.split(cleaned, rf"[{WS}]+"), lambda t: t != "")


def strip_ws(s: Column) -> Column:
    """Python ``str.strip()``: removes whitespace of every kind at both ends
    (Spark's ``trim`` only removes the space character)."""
    return F.regexp_replace(s, rf"^[{WS}]+|[{WS}]+$", "")


def split_sentences(text) -> Column:
    """H2: split on runs of ``.!?``, strip each piece, drop empty ones."""
    parts = F.transform(F.split(_c(text), r"[.!?]+"), strip_ws)
    return F.filter(parts, lambda s: s != "")


def char_length(text) -> Column:
    """Chunk size counted in characters (code points)."""
    return F.length(_c(text))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Inside higher-order functions an outer expression would be evaluated again
    at every element; binding it first keeps per-row work linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def value_counts(values, value_type: str = "string") -> Column:
    """Array -> ``MAP<value, count>`` in O(n log n) per row, without a shuffle.

    The values are sorted; run starts are the positions whose value differs
    from its predecessor, and each run length is the distance to the next
    start. Only O(1) array look-ups are used inside the lambdas.
    """
    def from_sorted(s):
        n = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda i: (n > 0) & ((i == 1) | (F.element_at(s, i) != F.element_at(s, i - 1))),
        )

        def from_starts(st):
            m = F.size(st)
            keys = F.transform(st, lambda p: F.element_at(s, p))
            counts = F.transform(
                st, lambda p, j: F.coalesce(F.try_element_at(st, j + 2), n + 1) - p)
            return F.when(n > 0, F.map_from_arrays(keys, counts.cast("array<int>"))).otherwise(
                F.create_map().cast(f"map<{value_type},int>"))

        return let(starts, from_starts)

    return let(F.array_sort(_c(values)), from_sorted)


def term_frequencies(tokens) -> Column:
    """Token array -> ``MAP<term, tf>``."""
    return value_counts(tokens, "string")


def preview(text, n: int) -> Column:
    """F8: first ``n`` characters followed by ``...``."""
    return F.concat(F.substring(_c(text), 1, n), F.lit("..."))


def comma_list(s) -> Column:
    """``"a, b ,c"`` -> ``[a, b, c]`` (trimmed)."""
    return F.transform(F.split(_c(s), ","), strip_ws)


def explode_positions(df, arr: Column, pos: str, value: str, *keep) -> "DataFrame":
    """``posexplode`` without Catalyst's inferred pre-filter.

    For a plain ``posexplode(expr)`` the optimizer adds ``size(expr) > 0 AND
    isnotnull(expr)`` below the generator and pushes it under the projection,
    evaluating an expensive ``expr`` up to three times. The outer variant
    gets no inferred filter; empty or NULL arrays are then dropped by the
    (cheap) NULL test on the position, giving exactly posexplode's rows.
    """
    return (df.select(*keep, F.posexplode_outer(arr).alias(pos, value))
            .where(F.col(pos).isNotNull()))


def merge_metadata(base, override) -> Column:
    """Document metadata, then chunk keys; the chunk's value wins on a
    clash (no session-level map-key policy needed)."""
    o = _c(override)
    return F.map_concat(F.map_filter(_c(base), lambda k, v: ~F.map_contains_key(o, k)), o)


def name_slug(name) -> Column:
    """``/`` and ``-`` become ``_`` (run and metric names)."""
    return F.translate(_c(name), "/-", "__")
