"""Subword ids from a vocabulary table (N3, I3, L10): longest match first, with offsets into the text.

A text is cut into runs of word characters and runs of other visible characters. A run becomes the longest vocabulary
piece at its start, then the longest continuation piece (the vocabulary marks those with a prefix) where that
one ends, and so on; a run that cannot be covered, or is longer than ``longest_word``, is one unknown token. The
vocabulary is a table ``piece, id`` of at most ``MAX_PIECES`` rows; it is checked, shipped to the tasks once and
kept there as a trie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PIECES = 1_000_000
CACHED_WORDS = 200_000
PREFIX = "##"
TOKENS = "array<struct<id:int,first:int,last:int>>"
_WORD = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]"
_RUNS = regex.compile(rf"{_WORD}+|(?:(?!{_WORD})\S)+")
_TYPE = pa.list_(pa.struct([("id", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))
_END = ""  # key of a piece's id in its trie node


@dataclass
class Vocabulary:
    """Tries of starting and continuing pieces."""
    unknown: int
    prefix: str = PREFIX
    longest_word: int = 100
    starts: dict = field(default_factory=dict)
    continued: dict = field(default_factory=dict)
    words: dict = field(default_factory=dict, repr=False)

    def add(self, piece: str, number: int) -> None:
        """A prefixed piece continues a word; as it is written it may also start one (a text that holds the prefix)."""
        ways = [(self.starts, piece)]
        if self.prefix and piece.startswith(self.prefix):
            ways.append((self.continued, piece[len(self.prefix):]))
        for node, letters in ways:
            for c in letters:
                node = node.setdefault(c, {})
            if letters:
                node[_END] = number

    def of_word(self, word: str) -> list[tuple[int, int, int]]:
        """``(id, first, last)`` of a run, places within it."""
        found = self.words.get(word)
        if found is None:
            found = self._cover(word)
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[word] = found
        return found

    def _cover(self, word: str) -> list[tuple[int, int, int]]:
        out, at = [], 0
        while at < len(word) <= self.longest_word:
            node, end = (self.continued if at else self.starts), 0
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if _END in node:
                    end, number = i + 1, node[_END]
            if not end:
                break
            out.append((number, at, end))
            at = end
        return out if at == len(word) else [(self.unknown, 0, len(word))]

    def of_text(self, text: str) -> list[tuple[int, int, int]]:
        return [(i, m.start() + a, m.start() + b) for m in _RUNS.finditer(text) for i, a, b in self.of_word(m.group())]


def read_vocabulary(pieces: DataFrame, unknown: str, prefix: str = PREFIX, longest_word: int = 100) -> Vocabulary:
    """From a table ``piece STRING, id INT``; ``unknown`` names the piece for runs that cannot be covered."""
    rows = pieces.select("piece", "id").limit(MAX_PIECES + 1).collect()
    if len(rows) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    ids = {r["piece"]: r["id"] for r in rows}
    if unknown not in ids:
        raise ValueError(f"no piece {unknown!r}")
    out = Vocabulary(ids[unknown], prefix, longest_word)
    for piece, number in ids.items():
        if piece:
            out.add(piece, number)
    return out


def subword_tokens(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", output: str = "tokens") -> DataFrame:
    """``df`` with ``output``: the text's tokens with their ids and places (in characters, end excluded). Null text has
    none."""
    shipped = df.sparkSession.sparkContext.broadcast(vocabulary)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"id": i, "first": a, "last": e} for i, a, e in shipped.value.of_text(t or "")]
                     for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _TYPE)], names=[*names, output])

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{output}` {TOKENS}")


def token_ids(tokens: str | Column = "tokens") -> Column:
    """Ids alone, for padding and truncation."""
    return F.transform(tokens, lambda t: t["id"])
