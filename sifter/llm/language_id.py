"""Language identification with labelled spans.

Training (``train``): letter n-grams (orders 1 to 4, word ends included) of a
bounded sample of labelled texts, counted per language in Spark, become one
table of log probabilities. Identification (``language_of``): the writing
system of a word narrows its candidate languages to those that use it, every
word gets a score per candidate, and a Viterbi pass with a penalty for each
switch of language labels the words. Runs of one label are the spans; the
language with the most letters names the document, its share is the score.

Bounds: ``per_language`` documents expected per language in the sample (taken
by a hash of the row, from every part of the table), ``2 ** BITS`` n-gram
buckets per language and ``max_languages`` languages, so the model shipped to
the tasks has a fixed largest size. Everything identified is whole text.

Defined results: null text or text without a letter is ``und`` with score 0
and no spans; text in a script that no learned language uses gets the first
learned language with score 0; rows without a label, text or letters teach nothing;
without any learned language every row is ``und``; repeated rows get equal
results; equal scores go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sifter.llm.common import release, slices

PER_LANGUAGE = 3_000
MAX_LANGUAGES = 500
BITS = 16
ORDERS = (1, 2, 3, 4)
SWITCH_PENALTY = 12.0
WORST = -6.0        # a word says no more than this against a language
EXCLUDED = -30.0    # the word's script is not one of the language
SCRIPT_SHARE = 0.005
PACK_CELLS = 6_000_000
SLICE_BYTES = 1_500_000   # text a task works on at once
WORD_BLOCK = 20_000       # distinct words whose n-grams are held at once
UNKNOWN = "und"
RESULT = "lang string, score double, spans array<struct<lang:string,first:int,words:int>>"

# First code point of the ranges that tell scripts apart.
SCRIPT_STARTS = np.array([
    0x0000,   # Latin
    0x0370,   # Greek
    0x0400,   # Cyrillic
    0x0530,   # Armenian
    0x0590,   # Hebrew
    0x0600,   # Arabic
    0x0900,   # Devanagari
    0x0980,   # other Indic scripts
    0x0E00,   # Thai, Lao
    0x0F00,   # Tibetan, Burmese
    0x10A0,   # Georgian
    0x1100,   # Hangul letters
    0x1200,   # Ethiopic and others
    0x1E00,   # Latin additions
    0x1F00,   # Greek additions
    0x2000,   # symbols
    0x3040,   # kana
    0x3100,   # Han
    0xA000,   # others
    0xAC00,   # Hangul syllables
    0xD7B0,   # others
], np.uint32)
SAME_SCRIPT = {13: 0, 14: 1, 19: 11}
N_SCRIPTS = len(SCRIPT_STARTS)


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    table: np.ndarray     # (2**BITS, languages) float32 log probabilities
    scripts: np.ndarray   # (scripts, languages) bool: the language uses the script


def _words(text: pa.Array) -> pa.ListArray:
    """Lower-case letter runs of each text (empty list if it has none)."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(text, "")),
                                       r"[^\p{L}\p{M}]+", " ")
    return pc.utf8_split_whitespace(pc.utf8_trim(clean, " "))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word number of every word, words per text, the distinct words."""
    flat = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    if "" in words:  # a text without letters splits into one empty word
        real = np.array([w != "" for w in words])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        keep = real[ids]
        sizes = np.bincount(owner[keep], minlength=len(sizes)).astype(np.int64)
        ids = (np.cumsum(real) - 1)[ids[keep]]
        words = [w for w in words if w != ""]
    return ids, sizes, words


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram; letters and script of each word."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32)
    blank = points == 32
    number = np.cumsum(blank) - 1
    owner, bucket = [], []
    for n in ORDERS:
        size = len(points) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        inside = np.ones(size, bool)
        for j in range(n):
            h = (h ^ points[j:j + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < j < n - 1 or n == 1:
                inside &= ~blank[j:j + size]
        # The blank that opens a gram belongs to the word behind it.
        at = np.flatnonzero(inside)
        owner.append(number[at])
        bucket.append((h[at] >> np.uint64(64 - BITS)).astype(np.int64))
    starts = np.flatnonzero(blank)[:len(words)] + 1
    letters = np.diff(np.flatnonzero(blank)[:len(words) + 1]) - 1
    script = np.searchsorted(SCRIPT_STARTS, points[np.minimum(starts, len(points) - 1)],
                             side="right") - 1
    for a, b in SAME_SCRIPT.items():
        script[script == a] = b
    owner_all = np.concatenate(owner)
    fits = owner_all < len(words)
    return owner_all[fits], np.concatenate(bucket)[fits], letters, script


def _counter(languages: list[str]):
    index = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (language, bucket, count); buckets from 2**BITS on count scripts."""
        for b in batches:
            lang = np.array([index[x] for x in b.column("lang").to_pylist()], np.int64)
            text, total = b.column("text"), {}
            for lo, hi in slices(text, SLICE_BYTES):
                ids, sizes, words = _flat(_words(text.slice(lo, hi - lo)))
                owner_lang = np.repeat(lang[lo:hi], sizes)
                for i in np.unique(owner_lang):
                    per = np.bincount(ids[owner_lang == i], minlength=len(words))
                    n = total.setdefault(int(i), np.zeros(2 ** BITS + N_SCRIPTS))
                    for at in range(0, len(words), WORD_BLOCK):
                        block = per[at:at + WORD_BLOCK]
                        owner, bucket, letters, script = _grams(words[at:at + WORD_BLOCK])
                        n[:2 ** BITS] += np.bincount(bucket, weights=block[owner],
                                                     minlength=2 ** BITS)
                        n[2 ** BITS:] += np.bincount(script, weights=block * letters,
                                                     minlength=N_SCRIPTS)
            for i, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)),
                     pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])

    return count


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
          id_col: str = "doc_id", per_language: int = PER_LANGUAGE,
          max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Fit the n-gram table on a bounded sample of the labelled rows."""
    rows = labelled.select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
        F.col(id_col).cast("string").alias("id")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in
             rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((2 ** BITS, 0), np.float32),
                             np.zeros((N_SCRIPTS, 0), bool))
    rate = F.lit(1.0)
    for x in langs:
        rate = F.when(F.col("lang") == x, F.lit(min(1.0, per_language / sizes[x]))).otherwise(rate)
    # Half the hash's range is [0, 2**63): a uniform number per row.
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(17)), 1) / F.lit(float(2 ** 63))
    counted = (rows.filter(draw < rate).select("text", "lang")
               .mapInArrow(_counter(langs), "lang int, bucket int, n bigint")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    n = np.zeros((2 ** BITS + N_SCRIPTS, len(langs)))
    n[counted["bucket"].to_numpy(), counted["lang"].to_numpy()] = counted["n"].to_numpy()
    grams, scripts = n[:2 ** BITS], n[2 ** BITS:]
    seen = max(1, int((grams.sum(axis=1) > 0).sum()))
    table = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * seen))
    share = scripts / np.maximum(1, scripts.sum(axis=0))
    return LanguageModel(langs, table.astype(np.float32), share >= SCRIPT_SHARE)


def word_scores(words: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(words, languages) scores, 0 for the best language; letters per word."""
    blocks = [_block_scores(words[at:at + WORD_BLOCK], model)
              for at in range(0, len(words), WORD_BLOCK)]
    return tuple(map(np.concatenate, zip(*blocks)))


def _block_scores(words: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    owner, bucket, letters, script = _grams(words)
    out = np.empty((len(words), len(model.langs)), np.float32)
    for i in range(len(model.langs)):
        out[:, i] = np.bincount(owner, weights=model.table[:, i][bucket], minlength=len(words))
    out /= len(ORDERS)
    allowed = model.scripts[script]
    none = ~allowed.any(axis=1)
    out[~allowed] = -np.inf
    out[none] = 0
    out -= out.max(axis=1, keepdims=True)
    np.maximum(out, WORST, out=out)
    out[~allowed & ~none[:, None]] = EXCLUDED
    return out, np.where(none, 0, letters)


def viterbi(scores: np.ndarray, ids: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Label of every word. ``ids``: rows of ``scores``, text after text. All
    texts advance together, longest first; step t handles word t of each."""
    order = np.argsort(-sizes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
    sizes = sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    first = np.concatenate([[0], np.cumsum(active)])
    n_lang = scores.shape[1]
    best_before = np.zeros(first[-1], np.int16)
    switched = np.zeros((first[-1], n_lang), bool)
    value = np.zeros((len(sizes), n_lang), np.float32)
    final = np.zeros(len(sizes), np.int16)
    for t in range(longest):
        a = active[t]
        v = value[:a]
        if t:
            best = v.argmax(axis=1)
            jump = v[np.arange(a), best][:, None] - penalty
            sw = jump > v
            best_before[first[t]:first[t + 1]] = best
            switched[first[t]:first[t + 1]] = sw
            v = np.where(sw, jump, v)
        value[:a] = v + scores[ids[starts[:a] + t]]
    final[:] = value.argmax(axis=1)
    label = np.zeros(len(ids), np.int16)
    state = final.copy()
    for t in range(longest - 1, -1, -1):
        a = active[t]
        label[starts[:a] + t] = state[:a]
        if t:
            s = state[:a]
            state[:a] = np.where(switched[first[t]:first[t + 1]][np.arange(a), s],
                                 best_before[first[t]:first[t + 1]], s)
    return label


def _identify(text: pa.Array, model: LanguageModel, penalty: float) -> pa.StructArray:
    n_docs = len(text)
    ids, sizes, words = _flat(_words(text))
    names = pa.array(model.langs + [UNKNOWN], pa.string())
    pred = np.full(n_docs, len(model.langs), np.int64)
    share = np.zeros(n_docs)
    label = np.zeros(len(ids), np.int16)
    spans = np.zeros(n_docs, np.int64)
    change = np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    if model.langs and len(words):
        scores, letters = word_scores(words, model)
        limit, at = max(1, PACK_CELLS // len(model.langs)), 0
        while at < n_docs:  # a run of whole texts at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit,
                                                 side="right")))
            lo, hi = (ends[at - 1] if at else 0), ends[to - 1]
            label[lo:hi] = viterbi(scores, ids[lo:hi], sizes[at:to], penalty)
            at = to
        owner = np.repeat(np.arange(n_docs), sizes)
        weight = np.bincount(owner * len(model.langs) + label, weights=letters[ids],
                             minlength=n_docs * len(model.langs)).reshape(n_docs, -1)
        has = sizes > 0
        pred[has] = weight[has].argmax(axis=1)
        share[has] = weight[has].max(axis=1) / np.maximum(1, weight[has].sum(axis=1))
        new = np.ones(len(ids), bool)
        new[1:] = (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])
        change = np.flatnonzero(new)
        spans = np.bincount(owner[change], minlength=n_docs).astype(np.int64)
    elif not model.langs:
        spans = np.zeros(n_docs, np.int64)
    lengths = np.diff(np.append(change, len(ids))) if len(change) else change
    span_owner = np.repeat(np.arange(n_docs), spans)
    begin = change - (ends - sizes)[span_owner] if len(change) else change
    items = pa.StructArray.from_arrays(
        [names.take(pa.array(label[change].astype(np.int64))), pa.array(begin.astype(np.int32)),
         pa.array(lengths.astype(np.int32))], names=["lang", "first", "words"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(spans)]).astype(np.int32))
    return pa.StructArray.from_arrays(
        [names.take(pa.array(pred)), pa.array(share), pa.ListArray.from_arrays(offsets, items)],
        names=["lang", "score", "spans"])


def language_of(text: Column, model: LanguageModel, spark,
                penalty: float = SWITCH_PENALTY) -> Column:
    """Struct ``lang, score, spans`` for a text column (Arrow batches)."""
    shipped = spark.sparkContext.broadcast(model)

    @arrow_udf(RESULT)
    def identify(column: pa.Array) -> pa.Array:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        parts = [_identify(column.slice(lo, hi - lo), shipped.value, penalty)
                 for lo, hi in slices(column, SLICE_BYTES)]
        release()
        return pa.concat_arrays(parts) if parts else _identify(column, shipped.value, penalty)

    return identify(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text leaves 2 modulo 4: never trained on."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id",
                       text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans``, one row per input row."""
    p = language_of(F.col(text_col), model, docs.sparkSession, penalty)
    return (docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                        p.alias("p"))
            .select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"),
                    F.col("p.score").alias("score"), F.col("p.spans").alias("spans")))
