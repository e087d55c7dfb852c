r"""Line-first quality rules, DataFrame operations only.

Rules look at one line at a time (``\n``-split); a line without a word passes.
A line fails if it

* does not end in closing punctuation (``punctuation``),
* is made of menu separators and symbols (``navigation``: more than
  ``symbol_pct`` per cent of its characters are of ``[#*$%&|<>]``),
* shouts (``shouting``: 20 characters or more, letters, none lower-case), or
* consists of web addresses for more than half (``links``), or
* has a standing phrase of web pages and licences, in any of the languages of ``PHRASES`` (a parameter), and at most
  ``PHRASE_CHARS`` characters (``boilerplate``; a paragraph may well speak of such things).

Failing lines go; a document that loses more than ``max_loss_pct`` per cent of
its characters (of lines with a word) is rejected, as is one whose base
counts fail: fewer than ``min_words`` words, or more than ``max_repeat_pct`` per cent of its words
in 3-word windows that occur twice or more.

Repeated windows are found inside the row: a window's hash with its position
in the low bits is one number, sorted numbers bring equal windows together, and
neighbours with equal hash bits are compared word by word. A row costs n log n
for n words; nothing is shuffled.

Defined results: null text has no word, one empty line, and fails the base
rules; empty text likewise; text without any word loses nothing; repeated rows get equal results;
ties (exactly ``max_loss_pct``) are kept; an empty table gives an empty
result; a text of any length is one row's work in one task; further columns are not read, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import BLANKS, WORD_RE

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_LOSS_PCT = 50
SYMBOL_PCT = 4
SHOUT_CHARS = 20
SYMBOLS = "[#*$%&|<>]+"
PHRASE_CHARS = 200
# Closing punctuation.
CLOSED = [".", "!", "?", "…", ":", ";", "。", "！", "？", '"', "'", "”", "’", "»", ")", "]"]
# Phrases that mark a line as boilerplate, by language.
PHRASES = {
    "en": ["all rights reserved", "licensed under", "released under", "terms of use",
           "terms of service", "privacy policy", "cookie policy", "use cookies", "enable javascript",
           "subscribe to our newsletter", "click here to", "skip to content", "powered by", "lorem ipsum"],
    "de": ["alle rechte vorbehalten", "lizenziert unter", "nutzungsbedingungen", "datenschutzerklärung",
           "verwendet cookies", "verwenden cookies", "newsletter abonnieren", "hier klicken", "zum inhalt springen"],
    "fr": ["tous droits réservés", "sous licence", "conditions d'utilisation", "politique de confidentialité",
           "mentions légales", "utilise des cookies", "utilisons des cookies", "abonnez-vous à", "cliquez ici",
           "aller au contenu"],
    "es": ["todos los derechos reservados", "bajo licencia", "condiciones de uso", "términos de uso",
           "política de privacidad", "aviso legal", "utiliza cookies", "utilizamos cookies", "suscríbete a",
           "haz clic aquí", "saltar al contenido"],
}
ADDRESS = "https?://[^\\x20\\x09-\\x0D]+"


def boilerplate(phrases: dict[str, list[str]]) -> str:
    """One pattern of all languages' phrases, in any case."""
    return "(?iu)(" + "|".join(p for some in phrases.values() for p in some) + ")"


def line_fails(line: Column, symbol_pct: int = SYMBOL_PCT, phrases: dict[str, list[str]] = PHRASES) -> Column:
    """Whether a line with a word breaks a rule."""
    symbols = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))
    last = F.substring(F.rtrim(line, F.lit(BLANKS)), -1, 1)
    return (~last.isin(CLOSED) | (100 * symbols > symbol_pct * F.length(line))
            | ((F.length(line) >= SHOUT_CHARS) & ~line.rlike("\\p{Ll}") & line.rlike("\\p{Lu}"))
            | (2 * F.length(F.regexp_replace(line, ADDRESS, "")) < F.length(line))
            | ((F.length(line) <= PHRASE_CHARS) & line.rlike(boilerplate(phrases))))


def _has_word(line: Column) -> Column:
    return line.rlike(WORD_RE)


def _repeat_positions(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to ``words, bits`` (bits: of the word count)."""
    windows = F.expr("""
        CASE WHEN size(words) < 3 THEN CAST(array() AS array<bigint>)
        ELSE transform(arrays_zip(slice(words, 1, size(words) - 2),
                                  slice(words, 2, size(words) - 2),
                                  slice(words, 3, size(words) - 2)),
                       (w, i) -> shiftleft(shiftright(xxhash64(w), bits), bits) | i) END""")
    # 0 where a number and the next one have the same hash bits. Each step's
    # array is used more than once by the next, which keeps the optimizer from
    # folding it into a lambda and computing it anew per element.
    gaps = F.expr("""
        CASE WHEN size(found) < 2 THEN CAST(array() AS array<bigint>)
        ELSE zip_with(found, slice(found, 2, size(found) - 1),
                      (x, y) -> coalesce(shiftright(x ^ y, bits), 1L)) END""")
    at = "CAST(found[j{}] & low AS int)"
    equal = " AND ".join(f"words[{at.format('')} + {d}] = words[{at.format(' + 1')} + {d}]"
                         for d in range(3))
    covered = F.expr(f"""
        CASE WHEN array_contains(gaps, 0L) THEN size(array_distinct(flatten(transform(
            array_compact(transform(gaps, (g, j) -> CASE WHEN g = 0 THEN j END)),
            j -> CASE WHEN {equal}
                      THEN flatten(transform(array({at.format('')}, {at.format(' + 1')}),
                                             p -> array(p, p + 1, p + 2)))
                      ELSE CAST(array() AS array<int>) END)))) ELSE 0 END""")
    return (rows.withColumn("found", F.sort_array(windows))
            .withColumn("low", F.expr("shiftleft(1L, bits) - 1"))
            .withColumn("gaps", gaps)
            .withColumn("n_repeat_words", covered.cast("bigint"))
            .drop("found", "low", "gaps"))


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               max_loss_pct: int = MAX_LOSS_PCT, symbol_pct: int = SYMBOL_PCT,
               min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT,
               phrases: dict[str, list[str]] = PHRASES) -> DataFrame:
    """``doc_id``, base counts, ``n_lines_failed``, ``lost_pct``, ``base_failed``,
    ``kept`` and ``kept_text`` (the lines that pass), one row per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", "text", F.split("text", "\n", -1).alias("all_lines"),
        F.expr(f"regexp_extract_all(text, '{WORD_RE}', 0)".replace("\\", "\\\\")).alias("words"))
    rows = rows.select(
        "doc_id", "text", "words", "all_lines",
        F.filter("all_lines", _has_word).alias("worded"),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.bin(F.size("words").cast("bigint"))).alias("bits"),
        F.length(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", "")).cast("bigint")
        .alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("bigint")
        .alias("n_symbols"))
    rows = _repeat_positions(rows)
    passed = F.filter("all_lines", lambda x: ~_has_word(x) | ~line_fails(x, symbol_pct, phrases))
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_repeat_words",
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("bigint").alias("n_dup_lines"),
        F.size("all_lines").alias("n_lines"),
        F.aggregate("worded", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("chars"),
        passed.alias("passed"))
    left = F.aggregate("passed", F.lit(0).cast("bigint"),
                       lambda a, x: a + F.when(_has_word(x), F.length(x)).otherwise(0))
    rows = rows.select("*", left.alias("left_chars"), F.size("passed").alias("n_passed"))
    base_failed = ((F.col("n_words") < min_words)
                   | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
    lost = F.col("chars") - F.col("left_chars")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (100 * lost <= max_loss_pct * F.col("chars"))).alias("kept"),
        (F.col("n_lines") - F.col("n_passed")).cast("bigint").alias("n_lines_failed"),
        F.when(F.col("chars") > 0, 100.0 * lost / F.col("chars")).otherwise(0.0).alias("lost_pct"),
        F.array_join("passed", "\n").alias("kept_text"))
