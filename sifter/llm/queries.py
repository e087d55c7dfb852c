"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm import html_extract, language_id
from sifter.llm.best_fit import best_fit_pack
from sifter.llm.common import table
from sifter.llm.exact_dedup import exact_groups
from sifter.llm.kn_quality import quality_scores
from sifter.llm.language_id import held_out, identify_languages
from sifter.llm.line_dedup import line_dedup
from sifter.llm.line_rules import PHRASES, boilerplate, line_rules
from sifter.llm.minmax_dedup import near_components
from sifter.llm.mixing import mix_sources
from sifter.llm.phrase_mining import mine_phrases
from sifter.llm.piece_codec import encode_decode, ids_digest
from sifter.llm.turn_repair import damaged, repair_digest
from sifter.llm.window_dedup import window_dedup

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~held_out()))
    return identify_languages(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract_pages(pages, html_extract.train(pages))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), PIECE_MODEL).select(
        "doc_id", "n_tokens", ids_digest().alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(damaged(table(spark, sf_dir, "conversations"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256")


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_line_dedup, op3_language_id, op4_source_mixing, op5_quality_model,
    op6_best_fit_packing, op7_quality_rules, op8_minhash_dedup,
    op9_html_extraction, op10_substring_dedup, op11_sentencepiece_codec,
    op12_phrase_collocations, op13_conversation_repair)}

_LOWER = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz')")
# chr(9) to chr(13) and the blank
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_PHRASES = boilerplate(PHRASES).replace("(?iu)", "(?i)").replace("'", "''")

SQL = {
    "op1_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
""",
    "op2_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
keyed AS (
  SELECT doc_id, pos, line,
         trim({_LOWER.replace("coalesce(text, '')", 'line')}, {_BLANKS}) AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS home FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, coalesce(k.doc_id < s.home, false) AS gone
  FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op7_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
base AS (
  SELECT doc_id, len(w) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols
  FROM d),
windows AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line,
         length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS sym
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (
  SELECT doc_id, line, length(line) AS n,
         NOT regexp_matches(line, '[.!?…:;。！？"''”’»)\]][\x20\x09-\x0D]*$')
         OR 100 * sym > 4 * length(line)
         OR (length(line) >= 20 AND NOT regexp_matches(line, '\p{Ll}') AND regexp_matches(line, '\p{Lu}'))
         OR 2 * length(regexp_replace(line, 'https?://[^\x20\x09-\x0D]+', '', 'g')) < length(line)
         OR length(line) <= 200 AND regexp_matches(line, '""" + _PHRASES + r"""')
           AS failed
  FROM lines),
loss AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(n) AS chars,
         coalesce(sum(n) FILTER (failed), 0) AS lost
  FROM judged GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, coalesce(dup, 0) AS n_dup_lines,
       coalesce(r.n, 0) AS n_repeat_words,
       n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words)
         AND 100 * coalesce(lost, 0) <= 50 * coalesce(chars, 0) AS kept
FROM base b LEFT JOIN repeats r USING (doc_id) LEFT JOIN loss l USING (doc_id)
""",
    "op12_phrase_collocations": rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
places AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
  FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places),
freq AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
cuts AS (
  SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c
  FROM freq WHERE k > 1),
scored AS (
  SELECT x.lang, x.size, x.phrase, x.a, x.w, x.c, h.f AS l, t.f AS r, n,
         (1000::HUGEINT * x.a * n) // (h.f::HUGEINT * t.f) AS score
  FROM cuts x JOIN totals USING (lang)
  JOIN freq h ON h.lang = x.lang AND h.phrase = array_to_string(x.w[1:x.c], ' ')
  JOIN freq t ON t.lang = x.lang AND t.phrase = array_to_string(x.w[x.c + 1:], ' ')),
best AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM best o WHERE o.lang = b.lang AND o.size > b.size AND 100 * o.a >= 100 * b.a
      AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' '))),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM placed WHERE rank <= 2000
""",
}
