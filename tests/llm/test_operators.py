"""The training-data operators against brute force on small tables with nulls,
empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from sifter.llm import (best_fit, exact_dedup, html_extract, kn_quality, language_id, line_dedup,
                        line_rules, minmax_dedup, mixing, window_dedup)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, k string, row int"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))


LONG_LINE = "This line is shared by many documents of the table."
BASE = words(120, 1)
EDGE = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "One"), (5, "ONE"), (6, "one"),
    (7, BASE), (8, BASE + " tail word"), (9, "start " + BASE), (10, BASE), (10, BASE),
    (11, words(300, 2) + " " + words(70, 3)), (12, words(70, 3) + " " + words(40, 4)),
    (13, words(60, 3)), (14, "a a a a a a a a"), (15, "Éa b É.\x0bc"),
    (16, f"x\n {LONG_LINE.upper()}\t\ny"), (17, LONG_LINE + "\n" + LONG_LINE), (18, LONG_LINE),
    (19, "z\n" + LONG_LINE), (20, LONG_LINE + "\nq"), (21, LONG_LINE), (None, BASE), (None, None),
    (22, words(9000, 5)), (23, "\n\n"), (24, "漢字 かな текст <|endoftext|> don't ½"),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en", "s" if n % 3 else None, None, "clash", "clash", n)
            for n, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def low(t):
    return (t or "").encode().lower()


def ident(i):
    return -2 ** 63 if i is None else i


# 1 ---------------------------------------------------------------------------

@pytest.mark.parametrize("capacity,hash_bits", [(50_000, 64), (3, 64), (2, 3), (50_000, 1)])
def test_exact_groups(edge, capacity, hash_bits):
    groups = defaultdict(list)
    for i, t in EDGE:
        groups[low(t)].append(i)
    want = Counter()
    for i, t in EDGE:
        g = groups[low(t)]
        best = max(g, key=ident)
        want[(i, best, len(g), i == best, hashlib.sha256(low(t)).hexdigest())] += 1
    got = Counter(tuple(r)[:5] for r in exact_dedup.exact_groups(
        edge, capacity=capacity, hash_bits=hash_bits).collect())
    assert got == want


def test_exact_directory_splits_full_buckets(docs):
    entries = exact_dedup.build_entries(docs)
    table = exact_dedup.directory(entries, capacity=10)
    leaves = table.collect()
    assert sum(r.entries for r in leaves) == entries.count()
    index = exact_dedup.build_index(entries, table)
    held = Counter((r.bucket_depth, r.bucket) for r in index.collect())
    assert held == {(r.depth, r.slot): r.entries for r in leaves}
    assert all(r.entries <= 10 or r.chains == 1 for r in leaves) and max(r.depth for r in leaves) >= 4


def test_probe_needs_the_directory(docs, monkeypatch):
    """Entries stand in the buckets that the directory names: with a wrong one rows find nothing."""
    true = exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda e, c: true(e, c).filter("slot > 0"))
    assert exact_dedup.exact_groups(docs, capacity=10).count() < docs.count()


def test_prefilter_keeps_every_match(spark):
    from sifter.llm.common import prefiltered
    rows, wanted = spark.range(20_000), spark.range(0, 20_000, 50)
    kept = prefiltered(rows, wanted, "id")
    assert kept.columns == ["id"] and wanted.join(kept, "id").count() == 400 and kept.count() < 500
    assert prefiltered(rows, wanted, "id", bits=64).join(wanted, "id").count() == 400  # crowded, still whole
    assert prefiltered(rows, wanted.limit(0), "id").count() == 0
    # The shuffle of the exact join comes behind the filter.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = prefiltered(rows, wanted, "id").join(wanted, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("SortMergeJoin") < plan.index("shiftrightunsigned") and "Exchange hashpartitioning(id" in plan[
        :plan.index("shiftrightunsigned")]


def test_exact_dedup_keeps_rows_whole(edge):
    out = exact_dedup.exact_dedup(edge)
    assert out.columns == edge.columns
    got = out.collect()
    assert len(got) == len({low(t) for _, t in EDGE}) == len({low(r.text) for r in got})
    assert exact_dedup.exact_groups(edge.limit(0)).count() == 0


# 2 ---------------------------------------------------------------------------

def test_line_dedup(edge):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: low(x.strip(strip)).decode()
    holders = defaultdict(set)
    for i, t in EDGE:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(ident(i))
    want = Counter()
    for i, t in EDGE:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 5
                                         and ident(i) != max(holders[key(x)]))]
        want[(i, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    assert sum(w[3] for w in want) == 6
    assert Counter(map(tuple, line_dedup.line_dedup(edge).collect())) == want
    assert line_dedup.line_dedup(edge.limit(0)).count() == 0


# 3 ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def language_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language_id.train(docs.filter(~language_id.held_out()))


def test_language_accuracy_on_held_out_rows(spark, language_model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify_languages(docs, language_model).filter("held_out")
    r = found.join(docs.select("doc_id", "lang"), "doc_id").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.98 and 0 <= r[1] and r[2] <= 1


def test_language_edges_and_spans(spark, edge, language_model):
    got = {r.doc_id: r for r in language_id.identify_languages(edge, language_model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].spans == [] for i in (1, 2, 3, 23))
    assert got[24].lang_pred in language_model.langs
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(
        "length(text) > 800 and text not like '%|%' and text not like '%!!%' and text not like '%$%'")
    by = {r.lang: r.text[:400] for r in rows.select("lang", "text").collect()}
    mixed = spark.createDataFrame([(1, by["de"] + " " + by["es"])], "doc_id bigint, text string")
    spans = language_id.identify_languages(mixed, language_model).first().spans
    assert [s.lang for s in spans if s.words > 8] == ["de", "es"]
    assert spans[0]["first"] == 0 and all(a["first"] + a.words == b["first"] for a, b in zip(spans, spans[1:]))


def test_language_without_training(spark, edge):
    none = language_id.train(edge.limit(0))
    assert {r.lang_pred for r in language_id.identify_languages(edge, none).collect()} == {"und"}
    assert language_id.identify_languages(edge.limit(0), none).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    scores, ids, sizes = -rng.random((6, 3)).astype(np.float32) * 4, rng.integers(0, 6, 12), np.array([7, 0, 5])
    got = language_id.viterbi(scores, ids, sizes, 1.5)

    def value(path, at):
        return sum(scores[ids[at + t], s] for t, s in enumerate(path)) - 1.5 * sum(
            a != b for a, b in zip(path, path[1:]))

    import itertools
    for at, n in ((0, 7), (7, 5)):
        best = max(value(p, at) for p in itertools.product(range(3), repeat=n))
        assert math.isclose(value(list(got[at:at + n]), at), best, rel_tol=1e-5)


# 4 ---------------------------------------------------------------------------

@pytest.mark.parametrize("options", [{}, {"entropy_share": 0.99, "max_repeats": 1.3},
                                     {"budget_tokens": 3000}, {"lossless": True, "max_repeats": 1.5}])
def test_mixing_matches_its_plan(spark, docs, monkeypatch, options):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    monkeypatch.setattr(mixing, "GROUP_BUCKETS", 3)
    some = docs.withColumn("source", F.expr(
        "case when doc_id % 3 = 0 then 'big' when doc_id % 7 = 0 then null else 's' || doc_id % 4 end"))
    plan = mixing.plan_mixture(some, **options)
    rows = mixing._keyed(some, "doc_id", "text", "source", mixing.SEED).select(
        "row.doc_id", "s", "u", (F.regexp_count("text", F.lit(mixing.WORD_RE)) + 1).alias("t")).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.s] += r.t
    total = sum(tokens.values())
    z = sum((n / total) ** plan.exponent for n in tokens.values())
    want, quotas = set(), {}
    for s, n in tokens.items():
        quota = round((n / total) ** plan.exponent / z * plan.budget)
        quotas[s] = quota = max(quota, n) if options.get("lossless") else quota
        run = 0
        for r in sorted((r for r in rows if r.s == s), key=lambda r: r.u):
            run += r.t
            want |= {(r.doc_id, s, b) for b in range(quota // n + (run <= quota % n))}
    got = mixing._emitted(some, plan, "doc_id", "text", "source", mixing.SEED).select(
        "row.doc_id", "s", "block", "place").collect()
    assert {tuple(r)[:3] for r in got} == want and len(got) == len(want)
    assert all(0 <= r.place < 1 for r in got)
    assert max(quotas[s] / tokens[s] for s in tokens) <= options.get("max_repeats", 4) * 1.01
    if not options:
        share = [q / sum(quotas.values()) for q in quotas.values()]
        entropy = -sum(p * math.log(p) for p in share)
        assert entropy >= 0.95 * math.log(len(share)) - 1e-3
    if options.get("lossless"):
        assert {r.doc_id for r in got} == {r.doc_id for r in rows}


def test_mixing_edges(edge):
    out = mixing.mixed_documents(edge, lossless=True)
    assert out.columns == edge.columns and {r.row for r in out.collect()} == set(range(len(EDGE)))
    assert mixing.mix_sources(edge.limit(0)).count() == 0
    assert mixing.mix_sources(edge.filter("source = 's'")).agg(F.countDistinct("source")).first()[0] == 1


# 5 ---------------------------------------------------------------------------

def test_kneser_ney_probabilities_sum_to_one(docs):
    model = kn_quality.train(docs.limit(60).select("text"), order=3)
    letters = [chr(c) for c in model.alphabet if chr(c).strip()] + ["\U0010fff0"]  # one unknown
    for context in ("the", "Er", "zq"):
        one = kn_quality.log_probabilities([context], model)[1][0]
        after = [context + c for c in letters] + [context + " " + c for c in letters]
        assert 0.98 < np.exp(one - kn_quality.log_probabilities(after, model)[1]).sum() < 1.0001


def test_gram_table_finds_every_key():
    keys = np.unique(np.random.default_rng(1).integers(0, 2 ** 40, 5000))
    t = kn_quality.GramTable(keys, np.arange(len(keys)) + 1)
    assert (t.loss[t.find(keys)] == np.arange(len(keys)) + 1).all()
    missing = t.find(np.array([2 ** 41, 2 ** 42 + 1]))
    assert (missing == len(t.keys)).all() and (t.loss[missing] == 0).all()


def test_quality_scores(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = kn_quality.quality_scores(docs, labels).join(labels, "doc_id")
    r = got.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    rate = {(x.quality, x.toxic): x.kept for x in r}
    assert rate[(1, 0)] > 0.95 and rate[(0, 0)] < 0.2
    edges = kn_quality.quality_scores(edge, labels.filter("false")).collect()
    assert Counter(r.kept for r in edges) == Counter(bool((t or "").strip()) for _, t in EDGE)
    assert kn_quality.quality_scores(docs.limit(0), labels).count() == 0


def test_quality_model_counts_every_trusted_document(spark, monkeypatch):
    """More trusted documents than any sample, and long ones, all go into the counts whole."""
    rows = [(i, "abab") for i in range(4_000)] + [(i, "cd" * 15_000) for i in range(4_000, 4_010)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("x"))
    seen, real = {}, kn_quality.train

    def train(trusted, order):
        seen.update({r.doc_id: len(r.text) for r in trusted.collect()})
        return real(trusted, order)

    monkeypatch.setattr(kn_quality, "train", train)
    kn_quality.quality_scores(docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    ids = {r.doc_id for r in docs.filter("pmod(xxhash64(doc_id), 5) <> 0").collect()}
    assert len(ids) > 3_000 and max(ids) >= 4_000
    assert seen == {i: len(t) for i, t in rows if i in ids}


def test_quality_model_is_the_same_without_cached_grams(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(80)
    texts = [r.text for r in docs.limit(20).collect()] + ["zq漢 漢字", "", "the the the"]
    found = []
    for cached in (1_000_000, 500, 0):
        monkeypatch.setattr(kn_quality, "CACHED", cached)
        model = kn_quality.train(docs.select("text"))
        found.append(kn_quality.log_probabilities(texts, model))
    for lengths, loss in found[1:]:
        assert (lengths == found[0][0]).all() and (loss == found[0][1]).all()


def brute_kneser_ney(texts, asked, order):
    """Losses by the definition: dictionaries of n-grams, continuation counts and three discounts an order."""
    pad = ["\0"] * (order - 1)
    chars = lambda t: pad + list(" ".join(t.split()))
    counts = {order: Counter()}
    for t in texts:
        c = chars(t)
        counts[order].update(tuple(c[i - order + 1:i + 1]) for i in range(order - 1, len(c)))
    for k in range(order, 1, -1):
        counts[k - 1] = Counter(g[1:] for g in counts[k])
    alphabet, n = len(counts[1]), sum(counts[1].values())
    discounts, total, kinds = {}, {}, {}
    for k in range(2, order + 1):
        r = Counter(min(c, 5) for c in counts[k].values())
        n1, n2, n3, n4 = (max(1, r[i]) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discounts[k] = [min(i - .05, max(.05, i - (i + 1) * y * b / a)) for i, a, b in (
            (1, n1, n2), (2, n2, n3), (3, n3, n4))]
        total[k], kinds[k] = Counter(), defaultdict(lambda: [0, 0, 0])
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            kinds[k][g[:-1]][min(c, 3) - 1] += 1

    def p(g):
        k = len(g)
        if k == 1:
            return (counts[1][g] + .5) / (n + .5 * (alphabet + 1)) if g in counts[1] else .5 / (n + .5 * (alphabet + 1))
        if not total[k][g[:-1]]:
            return p(g[1:])
        weight = sum(d * m for d, m in zip(discounts[k], kinds[k][g[:-1]])) / total[k][g[:-1]]
        c = counts[k][g]
        own = (c - discounts[k][min(c, 3) - 1]) / total[k][g[:-1]] if c else 0
        return own + weight * p(g[1:])

    out = []
    for t in asked:
        c = chars(t)
        out.append(-sum(math.log(p(tuple(c[i - order + 1:i + 1]))) for i in range(order - 1, len(c))))
    return out


def test_quality_model_equals_the_definition(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(40).collect()]
    asked = docs[:6] + ["zq漢 漢字", "the the the", "x", " y\n z "]
    for order in (2, 5):
        model = kn_quality.train(spark.createDataFrame([(t,) for t in docs], "text string"), order)
        lengths, loss = kn_quality.log_probabilities(asked, model)
        assert list(lengths) == [len(" ".join(t.split())) for t in asked]
        assert np.allclose(loss, brute_kneser_ney([t for t in docs if t and t.split()], asked, order), rtol=1e-6, atol=1e-4)


def test_quality_model_tells_characters_of_a_large_alphabet_apart(spark):
    text = "".join(chr(0x4E00 + i) for i in range(600))
    model = kn_quality.train(spark.createDataFrame([(text,)] * 3, "text string"))
    loss = kn_quality.log_probabilities([text[400:], text[400:][::-1]], model)[1]
    assert loss[0] * 3 < loss[1]


# 6 ---------------------------------------------------------------------------

def test_full_house_closes_the_fullest():
    bins = best_fit.OpenBins(10, 2)
    assert [bins.place(n) for n in (4, 7)] == [(0, 0), (1, 0)]
    assert bins.place(8) == (2, 0)      # a third one opens: the fullest, number 2 itself, closes
    assert bins.place(2) == (1, 7)      # tightest of those open (3 free beats 6; the closed one had 2)
    assert bins.place(6) == (0, 4) and bins.count == 1
    import random
    sizes = random.Random(1).choices(range(1, 11), k=3000)
    opened = {}
    for limit in (1, 4, 64):
        bins = best_fit.OpenBins(10, limit)
        for n in sizes:
            bins.place(n)
            assert bins.count <= limit
        opened[limit] = bins.opened
    assert opened[1] > opened[4] >= opened[64] >= -(-sum(sizes) // 10)


@pytest.mark.parametrize("capacity,open_bins,per_shard", [(4096, 64, 20_000), (64, 3, 11)])
def test_packing(edge, capacity, open_bins, per_shard):
    got = best_fit.best_fit_pack(edge, TOKENIZER, capacity=capacity, open_bins=open_bins,
                                 per_shard=per_shard, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t in EDGE:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], "<u4").tobytes()
            want[(i, n, at, len(part) // 4, zlib.crc32(part), part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:j]) for j in range(len(found))]
        assert sum(n for _, n in found) <= capacity
    if open_bins > 10:
        assert len(places) <= -(-sum(r.length for r in got) // capacity) + 1
    assert best_fit.best_fit_pack(edge.limit(0), TOKENIZER).count() == 0


def test_word_ids_equal_the_tokenizer():
    found, tokenizer = best_fit.WordIds(open(TOKENIZER).read(), limit=20), Tokenizer.from_file(TOKENIZER)
    for text in ["It's DON'T we'll I'd’s a1b2 x²y ½ ªº µ naïve ÀÉÎ ß × ÷ 日本語 a<|startoftext|>b İstanbul ΣΑΣ",
                 "é é ́x  y z\u0085w \x1cq 's 'S rock'n'roll don''t !!! a_b ſ ﬁ", "", " ", words(80, 9)]:
        assert list(np.frombuffer(found.of(text.encode()), "<u4")) == tokenizer.encode(
            text, add_special_tokens=False).ids


def test_frequent_words_outlive_rare_ones():
    found = best_fit.WordIds(open(TOKENIZER).read(), limit=40)
    asked, model = Counter(), found.parts.model

    class Counted:
        def tokenize(self, part):
            asked[part] += 1
            return model.tokenize(part)

    found.parts.model = Counted()
    rare = ["".join(chr(97 + n // 26 ** d % 26) for d in range(4)) for n in range(2000)]
    frequent = ["some", "of", "these", "return"]
    for at in range(0, len(rare), 10):
        found.of(" ".join(frequent + rare[at:at + 10]).encode())
    assert [asked[w] for w in frequent] == [1] * 4 and max(asked.values()) == 1
    assert len(found) + len(found.older) <= 80


# 7 ---------------------------------------------------------------------------

def test_line_rules(edge):
    got = {r.doc_id: r for r in line_rules.line_rules(edge.filter("doc_id is not null")).collect()}
    for i, t in EDGE:
        if i is None:
            continue
        w = (t or "").encode().split()
        windows = Counter(tuple(w[j:j + 3]) for j in range(len(w) - 2))
        covered = {j + d for j in range(len(w) - 2) if windows[tuple(w[j:j + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(covered), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(x.decode()) for x in w)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert line_rules.line_rules(edge.limit(0)).count() == 0


def test_line_rules_verdict(spark):
    good = "A sentence about something that ends well. " * 12
    rows = [(1, good), (2, good + "\nHome | News | Sport | Login"), (3, "no end here " * 30),
            (4, good + "\nLicensed under the Apache License, Version 2.0."), (5, good.upper()),
            (6, good + "\n" + "word### other$$$ " * 60 + ".")]
    got = {r.doc_id: r for r in line_rules.line_rules(
        spark.createDataFrame(rows, "doc_id bigint, text string"), max_repeat_pct=100).collect()}
    assert [got[i].kept for i in range(1, 7)] == [True, True, False, True, False, False]
    assert got[2].kept_text == good and got[4].n_lines_failed == 1


def test_line_rules_in_other_languages_and_on_links(spark):
    lines = ["Tous droits réservés.", "TOUS DROITS RÉSERVÉS 2020 AFP.", "Politique de confidentialité.", "Conditions d'utilisation.",
             "Alle Rechte vorbehalten.", "Unsere Datenschutzerklärung.", "Todos los derechos reservados.",
             "Lea la Política de Privacidad.", "See https://example.org/a/long/address/of/a/page.html.", "A plain sentence."]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id int, text string")
    got = {r.doc_id: r.n_lines_failed for r in line_rules.line_rules(df).collect()}
    assert [got[i] for i in range(10)] == [1] * 9 + [0]
    none = line_rules.line_rules(df, phrases={"xx": ["plain"]}).collect()
    assert {r.doc_id for r in none if r.n_lines_failed} == {1, 8, 9}


# 8 ---------------------------------------------------------------------------

def brute_components(rows, width, percent):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = low(t).split()
        sets[n] = frozenset(tuple(w[j:j + width]) for j in range(len(w) - width + 1)) if len(
            w) >= width else frozenset([tuple(w)] if w else [])
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if ident(rows[a][0]) == ident(rows[b][0]) and sets[a] and sets[b] or common and \
                    100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                up[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[find(n)] = min(least.get(find(n), 2 ** 63), named(i))
    return Counter((i, len(sets[n]), least[find(n)]) for n, (i, _) in enumerate(rows))


def named(i):
    return 2 ** 63 - 1 if i is None else i


def as_counter(df):
    return Counter((r.doc_id, r.n_shingles, named(r.component_id)) for r in df.collect())


def test_near_components_edges(edge):
    got = minmax_dedup.near_components(edge)
    some = [(i, t) for i, t in EDGE if low(t).split()]
    want = brute_components(some, 3, 85)
    assert as_counter(got.filter("n_shingles > 0")) == want
    assert {r.doc_id for r in got.filter("n_shingles = 0").collect()} == {1, 2, 3, 23, None}
    assert minmax_dedup.near_components(edge.limit(0)).count() == 0


def test_near_components_of_edited_copies(spark):
    rng = np.random.default_rng(7)
    rows = []
    for group in range(4):
        base = words(90, 100 + group).split()
        for copy in range(30):
            text = list(base)
            for _ in range(int(rng.integers(0, 6))):
                text[int(rng.integers(0, 90))] = f"edit{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for width, percent, bands, per in ((3, 85, 24, 5), (5, 80, 30, 4)):
        got = as_counter(minmax_dedup.near_components(df, width=width, percent=percent, bands=bands, rows=per))
        assert got == brute_components(rows, width, percent)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)]
    got = {tuple(r) for r in minmax_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(100, 100), (101, 100), (102, 100)}


def test_near_dedup_keeps_rows_without_an_id_apart(spark):
    a, b, c = words(80, 21), words(80, 22), words(80, 23)
    rows = [(None, a), (None, b), (None, a + " tail"), (None, c), (6, b), (7, b + " tail"), (8, c + " end"), (9, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {(r.doc_id, r.component_id, r.kept) for r in minmax_dedup.near_components(docs).collect()}
    assert got == {(6, 6, True), (7, 6, False), (8, 8, True), (9, 9, True)} | {(None, i, False) for i in (6, 8, 9)}
    nameless = [(r.component_id, r.kept) for r in minmax_dedup.near_components(docs.filter("doc_id is null")).collect()]
    assert {c for c, _ in nameless} == {None} and sum(k for _, k in nameless) == 3
    left = sorted(r.text for r in minmax_dedup.near_dedup(docs).collect())
    assert len(left) == 3 and [sum(t.startswith(x) for t in left) for x in (a, b, c)] == [1, 1, 1]


# 9 ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def trees():
    return html_extract.train()


PARAGRAPH = "After two hours we reached the hut. It was closed, but the view was worth it."
ARTICLE = ("<h1>A day in the hills</h1><p>We left the village early in the morning, and the rain had stopped. The path "
           f"was steep.</p><p>{PARAGRAPH}</p><p>On the way down we met nobody. The bus was late again.</p>")
ARTICLE_TEXT = ("A day in the hills\nWe left the village early in the morning, and the rain had stopped. The path was "
                f"steep.\n{PARAGRAPH}\nOn the way down we met nobody. The bus was late again.")
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li><li><a href="/c">Contact</a></li></ul></nav>'
FOOT = "<footer>Copyright 2020 Someone</footer>"
# Pages written by hand, apart from training: furniture words on bodies, wrappers and articles.
HAND_PAGES = [
    (f"<html><body class='{c}'>{NAV}{w % ARTICLE}{FOOT}</body></html>", ARTICLE_TEXT)
    for c in ("page sidebar-right", "no-sidebar", "home blog search-results", "post-template header-image",
              "has-comments", "single single-post", "nav-open modal-open")
    for w in ("<article>%s</article>", "<div class='post'>%s</div>", "<main>%s</main>", "<div>%s</div>")
] + [
    (f"<html><body>{NAV}<{t} class='{c}'>{ARTICLE}</{t}>{FOOT}</body></html>", ARTICLE_TEXT)
    for c in ("widget", "content with-ads", "post form-post", "article share-enabled", "related-wrapper",
              "entry has-comments") for t in ("article", "main", "div")
] + [
    (f"<body>{NAV}<article><h1>T one two</h1>{inside}<p>{PARAGRAPH}</p></article>{FOOT}", f"T one two\n{text}{PARAGRAPH}")
    for inside, text in (
        ("<svg width=1 /><p>Some words stand here. And more.</p>", "Some words stand here. And more.\n"),
        ("<svg><svg><text>no</text></svg><text>no</text></svg>", ""), (f"<svg><p>{PARAGRAPH}</p>", f"{PARAGRAPH}\n"),
        ("<p>So we know that <math><mi>x</mi></math> is small. And more follows here.</p>",
         "So we know that x is small. And more follows here.\n"))
] + [
    (f"<body>{NAV}<article><header><h1>T one two</h1></header><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></article>{FOOT}",
     f"T one two\n{PARAGRAPH}\n{PARAGRAPH}"),
    (f"<body><header><h2>Site</h2></header>{NAV}<div class=post><header><h1>T one two</h1></header><p>{PARAGRAPH}</p>"
     f"<p>{PARAGRAPH}</p></div>{FOOT}", f"T one two\n{PARAGRAPH}\n{PARAGRAPH}"),
    (f"<body>{NAV}<article><h1>T one two</h1><p>{PARAGRAPH}</p></article><div class=comments>"
     + "<div><b>Bob</b><p>I like this a lot. Really good.</p></div>" * 6 + f"</div>{FOOT}", f"T one two\n{PARAGRAPH}"),
    (f"<body class=has-sidebar>{NAV}<div class='container'><div id=content>{ARTICLE}</div><div id=sidebar><h3>Related"
     f"</h3><p>Read our other stories. They are good.</p></div></div>{FOOT}", ARTICLE_TEXT),
]


def test_extract_pages_written_by_hand(trees):
    wrong = [(page, html_extract.extract(page, trees)) for page, text in HAND_PAGES
             if html_extract.extract(page, trees) != text]
    assert len(HAND_PAGES) == 54 and len(wrong) <= 1, wrong


def test_labels_do_not_come_from_class_words():
    page = html_extract.Page(f"<body class=ad><div class=menu>{NAV}<article class=widget>{ARTICLE}</article></div></body>")
    bare = html_extract.Page(f"<body><div>{NAV}<article>{ARTICLE}</article></div></body>")
    assert (html_extract.semantic_labels(page) == html_extract.semantic_labels(bare)).all()


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain text only here.", "plain text only here."),
    ("<p>Hello &amp; world&nbsp;x.</p>", "Hello & world x."), ("<nav><a href=x>A</a></nav>", ""),
    ('<div class="sidebar"><p>Some text. More.</p></div><div class="post"><h1>T</h1><p>First para one two '
     'three.</p><p>Second  para\n with words.</p><div class="comments"><p>Nice article, thanks.</p></div></div>'
     '<footer>&copy; x</footer>', "T\nFirst para one two three.\nSecond para with words."),
    ('<header><h1>Site</h1></header><main><h2>Title</h2><p>a b c d. e f.<aside>See also</aside><form>Name '
     '<input></form></main><div id="cookie-notice">We use cookies.</div><script>var a="</p>";</script>',
     "Title\na b c d. e f."),
])
def test_extract(trees, page, text):
    assert html_extract.extract(page, trees) == text


def test_extract_generated_layouts(trees):
    rng, exact = np.random.default_rng(99), 0
    for _ in range(100):
        page, label = html_extract._layout_labels(html_extract._layout(rng))
        want = "\n".join(t for owner, t in page.blocks if label[owner] == 1)
        exact += html_extract.article_text(page, trees.probability(html_extract.features(page))) == want
    assert exact >= 93


def test_extract_pages(spark):
    import html
    import re
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    model = html_extract.train(pages)
    got = {r.page_id: r for r in html_extract.extract_pages(pages, model).collect()}
    for r in pages.collect():
        body = re.search("<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        blocks = re.sub("<[^>]*>", "", re.sub("</?(p|h1)>", "\0", body.replace("<br>", " "))).split("\0")
        want = "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>cut <a href=\"x", 2), (1, "u", "<b" * 9000, 3)],
                                "page_id bigint, url string, html string, text int")
    assert len(html_extract.extract_pages(odd, model).collect()) == 3
    assert html_extract.extract_pages(odd.limit(0), model).count() == 0


# 10 --------------------------------------------------------------------------

def brute_windows(rows, width):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for a in range(len(w) - width + 1):
            x = tuple(w[a:a + width])
            first[x] = min(first.get(x, ident(i)), ident(i))
    out = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {a + j for a in range(len(w) - width + 1) if first[tuple(w[a:a + width])] < ident(i)
                for j in range(width)}
        out[(i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())] += 1
    return out


@pytest.mark.parametrize("width,per_range,chunk", [(50, 1_000_000, 1_000_000), (50, 300, 200), (2, 300, 200)])
def test_window_dedup(edge, monkeypatch, width, per_range, chunk):
    monkeypatch.setattr(window_dedup, "CHUNK", chunk)
    got = Counter(map(tuple, window_dedup.window_dedup(edge, width=width, per_range=per_range).collect()))
    assert got == brute_windows(EDGE, width)
    assert sum(k[2] for k in got) > 0
    assert window_dedup.window_dedup(edge.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [2, 6, 10])
def test_window_dedup_survives_collisions_of_a_round(spark, bits):
    """With so few bits nearly every window of the first round collides with others; the second round clears them."""
    rng = np.random.default_rng(bits)
    shared = words(30, 77)
    rows = [(i, " ".join([words(int(rng.integers(0, 40)), 900 + i), shared if i % 3 else "", words(20, 950 + i)]))
            for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    true = {(r.k, s) for r in window_dedup.repeated_windows(docs, width=10).collect() for s in r.starts}
    got = {(r.k, s) for r in window_dedup.repeated_windows(docs, width=10, hash_bits=bits).collect() for s in r.starts}
    seen, want = {}, set()
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 9):
            if seen.setdefault(tuple(w[j:j + 10]), i) < i:
                want.add((i, j))
    assert want and true == want and got == want


# the pipeline ----------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = spark.createDataFrame([(900_001, "12 34 !!", "en", "src0", 8), (900_002, None, None, None, None)],
                                  docs.schema)
    docs = docs.unionByName(extra)
    kept = {}
    for i, (name, stage) in enumerate(P.STAGES):
        out = str(tmp_path / str(i))
        before = docs.columns
        stage(spark, docs, SF_SMALL).write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if i < len(P.STAGES) - 1:
            assert docs.columns == before
    all_rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert set(kept["language_id"]) == {r.doc_id for r in all_rows if any(c.isalpha() for c in r.text)}
    largest = {}
    for r in all_rows:
        largest[low(r.text)] = max(largest.get(low(r.text), r.doc_id), r.doc_id)
    assert sorted(kept["exact_dedup"]) == sorted(set(largest.values()) & set(kept["language_id"]))
    rows = [(r.doc_id, r.text) for r in all_rows if r.doc_id in set(kept["exact_dedup"])]
    assert sorted(kept["near_dedup"]) == sorted({c for _, _, c in brute_components(rows, 5, 80)})
    assert set(kept["source_mixing"]) == set(kept["near_dedup"])
    packed = docs.groupBy("doc_id").agg(F.sum("length").alias("n")).count()
    assert packed == len(set(kept["source_mixing"]))


def test_entry_registers_the_operators():
    import __spark_entry__ as E
    found = [n for n in E.queries() if n.startswith("op") and n[2:3].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
    assert "pipeline" in E.queries() and os.path.exists("/root/testdata")
