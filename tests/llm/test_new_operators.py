"""SentencePiece coding, phrase mining and conversation repair against brute force."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL
from sifter.llm import phrase_mining, piece_codec, queries, turn_repair

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "  a", "a ", "a  \n b\n\nc", "▁x ▁▁y", "\n", "\n ", "a\x00b\t\tc", "é漢" * 50,
         "<s> </s> <unk> <0x0A>", "🙂🙂 🙂", " " * 40 + "x", "x" * 5000, "ab cd\n" * 60_000, "ab cd", "ab cd"]


# 11 --------------------------------------------------------------------------

def test_codec_equals_the_library(spark):
    rows = [(n, t, "clash", n) for n, t in enumerate(TEXTS)] + [(None, "null id", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int").repartition(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {}
    for i, t, *_ in rows:
        ids = sp.encode(t or "")
        want[i] = (len(ids), ids, sp.decode(ids))
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in piece_codec.encode_decode(df, MODEL).collect()}
    assert got == want
    assert piece_codec.encode_decode(df.limit(0), MODEL).count() == 0


def test_codec_query_on_whole_table(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {}
    for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").collect():
        ids = sp.encode(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in queries.op11_sentencepiece_codec(spark, SF_ORACLE).collect()}
    assert got == want


def test_codec_table_starts_anew_and_takes_inseparable_models(monkeypatch):
    with open(MODEL, "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    table = piece_codec.ChunkTable(model, limit=3)
    for t in TEXTS[2:14] * 2:
        ids, decoded = table.code(t)
        assert (np.frombuffer(ids, "<i4").tolist(), decoded) == (sp.encode(t), sp.decode(sp.encode(t)))
    assert len(table.ids) <= 20
    monkeypatch.setattr(piece_codec, "separable", lambda model: False)
    whole = piece_codec.ChunkTable(model)
    assert whole.code("a b\nc") == (np.array(sp.encode("a b\nc"), "<i4").tobytes(), "a b\nc")


# 12 --------------------------------------------------------------------------

def brute_phrases(rows, least, longest, top):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for end in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(end, ".")
        for piece in low.split("."):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            total[lang] += len(w)
            for n in range(1, longest + 1):
                count[lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = set()
    for lang, f in count.items():
        f = {p: a for p, a in f.items() if a >= least}
        found = []
        for p, a in f.items():
            if len(p) == 1 or any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q)))
                                  for q, b in f.items()):
                continue
            score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                        for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return out


def phrase_rows(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "日本", "A'b", "a'B"]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    rows = [(None, None), ("en", ""), ("en", " \t\n . "), (None, "x y z x y z X Y Z"), ("en", "p q r s t u v " * 9)]
    for n in range(60):
        w = rng.choice(vocabulary, int(rng.integers(1, 60)), p=p / p.sum())
        ends = rng.choice([" ", "  ", ". ", "\t", "\n", ",", "\x0b", ":"], len(w), p=[.6, .1, .1, .05, .05, .05, .02, .03])
        rows.append(("en" if n % 3 else "日", "".join(a + b for a, b in zip(w, ends))))
    return rows


@pytest.mark.parametrize("least,longest,per_part", [(3, 5, 4_000_000), (2, 4, 40), (1, 3, 100)])
def test_phrases_by_counting_everything(spark, least, longest, per_part):
    rows = phrase_rows(least)
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows + rows[-1:]],
                               "lang string, text string, phrase string, f int").repartition(3)
    got = [tuple(r) for r in phrase_mining.mine_phrases(
        df, min_count=least, longest=longest, per_part=per_part, top=40).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(rows + rows[-1:], least, longest, 40)


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrase_mining.mine_phrases(df).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_dense_and_sparse_tiles_agree(parts, monkeypatch):
    rng = np.random.default_rng(6)
    left, right = rng.integers(0, 9000, 40_000) ** 2 // 9000, rng.integers(0, 5000, 40_000) ** 2 // 5000
    want = {k: v for k, v in Counter(zip(left.tolist(), right.tolist())).items() if v >= 3}
    tiling = phrase_mining.Tiling(parts, 9000, 5000)
    of_part, of_tile, keys = tiling.locate(left, right)
    for cells in (1 << 25, 1 << 20, 0):
        monkeypatch.setattr(phrase_mining, "DENSE_CELLS", cells)
        monkeypatch.setattr(phrase_mining, "COMPACT", 500)
        got, kinds = {}, set()
        for part, number in sorted(set(zip(of_part.tolist(), of_tile.tolist()))):
            tile = phrase_mining._Tile(part, number, tiling)
            kinds.add(tile.dense is None)
            for some in np.array_split(keys[(of_part == part) & (of_tile == number)], 7):
                tile.add(some, np.ones(len(some), np.int64))
            for r in tile.frequent(3).to_pylist():
                got[(r["l_id"], r["r_id"])] = r["f"]
                assert r["key"] == tiling.locate(np.array([r["l_id"]]), np.array([r["r_id"]]))[2][0]
        assert got == want
        assert kinds == ({False} if cells == 1 << 25 else {True} if not cells else {True, False})


# 13 --------------------------------------------------------------------------

def brute_repair(rows):
    """Rows (role, text, blank-or-duplicate, truncated) -> (cost, audit, repaired) by trying every edit."""
    best = None
    allowed = {"": {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}
    name = {"u": "user", "a": "assistant"}
    todo = [(0, "", "", [], 0)]
    while todo:
        cost, audit, last, out, at = todo.pop()
        if best is not None and cost > best[0]:
            continue
        if at == len(rows) and last in ("", "a"):
            new = (cost, audit, out)
            if best is None or new[:2] < best[:2]:
                best = new
        if audit[-3:] != "III":
            for x in allowed[last] - {"s"}:
                todo.append((cost + 5, audit + "I", x, [*out, (name[x], "")], at))
        if at < len(rows):
            role, text, gone, cut = rows[at]
            todo.append((cost + 2, audit + "D", last, out, at + 1))
            if not gone:
                for x in allowed[last]:
                    if x == role[:1]:
                        todo.append((cost + 5 * cut, audit + "K", x, [*out, (role, text)], at + 1))
                    if x != "s":
                        todo.append((cost + 5 * cut + 1, audit + "R", x, [*out, (name[x], text)], at + 1))
    return best


def brute_conversations(rows, repair=brute_repair):
    """The query's rows for (conv, turn, role, text) rows, from the definition."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        sp = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rs in convs.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, count = set(), [], [0, 0, 0]
        for _, role, text in rs:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end not in ".!?" else None
            if fault is not None:
                count[fault] += 1
            seen.add((role, text))
            marked.append((role, text, fault in (0, 1), fault == 2))
        turns = [t for t, *_ in rs if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        cost, audit, kept = repair(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def random_conversations(n, longest, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for conv in range(n):
        for turn in range(int(rng.integers(1, longest + 1))):
            role = str(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]))
            text = str(rng.choice(["Hi.", "Who?", "cut", "", " \t", "Yes!", f"t{turn}."]))
            rows.append((conv, None if rng.random() < .05 else turn, None if rng.random() < .03 else role,
                         None if rng.random() < .03 else text))
    return rows + [(None, 1, "user", "x."), (None, 2, "assistant", "y."), (None, None, None, None)]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digests(df):
    return {r[0]: tuple(r)[1:] for r in turn_repair.repair_digest(turn_repair.damaged(df)).collect()}


@pytest.mark.parametrize("partitions", ["1", "40"])
def test_repair_by_trying_every_edit(spark, partitions):
    rows = random_conversations(120, 6, 1)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", seg string, cost int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert digests(df) == brute_conversations(rows)
        assert digests(df.limit(0)) == {}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def string_repair(rows):
    """The same programme with whole strings, for long conversations."""
    states = {"": (0, "", ())}
    name = {"u": "user", "a": "assistant"}
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    for role, text, gone, cut in rows:
        after = {}
        for last, (cost, audit, out) in states.items():
            options = [(last, cost + 2, "D", None)]
            for x in () if gone else allowed[last]:
                if x == role[:1]:
                    options.append((x, cost + 5 * cut, "K", (role, text)))
                if x != "s":
                    options.append((x, cost + 5 * cut + 1, "R", (name[x], text)))
            for x, c, letter, row in options:
                new = (c, audit + letter, (out, row) if row else out)
                if x not in after or new[:2] < after[x][:2]:
                    after[x] = new
        states = after
    cost, audit, out = min((states[x] for x in ("", "a") if x in states), key=lambda s: s[:2])
    kept = []
    while out:
        out, row = out
        kept.append(row)
    return cost, audit, kept[::-1]


def test_repair_of_one_conversation_over_many_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(7, t // 2, str(rng.choice(["user", "assistant", "system"])),
             str(rng.choice(["Same.", "cut", f"Line {t}.", f"Line {t % 50}!", "z" * 300 + "."]))) for t in range(3000)]
    rows += random_conversations(30, 5, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = turn_repair.repair(turn_repair.damaged(df))
        assert made.pieces.filter("conv_id = 7").count() >= 10
        assert digests(df) == brute_conversations(rows, string_repair)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_audits_compare_as_strings_and_survive_collisions(monkeypatch):
    rng = np.random.default_rng(5)
    for modulus in (turn_repair.HASH_MOD, 3):  # 3: nearly every pair collides
        monkeypatch.setattr(turn_repair, "HASH_MOD", modulus)
        nodes = [(turn_repair.Audit("", None), "")]
        for _ in range(300):
            node, text = nodes[int(rng.integers(len(nodes)))]
            letter = str(rng.choice(list("DIKR")))
            nodes.append((turn_repair.Audit(letter, node), text + letter))
        assert all(n.text() == t for n, t in nodes)
        for (a, x), (b, y) in itertools.product(nodes[::3], nodes[::2]):
            assert turn_repair.audit_less(a, b) == (x < y)


def test_insertions_when_they_are_cheapest():
    dear = turn_repair.Costs(rerole=9, delete=20, insert=1, truncated=0)
    table = turn_repair.cheapest([("u", False, False), ("u", False, False), ("a", False, False)], 0, dear, True)
    cost, node = turn_repair._best_final(table)
    assert (cost, node.text()) == (1, "KIKK")
    assert list(turn_repair.repaired_rows([("user", "x"), ("user", "y"), ("assistant", "z")], "KIKK", 0)) == [
        ("user", "x"), ("assistant", ""), ("user", "y"), ("assistant", "z")]


def test_every_block_gets_the_ids_of_its_ranked_words(spark):
    held = spark.createDataFrame([(b, lang, at, w) for b, lang in ((1, "en"), (2, "en"), (3, "de"))
                                  for at, w in enumerate("abcd"[:b + 1])], "block bigint, lang string, at int, word string")
    words = spark.createDataFrame([(7, "en", "b"), (8, "en", "c"), (9, "fr", "a")], "id bigint, lang string, word string")
    got = {r.block: sorted((x["at"], x["id"]) for x in r.found) for r in phrase_mining._ids_by_block(held, words).collect()}
    assert got == {1: [(1, 7)], 2: [(1, 7), (2, 8)], 3: []}
