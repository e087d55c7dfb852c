"""Subword tokens against a WordPiece model over the same vocabulary, and user chunkers."""

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from conftest import SF_ORACLE
from sifter.functions import formatting as fmt
from sifter.functions import subwords as SW
from sifter.operators import chunking as C
from sifter.plans import tables as T


@pytest.fixture(scope="module")
def vocabulary(spark):
    """Pieces of a public vocabulary as a table: those with a word marker start words, the others continue them."""
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {"[UNK]": 0}
    for i in range(259, sp.get_piece_size()):
        p = sp.id_to_piece(i)
        ids.setdefault(p[1:] if p.startswith("▁") else "##" + p, len(ids))
    ids.pop("", None)
    table = spark.createDataFrame(list(ids.items()), "piece string, id int")
    library = Tokenizer(models.WordPiece(ids, unk_token="[UNK]", max_input_chars_per_word=100))
    library.pre_tokenizer = pre_tokenizers.Whitespace()
    return SW.read_vocabulary(table, "[UNK]"), library


def test_tokens_equal_a_wordpiece_model(spark, vocabulary):
    ours, library = vocabulary
    extra = [(-1, None), (-2, ""), (-3, "x" * 200 + " Ünïcödé... don't 漢字 a_b 1,5 ́"), (-4, "🙂 ##a [UNK] \t\n")]
    docs = T.documents(spark, SF_ORACLE).select("doc_id", "text").unionByName(
        spark.createDataFrame(extra, "doc_id bigint, text string"))
    n = 0
    for r in SW.subword_tokens(docs, ours).collect():
        want = library.encode(r.text or "", add_special_tokens=False)
        assert [t.id for t in r.tokens] == want.ids and [(t.first, t.last) for t in r.tokens] == want.offsets
        n += len(r.tokens)
    assert n > 500_000
    with pytest.raises(ValueError, match="no piece"):
        SW.read_vocabulary(spark.createDataFrame([("a", 1)], "piece string, id int"), "[UNK]")


def test_windows_and_padding_by_those_ids(spark, vocabulary):
    ours, library = vocabulary
    docs = T.documents(spark, SF_ORACLE).where("doc_id < 60")
    texts = {r.doc_id: r.text for r in docs.collect()}
    chunks = {}
    for r in C.subword_chunks(docs, ours, 100, 20, kb_col=F.col("source")).collect():
        chunks.setdefault(r.doc_id, {})[r.chunk_ord] = r.text
    for i, text in texts.items():
        at = library.encode(text or "", add_special_tokens=False).offsets
        want, k = [], 0
        while at:
            part = at[k:k + 100]
            want.append(text[part[0][0]:part[-1][1]])
            if k + 100 >= len(at):
                break
            k += 80
        assert [chunks.get(i, {})[n] for n in sorted(chunks.get(i, {}))] == want
    padded = SW.subword_tokens(docs, ours).select("doc_id", fmt.pad_truncate(SW.token_ids(), 16).alias("ids")).collect()
    for r in padded:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids[:16]
        assert r.ids == ids + [0] * (16 - len(ids))


def test_user_chunkers_emit_many_rows(spark):
    def load():
        def chunk(text):
            if "boom" in text:
                raise RuntimeError("no way")
            return [p for p in text.split("|") if p]
        return chunk

    docs = spark.createDataFrame([("a", "x|y|z", "k"), ("b", "boom", "k"), ("c", "", "l"), ("d", None, "l"), ("e", "one", "l")],
                                 "doc_id string, text string, kb string")
    got = C.chunk_documents(docs, "bars", kb_col=F.col("kb"), chunkers={"bars": load})
    assert got.columns[:7] == C.token_chunks(docs, kb_col=F.col("kb")).columns
    assert {(r.chunk_id, r.text, r.kb_name, r._error) for r in got.collect()} == {
        ("a#0", "x", "k", None), ("a#1", "y", "k", None), ("a#2", "z", "k", None), ("e#0", "one", "l", None),
        ("b#0", None, "k", "RuntimeError: no way")}
    C.register_chunker(spark, "bars", load)
    docs.where("doc_id <> 'b'").createOrReplaceTempView("bar_docs")
    rows = spark.sql("SELECT d.doc_id, c.chunk_ord, c.text FROM bar_docs d, LATERAL bars(d.text) c").collect()
    assert {tuple(r) for r in rows} == {("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("e", 0, "one")}
