from pyspark.sql import functions as F

from sifter.functions import cleanup as CU
from sifter.functions import text as TX
from sifter.functions import vectors as V


def one(spark, expr, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_tokenize_deletes_punctuation(spark):
    assert one(spark, TX.tokenize("t"), "A-b, C.d  e_f!") == ["ab", "cd", "e_f"]


def test_tokenize_unicode_letters_and_spaces(spark):
    # Non-ASCII letters are word characters; NBSP and ideographic space split.
    assert one(spark, TX.tokenize("t"), "Élan naïve　x²") == ["élan", "naïve", "x²"]


def test_split_sentences_drops_terminators(spark):
    assert one(spark, TX.split_sentences("t"), " One. Two!! three?  ...") == ["One", "Two", "three"]


def test_value_counts(spark):
    m = one(spark, TX.term_frequencies(TX.tokenize("t")), "b a b c b")
    assert dict(m) == {"a": 1, "b": 3, "c": 1}
    assert dict(one(spark, TX.term_frequencies(TX.tokenize("t")), "")) == {}


def test_cosine_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(V.cosine("a", "b")).first()[0] == 0.0


def test_hashed_embedding_is_normalised(spark):
    v = one(spark, V.hashed_embedding("t"), "alpha beta gamma alpha")
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1.0) < 1e-9


def test_unescape_order(spark):
    # The first rule consumes the second backslash of "\\\\n" before the "\\\\" rule runs.
    assert one(spark, CU.unescape("t"), "a\\nb\\tc\\\\n\\q") == "a\nb\tc\\\nq"


def test_clean_flat_and_lines(spark):
    assert one(spark, CU.clean_flat("t"), "  a\\n\\n\\n b   c ") == "a b c"
    assert one(spark, CU.clean_lines("t"), "a   b\n\n\n\nc ") == "a b\n\nc"
    assert one(spark, CU.clean_flat("t"), None) == ""


def test_strip_markdown_code(spark):
    assert one(spark, CU.strip_markdown_code("t"), "x ```py\ncode\n``` `y`\n\n\n z") == "x  y\n\n z"


def test_strip_reasoning(spark):
    text = "<think>hidden\nmore</think>Begin! This is VERY important to you, your job depends on it!Thought: plan\nAnswer `x`"
    assert one(spark, CU.strip_reasoning("t"), text) == "Answer x"


def test_cut_at_marker(spark):
    assert one(spark, CU.cut_at_marker("t"), "post line\nmore\n---\nCharacter count: 10") == "post line\nmore"
    assert one(spark, CU.cut_at_marker("t"), "no marker\n---\nx") == "no marker\n---\nx"


def test_paragraphise(spark):
    assert one(spark, CU.paragraphise("t"), "") == "No content"
    assert one(spark, CU.paragraphise("t"), "a\nb\nc\nd\ne") == "a\nb\nc\nd\ne"
    assert one(spark, CU.paragraphise("t"), "Intro. Next part - item") == "Intro. \nNext part \n- item"


def test_markdown_table_and_cap(spark):
    text = "| Name | Description |\n|---|---|\n| [vpc](http://x) | A VPC | extra |\n## Inputs\nSource: git"
    out = one(spark, CU.format_markdown("t"), text)
    assert out == ("**Name** | **Description**\n• **vpc**: A VPC extra\n\n🔷 **Inputs**\n  🔗 Source: git")
    long = "\n".join(f"line {i}" for i in range(150))
    capped = one(spark, CU.format_markdown("t"), long).split("\n")
    assert capped[99] == "line 99" and capped[-1] == "📊 Total: 150 lines, showing first 100"


def test_extract_json_and_date(spark):
    assert one(spark, CU.extract_json_object("t"), 'ok {"a": {"b": 1}} tail') == '{"a": {"b": 1}}'
    assert one(spark, CU.extract_json_object("t"), "none") is None
    assert one(spark, CU.date_part("t"), "2024-05-01T10:00:00Z") == "2024-05-01"
    assert one(spark, CU.date_part("t"), None) == "N/A"


def test_merge_metadata_chunk_wins(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "x", "c": "y"})],
                               "d map<string,string>, c map<string,string>")
    assert dict(df.select(TX.merge_metadata("d", "c")).first()[0]) == {"a": "1", "b": "x", "c": "y"}


def test_name_slug(spark):
    assert one(spark, TX.name_slug("t"), "org/model-7b") == "org_model_7b"
