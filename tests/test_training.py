from pyspark.sql import functions as F

from sifter.functions import formatting as fmt
from sifter.operators import training_data as TD

MSG = "array<struct<role:string,content:string>>"


def test_instruction_input_absent(spark):
    df = spark.createDataFrame([("Do", None, "ok"), ("Do", "", "ok"), ("Do", "ctx", "ok")],
                               "instruction string, input string, output string")
    out = [r[0] for r in TD.format_dataset(df, "instruction").collect()]
    assert out[0] == out[1] == "### Instruction:\nDo\n\n### Response:\nok"
    assert out[2] == "### Instruction:\nDo\n\n### Input:\nctx\n\n### Response:\nok"


def test_chat_systems_prepended_reversed(spark):
    msgs = [("user", "hi"), ("system", "S1"), ("assistant", "yo"), ("system", "S2"), ("tool", "x")]
    df = spark.createDataFrame([(msgs,)], f"messages {MSG}")
    assert df.select(fmt.chat_text("messages")).first()[0] == \
        "System: S2\n\nSystem: S1\n\nHuman: hi\n\nAssistant: yo"
    assert df.select(fmt.chat_prompt("messages")).first()[0] == \
        "Human: hi\n\nSystem: S1\n\nAssistant: yo\n\nSystem: S2\n\nAssistant:"
    empty = spark.createDataFrame([([],)], f"messages {MSG}")
    assert empty.select(fmt.chat_text("messages")).first()[0] == ""


def test_completion_and_classification(spark):
    df = spark.createDataFrame([("p", None, "t", "1")], "prompt string, completion string, text string, label string")
    assert TD.format_dataset(df, "completion").first()[0] == "p"
    assert TD.format_dataset(df, "classification").first()[0] == "Text: t\nLabel: 1"


def test_exact_split_sizes_and_disjoint(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "rid")
    s = TD.exact_split(df, "rid", 0.1, 42, rows_per_bucket=100)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts["train"] == round(1003 * 0.9) and counts["train"] + counts["eval"] == 1003
    assert s.select("rid").distinct().count() == 1003
    # Same rows as a single global ranking by the seeded hash.
    ref = (df.withColumn("h", TD.seeded_hash("rid", 42)).orderBy("h", "rid").limit(counts["train"])
           .select("rid"))
    assert ref.exceptAll(s.where(F.col("split") == "train").select("rid")).count() == 0
    assert TD.exact_split(df, "rid", 0.0).where(F.col("split") == "eval").count() == 0


def test_pad_truncate(spark):
    df = spark.createDataFrame([("a b c",), ("",), (" ".join(["w"] * 20),)], "text string")
    out = TD.tokenize_fixed(df, "text", 8).collect()
    assert all(len(r["input_ids"]) == 8 == len(r["attention_mask"]) == len(r["labels"]) for r in out)
    assert out[0]["attention_mask"] == [1, 1, 1, 0, 0, 0, 0, 0]
    assert out[0]["labels"][3:] == [-100] * 5 and out[0]["labels"][:3] == out[0]["input_ids"][:3]
    assert out[1]["attention_mask"] == [0] * 8 and out[2]["attention_mask"] == [1] * 8


def test_calibration_limit_before_filter(spark):
    df = spark.createDataFrame([(1, "a"), (2, "  "), (3, None), (4, "d")], "i int, text string")
    assert [r["text"] for r in TD.calibration_sample(df, "i", 3).collect()] == ["a"]


def test_validate(spark):
    ok = spark.createDataFrame([("t", "1")], "text string, label string")
    assert TD.validate_classification(ok).first()["ok"]
    bad = spark.createDataFrame([("t",)], "text string")
    r = TD.validate_classification(bad).first()
    assert not r["ok"] and "target" in r["reason"]
    assert TD.to_training_columns(ok).columns == ["text", "target"]
