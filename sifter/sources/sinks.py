"""Sinks (A12-A15): evaluation outputs, training CSV, question sets, metric log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.operators.results import numeric_value


def write_evaluation(details: DataFrame, summary: DataFrame, metadata: DataFrame,
                     out_dir: str) -> None:
    """Details CSV, metadata JSON and the summary report text in one folder.

    Array columns of the details are rendered as JSON text for CSV."""
    flat = details.select(*[F.to_json(F.col(c)).alias(c) if t.startswith("array") or
                            t.startswith("map") or t.startswith("struct") else F.col(c)
                            for c, t in details.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(f"{out_dir}/detailed_results")
    metadata.write.mode("overwrite").json(f"{out_dir}/metadata")
    summary.select(F.col(summary.columns[0]).alias("value")).write.mode("overwrite").text(
        f"{out_dir}/summary_report")


def write_training_csv(df: DataFrame, path: str, label_col: str = "label") -> None:
    """Rename the label column to ``target`` and write a header CSV."""
    out = df.withColumnRenamed(label_col, "target") if label_col in df.columns else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_question_set(questions: DataFrame, path: str, kb_col: str = "kb_name",
                       generated_at: str | None = None) -> None:
    """``{kb_name, questions, ground_truths: null, metadata{generated_at,
    num_questions}}`` per KB, nulls kept."""
    ts = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(),
                                                                "yyyy-MM-dd'T'HH:mm:ss")
    per_kb = questions.groupBy(kb_col).agg(F.transform(F.array_sort(F.collect_list(
        F.struct("question_id", "question"))), lambda x: x["question"]).alias("questions"))
    doc = per_kb.select(F.to_json(F.struct(
        F.col(kb_col).alias("kb_name"), "questions",
        F.lit(None).cast("array<array<string>>").alias("ground_truths"),
        F.struct(ts.alias("generated_at"), F.size("questions").alias("num_questions"))
        .alias("metadata")), {"ignoreNullFields": "false"}).alias("value"))
    doc.write.mode("overwrite").text(path)


def metric_records(df: DataFrame, name_col: str, value_col: str, ts_col: str,
                   step_col: str | None = None, start_ts=None) -> DataFrame:
    """A15 projection: (name, value, step); non-numeric values are skipped;
    the default step is whole seconds since the start time (the earliest
    timestamp when no start is given: a one-row aggregate, broadcast)."""
    value = numeric_value(F.col(value_col).cast("string"))
    base = df
    if step_col:
        step = F.col(step_col).cast("bigint")
    else:
        if start_ts is None:
            base = df.crossJoin(F.broadcast(df.agg(F.min(ts_col).alias("_start"))))
            start = F.col("_start")
        else:
            start = F.lit(start_ts)
        step = ((F.unix_micros(F.col(ts_col).cast("timestamp"))
                 - F.unix_micros(start.cast("timestamp"))) / 1_000_000).cast("bigint")
    return base.select(F.col(name_col).alias("name"), value.alias("value"), step.alias("step"),
                       F.col(ts_col).alias("ts")).where(F.col("value").isNotNull())


def append_metrics(records: DataFrame, path: str) -> None:
    """Append to the metric table."""
    records.write.mode("append").parquet(path)
