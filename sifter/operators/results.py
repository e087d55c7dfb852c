"""Benchmark-result and training-log analytics (A6, A7, B3, B7, B8, D6-D9, D14,
E4, E5, H33-H35, H43, L1-L7).

Results arrive as JSON text ``{"results": {task: {metric: value}}, "config": {...}}``
(one document per run/model). Everything is flattened to the long table
``(model, task, metric, value DOUBLE)`` and analysed with aggregations; no
group is ever collected whole except bounded dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sifter.functions.text import name_slug
from sifter.plans.sizing import bounded_broadcast, literal_dimension

# Values keep their JSON type: a metric is a number, not a string that looks like one.
RESULTS_SCHEMA = "results map<string, map<string, variant>>, config map<string, string>"

# Benchmark suites and the listing groups (task order matters).
BENCHMARK_SUITES = {
    "standard": ["hellaswag", "arc_easy", "arc_challenge", "winogrande", "piqa"],
    "reasoning": ["hellaswag", "arc_challenge", "winogrande", "mathqa", "gsm8k"],
    "knowledge": ["arc_easy", "arc_challenge", "mmlu", "truthfulqa_mc1", "truthfulqa_mc2"],
    "comprehensive": ["hellaswag", "arc_easy", "arc_challenge", "winogrande", "piqa", "mmlu",
                      "truthfulqa_mc1", "gsm8k"],
}
TASK_GROUPS = [
    ("standard", ["hellaswag", "arc_easy", "arc_challenge", "winogrande", "piqa"]),
    ("reasoning", ["mathqa", "gsm8k"]),
    ("knowledge", ["mmlu", "truthfulqa_mc1", "truthfulqa_mc2"]),
]

# Training-log patterns (first match vs last match).
FIRST_MATCH_METRICS = ["train_loss", "train_runtime", "train_samples_per_second",
                       "train_steps_per_second"]
LAST_MATCH_METRICS = ["eval_accuracy", "eval_f1_macro", "eval_f1_micro", "eval_precision_macro",
                      "eval_recall_macro", "eval_loss"]


def metric_pattern(name: str) -> str:
    return f"'{name}':\\s*([\\d.]+)"


def numeric_value(v: Column) -> Column:
    """Keep numbers (JSON true/false count as 1/0); strings such as aliases -> NULL."""
    return (F.when(F.lower(v) == "true", F.lit(1.0)).when(F.lower(v) == "false", F.lit(0.0))
            .otherwise(v.try_cast("double")))


def numeric_metric(v: Column) -> Column:
    """B3 for a JSON value: numbers, and true/false as 1/0; anything else -> NULL."""
    kind = F.schema_of_variant(v)
    return (F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
            .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double")))


def flatten_results(docs: DataFrame, json_col: str = "json", model_col: str = "model") -> DataFrame:
    """L1 + B3: ``model, task, metric, value`` for numeric metrics."""
    parsed = docs.select(F.col(model_col).alias("model"),
                         F.from_json(F.col(json_col), RESULTS_SCHEMA).alias("r"))
    tasks = (parsed.select("model", F.explode_outer("r.results").alias("task", "metrics"))
             .where(F.col("task").isNotNull()))
    long = (tasks.select("model", "task", F.explode_outer("metrics").alias("metric", "raw"))
            .where(F.col("metric").isNotNull()))
    return (long.select("model", "task", "metric", numeric_metric(F.col("raw")).alias("value"))
            .where(F.col("value").isNotNull()))


def results_wide(long: DataFrame, metrics: list[str]) -> DataFrame:
    """L2: one row per (model, task), one column per metric (union over tasks)."""
    return long.groupBy("model", "task").pivot("metric", metrics).agg(F.first("value"))


def compare_models(long: DataFrame, tasks: list[str], metrics: list[str]) -> DataFrame:
    """One row per model, columns ``{task}_{metric}`` for the requested tasks."""
    cols = [f"{t}_{m}" for t in tasks for m in metrics]
    keyed = long.where(F.col("task").isin(tasks)).withColumn(
        "col", F.concat_ws("_", "task", "metric"))
    return keyed.groupBy("model").pivot("col", cols).agg(F.first("value"))


def clean_model_name(model: Column) -> Column:
    """Last path segment of a model name."""
    return F.substring_index(model, "/", -1)


def best_performers(long: DataFrame, model_order: DataFrame | None = None,
                    higher_is_better: bool = True) -> DataFrame:
    """Best model per task and metric; strict comparison, so the first
    model wins a tie (``model_order(model, ord)``, a bounded model list, or the
    model name). Always "higher is better" by default, as in the reference."""
    sign = -1.0 if higher_is_better else 1.0
    if model_order is not None:
        long = long.join(bounded_broadcast(model_order), "model")
        tie = F.col("ord")
    else:
        tie = F.col("model")
    key = F.struct((F.col("value") * sign).alias("v"), tie.alias("o"))
    return long.groupBy("task", "metric").agg(
        F.min_by("model", key).alias("best_model"),
        F.min_by("value", key).alias("value")).select(
        F.concat_ws("_", "task", "metric").alias("task_metric"),
        clean_model_name(F.col("best_model")).alias("best_model"), "value")


def metric_paths(long: DataFrame, prefix: str = "eval", keep: tuple[str, ...] = ()) -> DataFrame:
    """``prefix/task/metric`` names (:func:`comparison_paths` has the model in them)."""
    return long.select(*keep, F.concat_ws("/", F.lit(prefix), "task", "metric").alias("path"), "value")


def comparison_paths(long: DataFrame) -> DataFrame:
    """``comparison/{model}/{task}/{metric}`` with the model's name as a slug."""
    return long.select("model", F.concat_ws("/", F.lit("comparison"), name_slug("model"), "task", "metric").alias("path"),
                       "value")


def final_metric_map(long: DataFrame) -> DataFrame:
    """Per model ``{task}_{metric} -> value`` sorted by key."""
    return long.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.concat_ws("_", "task", "metric").alias("k"), F.col("value").alias("v")))))
        .alias("metrics"))


def suite_dimension(spark: SparkSession) -> DataFrame:
    rows = [(s, i, t) for s, ts in BENCHMARK_SUITES.items() for i, t in enumerate(ts)]
    return literal_dimension(spark.createDataFrame(rows, "suite string, pos int, task string"))


def group_dimension(spark: SparkSession) -> DataFrame:
    rows = [(g, gi, t) for gi, (g, ts) in enumerate(TASK_GROUPS) for t in ts]
    return literal_dimension(spark.createDataFrame(rows, "category string, group_ord int, task string"))


def expand_suite(spark: SparkSession, suite: str, custom_tasks: list[str] | None = None) -> DataFrame:
    """The tasks of a suite; ``custom`` needs a task list; unknown is an error."""
    if suite == "custom":
        if not custom_tasks:
            raise ValueError("custom suite needs a task list")
        return spark.createDataFrame([(suite, i, t) for i, t in enumerate(custom_tasks)],
                                     "suite string, pos int, task string")
    if suite not in BENCHMARK_SUITES:
        raise ValueError(f"unknown benchmark suite: {suite}")
    return suite_dimension(spark).where(F.col("suite") == suite)


def categorize_tasks(tasks: DataFrame, spark: SparkSession) -> DataFrame:
    """Each task in the first matching group, else ``other``."""
    g = group_dimension(spark)
    return (tasks.select("task").distinct().join(g, "task", "left")
            .groupBy("task").agg(F.min_by("category", "group_ord").alias("category"))
            .select("task", F.coalesce("category", F.lit("other")).alias("category")))


def log_line_metrics(lines: DataFrame, run_col: str = "run", order_col: str = "ts",
                     text_col: str = "line") -> DataFrame:
    """H34 on a table of log lines: first occurrence for train_* stats, last
    occurrence for eval_* metrics, per run (mergeable min_by/max_by, no
    per-run string is ever built)."""
    aggs = []
    for name in FIRST_MATCH_METRICS + LAST_MATCH_METRICS:
        v = F.regexp_extract(F.col(text_col), metric_pattern(name), 1)
        hit = F.when(v != "", F.struct(F.col(order_col).alias("o"), v.cast("double").alias("v")))
        pick = F.min(hit) if name in FIRST_MATCH_METRICS else F.max(hit)
        aggs.append(pick["v"].alias("final_train_loss" if name == "train_loss" else name))
    return lines.groupBy(F.col(run_col).alias("run")).agg(*aggs)


def last_values(log: DataFrame, run_col: str, order_col: str, name_col: str,
                value_col: str) -> DataFrame:
    """Per run and metric name, the value of the last step that has it."""
    return log.groupBy(run_col, name_col).agg(
        F.max_by(value_col, order_col).alias("last_value"),
        F.max(order_col).alias("last_step"))


def run_summary(log: DataFrame, run_col: str, ts_col: str, value_col: str, order_col: str | None = None) -> DataFrame:
    """Duration (seconds), number of logged values, final value (by ``order_col`` where times may be equal)."""
    return log.groupBy(run_col).agg(
        ((F.max(F.unix_micros(F.col(ts_col).cast("timestamp")))
          - F.min(F.unix_micros(F.col(ts_col).cast("timestamp")))) / 1e6).alias("duration_sec"),
        F.count(F.lit(1)).alias("n_values"),
        F.max_by(value_col, order_col or ts_col).alias("final_value"))


def allow_list(rows: DataFrame, allowed: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``col`` is in the list ``allowed`` (a semi join), and the listed names that no row has."""
    names = allowed.select(col).distinct()
    return (rows.join(bounded_broadcast(names), col, "left_semi").select(*rows.columns),
            names.join(rows.select(col).distinct(), col, "left_anti"))


def listing(rows: DataFrame, col: str) -> DataFrame:
    """the distinct values in order, with their place (distinct names of a catalog: one small sort)."""
    names = rows.select(col).distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(col))).orderBy("place")


def latency_stats(runs: DataFrame, model_col: str = "model", time_col: str = "total_time",
                  tokens_col: str = "tokens_generated") -> DataFrame:
    """avg/min/max time, avg tokens per second (0 when time <= 0), runs."""
    tps = F.when(F.col(time_col) > 0, F.col(tokens_col) / F.col(time_col)).otherwise(F.lit(0.0))
    return runs.groupBy(model_col).agg(
        F.avg(time_col).alias("avg_time"), F.min(time_col).alias("min_time"),
        F.max(time_col).alias("max_time"), F.avg(tps).alias("avg_tokens_per_second"),
        F.count(F.lit(1)).alias("runs"))


def split_info(kv: DataFrame, key_col: str = "key", value_col: str = "value",
               keep: tuple[str, ...] = ()) -> DataFrame:
    """system/dataset info split into numeric and string values."""
    num = F.col(value_col).cast("string").try_cast("double")
    return kv.select(*keep, key_col, num.alias("value_num"),
                     F.when(num.isNull(), F.col(value_col).cast("string")).alias("value_text"))


def report_rows(long: DataFrame) -> DataFrame:
    """L3: Task / Metric / Value rows with 4 decimals."""
    return long.select("model", F.col("task").alias("Task"), F.col("metric").alias("Metric"),
                       F.regexp_replace(F.format_number(F.col("value"), 4), ",", "").alias("Value"))


def select_newest(files: DataFrame, expected: list[str] | None = None,
                  path_col: str = "path", mtime_col: str = "mtime",
                  keys_col: str = "task_keys", prefer: Column | None = None) -> DataFrame:
    """Pick one file: those whose (trimmed, lower-case) task keys
    contain every expected task first, then preferred paths, then newest."""
    keys = F.transform(F.col(keys_col), lambda k: F.lower(F.trim(k)))
    exp = F.array(*[F.lit(t.strip().lower()) for t in (expected or [])]).cast("array<string>")
    contains = F.size(F.array_except(exp, keys)) == 0
    order = [F.desc(contains.cast("int"))]
    if prefer is not None:
        order.append(F.desc(prefer.cast("int")))
    order += [F.desc(mtime_col), F.asc(path_col)]
    # Top-1 by ordering: per-partition top-1, then one merge (no global sort).
    return files.orderBy(*order).limit(1)


def logging_metrics(summary: DataFrame) -> DataFrame:
    """The metrics a run logs: final_train_loss; overall_accuracy with
    eval_loss / eval_f1_macro defaulting to 0 when accuracy exists; runtime and
    samples/s defaulting to 0 when any training stat exists."""
    has_acc = F.col("eval_accuracy").isNotNull()
    has_stats = (F.col("train_runtime").isNotNull() | F.col("train_samples_per_second").isNotNull()
                 | F.col("train_steps_per_second").isNotNull())
    return summary.select(
        "run", "final_train_loss", F.col("eval_accuracy").alias("overall_accuracy"),
        F.when(has_acc, F.coalesce("eval_loss", F.lit(0.0))).alias("eval_loss"),
        F.when(has_acc, F.coalesce("eval_f1_macro", F.lit(0.0))).alias("eval_f1_macro"),
        F.when(has_stats, F.coalesce("train_runtime", F.lit(0.0))).alias("train_runtime"),
        F.when(has_stats, F.coalesce("train_samples_per_second", F.lit(0.0)))
        .alias("train_samples_per_second"))


def distinct_tasks_metrics(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct tasks and distinct metrics across models (sorted listing, F6)."""
    return (long.select("task").distinct().orderBy("task"),
            long.select("metric").distinct().orderBy("metric"))
