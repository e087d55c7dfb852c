"""File sources (A1-A8, G1): documents, datasets, question sets, result files,
trainer states and calibration text.

Every reader declares its schema (no inference in library code) and keeps the
file path from ``_metadata`` / the ``binaryFile`` source; file listing is
pruned with ``pathGlobFilter`` where the reference filters by glob.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.functions.text import strip_ws
from sifter.operators.results import RESULTS_SCHEMA, flatten_results
from sifter.sources.fs import _fs

DEFAULT_FILE_TYPES = ("pdf", "txt", "md", "docx")
TEXT_TYPES = ("txt", "md")
DOC_SCHEMA = ("doc_id string, source_path string, file_type string, page int, text string, "
              "metadata map<string,string>, _error string")

Extractor = Callable[[bytes], list[tuple[int, str]]]


def _is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p)) and bool(fs.getFileStatus(p).isDirectory())


def load_documents(spark: SparkSession, path: str, file_types=DEFAULT_FILE_TYPES,
                   extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """A1-A3/G1: one row per text file (per page for paged extractors).

    A single file matches its extension case-insensitively; a directory is
    walked recursively and matches extensions exactly (glob semantics). Text
    types are decoded natively as UTF-8; other types go through the
    user-supplied ``extractors[file_type]`` in a ``mapInPandas`` task. A file
    that cannot be read keeps a row with ``_error`` set (nothing is lost).
    """
    types = [t.strip().lstrip(".") for t in file_types]
    extension = F.regexp_extract("path", r"\.([^./]+)$", 1)
    is_dir = _is_dir(spark, path)

    def files_of(wanted: list[str]) -> DataFrame:
        """One scan of the files of some types: a folder's listing is filtered by
        name before any content is read."""
        reader = spark.read.format("binaryFile")
        if is_dir:
            glob = "*.{" + ",".join(wanted or ["-"]) + "}"
            files = (reader.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
                     .load(path).where(extension.isin(wanted)))
        else:
            files = reader.load(path).where(F.lower(extension).isin([t.lower() for t in wanted]))
        return files.select("path", F.lower(extension).alias("file_type"), "content")

    text = files_of([t for t in types if t.lower() in TEXT_TYPES])
    decoded = F.col("content").cast("string")
    text_rows = text.select(
        F.col("path").alias("doc_id"), F.col("path").alias("source_path"), "file_type",
        F.lit(None).cast("int").alias("page"),
        F.when(F.is_valid_utf8(decoded), decoded).alias("text"),
        F.create_map(F.lit("source"), F.col("path")).alias("metadata"),
        F.when(~F.is_valid_utf8(decoded), F.lit("invalid UTF-8")).alias("_error"))
    other = files_of([t for t in types if t.lower() not in TEXT_TYPES])
    ex = dict(extractors or {})

    def extract(batches):
        for pdf in batches:
            out = []
            for path_, ftype, content in zip(pdf["path"], pdf["file_type"], pdf["content"]):
                fn = ex.get(ftype)
                if fn is None:
                    out.append((path_, path_, ftype, None, None, {"source": path_},
                                f"no extractor for {ftype}"))
                    continue
                try:
                    for page, txt in fn(bytes(content)):
                        out.append((f"{path_}#{page}", path_, ftype, page, txt,
                                    {"source": path_, "page": str(page)}, None))
                except Exception as e:  # noqa: BLE001  (per-file failure is data)
                    out.append((path_, path_, ftype, None, None, {"source": path_}, str(e)))
            yield pd.DataFrame(out, columns=["doc_id", "source_path", "file_type", "page", "text",
                                             "metadata", "_error"])

    return text_rows.unionByName(other.mapInPandas(extract, DOC_SCHEMA))


def read_dataset(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A4: ``.jsonl`` line by line, ``.json`` as one array, ``.csv`` with a
    header (quoted multi-line fields); anything else is read as parquet."""
    low = path.lower()
    if low.endswith(".jsonl"):
        r = spark.read
        return (r.schema(schema) if schema else r).json(path)
    if low.endswith(".json"):
        r = spark.read.option("multiLine", True)
        return (r.schema(schema) if schema else r).json(path)
    if low.endswith(".csv"):
        r = (spark.read.option("header", True).option("multiLine", True)
             .option("quote", '"').option("escape", '"'))
        return (r.schema(schema) if schema else r.option("inferSchema", False)).csv(path)
    return spark.read.parquet(path)


QUESTION_FILE_SCHEMA = "questions array<string>, ground_truths array<array<string>>"


def read_question_set(spark: SparkSession, path: str) -> DataFrame:
    """A5: ``question_id, question, ground_truths``; a file without questions is
    empty; unequal question / ground-truth counts fail the job."""
    raw = spark.read.option("multiLine", True).schema(QUESTION_FILE_SCHEMA).json(path)
    questions = F.coalesce("questions", F.array().cast("array<string>"))
    # The check is part of the column that every row comes from, so no
    # projection of the result can prune it.
    checked = raw.select(
        F.when(F.col("ground_truths").isNull()
               | (F.size("ground_truths") == F.size(questions)), questions)
        .otherwise(F.raise_error(F.lit("Number of ground truths must match number of questions")))
        .alias("q"), "ground_truths")
    return checked.select(F.posexplode("q").alias("question_id", "question"), "ground_truths").select(
        F.col("question_id").cast("bigint").alias("question_id"), "question",
        F.try_element_at("ground_truths", F.col("question_id") + 1).alias("ground_truths"))


def scan_result_files(spark: SparkSession, root: str, expected_tasks: list[str] | None = None,
                      pattern: str = "results*.json") -> DataFrame:
    """The one result file to use: files whose task keys (trimmed,
    lower-case) contain all expected tasks first, newest first. Fails when no
    file exists or when no task of the chosen file has a metric."""
    from sifter.operators.results import select_newest
    files = (spark.read.option("multiLine", True).option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).schema(RESULTS_SCHEMA).json(root)
             .select("results", F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_modification_time").alias("mtime"))
             .withColumn("task_keys", F.coalesce(F.map_keys("results"),
                                                 F.array().cast("array<string>"))))
    chosen = select_newest(files, expected_tasks)
    # Part of the column that the rows are read from: nothing prunes the check.
    return chosen.withColumn("results", F.when(
        F.exists(F.map_values("results"), lambda m: F.size(m) > 0), F.col("results")).otherwise(
        F.raise_error(F.lit("No results with metrics found"))))


def results_from_files(spark: SparkSession, root: str, model: str,
                       expected_tasks: list[str] | None = None) -> DataFrame:
    """A6 + L1: flattened ``model, task, metric, value`` of the selected file."""
    chosen = scan_result_files(spark, root, expected_tasks).select(
        F.lit(model).alias("model"), F.to_json(F.struct("results")).alias("json"))
    return flatten_results(chosen, "json", "model")


TRAINER_STATE_SCHEMA = ("log_history array<map<string,double>>, epoch double, global_step bigint, "
                        "best_metric double")


def trainer_state_summary(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """Newest ``trainer_state.json`` (paths containing the project
    name first): final train loss (last step with ``loss``), the ``eval_*``
    keys of the last step with ``eval_accuracy``, epoch, global_step, best_metric."""
    from sifter.operators.results import select_newest
    files = (spark.read.option("multiLine", True).option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "trainer_state.json").schema(TRAINER_STATE_SCHEMA).json(root)
             .select("*", F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_modification_time").alias("mtime"))
             .withColumn("task_keys", F.array().cast("array<string>")))
    prefer = F.col("path").contains(project) if project else None
    chosen = select_newest(files, None, prefer=prefer)
    steps = chosen.select("path", "epoch", "global_step", "best_metric",
                          F.posexplode_outer("log_history").alias("pos", "h"))
    return steps.groupBy("path", "epoch", "global_step", "best_metric").agg(
        F.max_by(F.col("h")["loss"], F.when(F.col("h")["loss"].isNotNull(), F.col("pos")))
        .alias("final_train_loss"),
        F.max_by(F.map_filter("h", lambda k, v: k.startswith("eval_")),
                 F.when(F.col("h")["eval_accuracy"].isNotNull(), F.col("pos"))).alias("eval_metrics"))


def read_calibration(spark: SparkSession, path: str, max_samples: int = 128) -> DataFrame:
    """JSON array of strings or objects (first of text, content,
    instruction, prompt), or ``.txt`` lines (stripped). The first
    ``max_samples`` items are taken *before* unusable ones drop."""
    if path.lower().endswith(".txt"):
        lines = spark.read.text(path).select(
            F.col("value").alias("raw"), F.col("_metadata.file_path").alias("_f"))
        ordered = lines.withColumn("_i", F.monotonically_increasing_id())
        head = ordered.orderBy("_i").limit(max_samples)
        return head.select("_i", strip_ws("raw").alias("text")).where(F.col("text") != "") \
            .orderBy("_i").select("text")
    raw = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "array<string>").alias("a"))
    items = raw.select(F.posexplode(F.slice("a", 1, max_samples)).alias("i", "item"))
    obj = F.from_json("item", "map<string,string>")
    text = F.when(F.col("item").startswith("{"), F.coalesce(
        obj["text"], obj["content"], obj["instruction"], obj["prompt"])).otherwise(F.col("item"))
    return items.select("i", text.alias("text")).where(F.col("text").isNotNull()).orderBy("i") \
        .select("text")
