"""Model hooks (N1-N4): pluggable embedders, rerankers, generators, graders,
rewriters, judges, chunkers, extractors, tokenizers and metrics.

Every hook is a Column function with a native default, so the default
pipeline never leaves the JVM. A user model plugs in through
:func:`batch_model_column`, an iterator pandas UDF: the model is loaded once
per task (not per row, not on the driver) and scores Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from sifter.functions import formatting as fmt
from sifter.functions.text import tokenize
from sifter.functions.vectors import hashed_embedding
from sifter.operators import chunking, corrective, evaluation, retrieval


class ColumnHook(Protocol):
    def __call__(self, *cols: Column) -> Column: ...


# Native defaults (deterministic and offline).
DEFAULT_EMBEDDER: ColumnHook = hashed_embedding                       # J1
DEFAULT_RERANKER: ColumnHook = retrieval.token_overlap_score           # J6
DEFAULT_GRADER: ColumnHook = corrective.default_grader                 # J11
DEFAULT_ROUTER: ColumnHook = corrective.default_router                 # J15
DEFAULT_JUDGE: ColumnHook = evaluation.token_judge                     # K2, K5, K7
DEFAULT_TOKENIZER: ColumnHook = tokenize                               # H1, N3
DEFAULT_ID_TOKENIZER: ColumnHook = fmt.hashed_token_ids                # L10
DEFAULT_WORD_TOKENIZER: ColumnHook = chunking.word_tokens              # I3


def default_generator(contexts: Column) -> Column:
    """J9 default: extractive answer, first 200 characters of the top context."""
    return F.concat(F.substring(F.element_at(contexts, 1), 1, 200), F.lit("..."))


def batch_model_column(load: Callable[[], Callable[[pd.DataFrame], pd.Series]],
                       return_type: str, *cols: Column) -> Column:
    """Wrap a user model as an Arrow-batched column.

    ``load()`` runs once per task and returns ``predict(batch_df) -> Series``;
    ``cols`` become the batch's columns c0, c1, ... Used for embedders
    (return ``array<double>``), rerankers (``double``), generators
    (``string``), graders (``boolean``) and judges.
    """
    @F.pandas_udf(return_type)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        predict = load()
        for batch in batches:
            parts = batch if isinstance(batch, tuple) else (batch,)
            frame = pd.concat({f"c{i}": s for i, s in enumerate(parts)}, axis=1)
            yield predict(frame)

    return run(*cols)


def _attempt(predict, frame: pd.DataFrame) -> tuple[list, list]:
    """Values and errors of a batch: whole if the model takes it, else row by row."""
    try:
        values = list(predict(frame))
        if len(values) != len(frame):
            raise ValueError(f"{len(values)} results for {len(frame)} rows")
        return values, [None] * len(frame)
    except Exception as whole:  # noqa: BLE001  (a user's model may raise anything)
        if len(frame) == 1:
            return [None], [f"{type(whole).__name__}: {whole}"]
    values, errors = [], []
    for i in range(len(frame)):
        v, e = _attempt(predict, frame.iloc[i:i + 1].reset_index(drop=True))
        values += v
        errors += e
    return values, errors


def isolated(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], list]], inputs: list[str], output: str,
             return_type: str) -> DataFrame:
    """``df`` with ``output`` from a user model and ``<output>_error``: why a row has none.

    ``load()`` runs once per task and returns ``predict(frame) -> values`` for Arrow batches of the ``inputs``
    columns. A batch that fails is tried again row by row, so a failure costs its own row the output and nothing else; a
    loader that fails gives every row its reason. All columns of ``df`` are kept.
    """
    error = f"{output}_error"
    kind = to_arrow_type(_parse_datatype_string(return_type))
    names = df.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{output}` {return_type}, `{error}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict, reason = None, None
        for batch in batches:
            if predict is None and reason is None:
                try:
                    predict = load()
                except Exception as e:  # noqa: BLE001
                    reason = f"{type(e).__name__}: {e}"
            n = batch.num_rows
            if reason is not None:
                values, errors = [None] * n, [reason] * n
            else:
                values, errors = _attempt(predict, batch.select(inputs).to_pandas())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, kind), pa.array(errors, pa.string())], names=[*names, output, error])

    return df.mapInArrow(run, schema)
