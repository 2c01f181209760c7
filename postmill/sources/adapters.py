"""Interfaces to the outside, with deterministic stand-ins for tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and about the bytes of text, that a model's worker turns into Python's objects at a time.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


def graph_fetcher(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Fetch from a table (url, html) in place of the network; unknown addresses are left out."""
    return lambda frontier: frontier.join(pages.select("url", "html"), "url").select("source_id", "url", "depth", "html")


def fetch_status(status: str = "status_code"):
    """(success, failure_reason) of an HTTP status."""
    code = F.col(status)
    reason = F.when(code.isin(403, 429, 503), F.lit("refused")).when((code >= 200) & (code < 300), F.lit("")).otherwise(F.concat(F.lit("HTTP "), code.cast("string")))
    return F.struct(((code >= 200) & (code < 300)).alias("success"), reason.alias("failure_reason"))


def in_slices(batch: pa.RecordBatch, column: str, multiple: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``SLICE_ROWS`` rows and, by the mean text, about ``SLICE_BYTES`` of the column; their rows are not copied."""
    size = max(1, batch.column(column).nbytes // max(1, len(batch)))
    step = max(multiple, min(SLICE_ROWS, SLICE_BYTES // size) // multiple * multiple)
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


def generate(rows: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], batch: int = 8) -> DataFrame:
    """Add ``output``: the model's answers to the prompts, in batches; a failure gives null and ``error``.

    Only the texts of a slice are Python's objects at a time.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for p in parts for s in in_slices(p, prompt, batch)):
            prompts, answers, errors = part.column(prompt).to_pylist(), [], []
            for at in range(0, len(part), batch):
                asked = prompts[at : at + batch]
                try:
                    answers += model(asked)
                    errors += [None] * len(asked)
                except Exception as error:  # noqa: BLE001  recorded in the row
                    answers += [None] * len(asked)
                    errors += [str(error)] * len(asked)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], [*part.schema.names, "output", "error"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{columns}, output string, error string")


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """Each row k times, numbered from 1."""
    return rows.withColumn("candidate", F.explode(F.sequence(F.lit(1), F.lit(k))))


def embed(rows: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], dimensions: int) -> DataFrame:
    """Add ``embedding``; a wrong number or size of vectors is an error. The model gets the texts of a slice at a time."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for p in parts for s in in_slices(p, text)):
            vectors = model(part.column(text).to_pylist())
            if len(vectors) != len(part) or any(len(v) != dimensions for v in vectors):
                raise ValueError("the model gave vectors of the wrong shape")
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float64()))], [*part.schema.names, "embedding"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{columns}, embedding array<double>")


def not_yet(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows still to do: those with no finished row of the same keys."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")
