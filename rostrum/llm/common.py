"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.session import checkpointed, free, shared_folder, widened

__all__ = ["checkpointed", "free", "shared_folder"]

#: Characters that separate words.
SPACES = "\t\n\x0b\x0c\r "
#: A word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widened(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of finished phases now: it acts when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(kernel: Callable) -> Callable:
    """The same kernel, whose worker gives memory back when a task ends: workers live on, and two tasks' peaks would add up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            given_back()

    return run


def given_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim is not None:
        trim(0)


def results_free(keep: Iterable[str], *results: str) -> None:
    """Raises ValueError if a kept column has the name of a result (Spark doesn't tell cases apart), before any job runs."""
    clash = sorted({c.lower() for c in keep} & {r.lower() for r in results})
    if clash:
        raise ValueError(f"kept columns have the names of results: {', '.join(clash)}")


def small(df: DataFrame, most: int) -> DataFrame:
    """Hinted for broadcast if it has at most so many rows, else left to a shuffle join. For tables that are cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text, mod 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trainable(doc_id: Column) -> Column:
    """Whether a document may be learned from; null ids may not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def partitions(df: DataFrame) -> int:
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def merged(df: DataFrame, merge: Callable[[Iterator[bytes]], bytes], fan: int = 16) -> bytes | None:
    """Merge one bounded binary summary per partition through a tree of tasks; the driver gets at most ``fan`` of them.

    ``df`` has one binary column named ``summary``.
    """

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [False]

        def values() -> Iterator[bytes]:
            for batch in batches:
                for value in batch.column(0):
                    seen[0] = True
                    yield value.as_py()

        out = merge(values())
        if seen[0]:
            yield pa.record_batch([pa.array([out], pa.binary())], names=["summary"])

    count = partitions(df)
    while count > fan:
        count = -(-count // fan)
        df = df.repartition(count).mapInArrow(tidy(step), "summary binary")
    rows = [bytes(r[0]) for r in df.collect()]
    return merge(iter(rows)) if rows else None


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows in them; null rows are empty."""
    if column.null_count or column.offset or not pa.types.is_string(column.type):
        column = pa.array(["" if x is None else x for x in column.to_pylist()], pa.large_string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind, len(column) + 1).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, at: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about ``size`` bytes of its text column at a time; a longer text goes alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, i = np.concatenate([[0], np.cumsum(lengths)]), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def with_text(df: DataFrame, text_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, int]:
    """``keep`` columns and the text, which is sent once only where it is one of them; and its place."""
    if text_col in keep:
        return df.select(*keep), keep.index(text_col)
    return df.select(*keep, F.col(text_col).alias("__text")), len(keep)


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]
