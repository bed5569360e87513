"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import materialize as materialize  # a reliable checkpoint

#: The six characters that count as white space in every contract of this package.
SPACE = " \t\n\x0b\x0c\r"
SPACE_REGEX = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function of ``mapInArrow`` whose worker gives memory back at the end of a task; workers live on for other tasks."""

    @wraps(run)
    def outer(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # no glibc

    return outer


def rows_of(batch: pa.RecordBatch, text: str | pa.Array = "text", most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text column holds about ``most_bytes``; a longer text comes alone."""
    column = batch.column(text) if isinstance(text, str) else text
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most_bytes:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += int(n)
    if first < batch.num_rows:
        yield batch.slice(first)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; a null is empty."""
    return pa.compute.fill_null(column.cast(pa.binary()), b"").to_pylist()


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_spans(texts: pa.Array, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes with A-Z in lower case; start, size and text of each longest run of bytes that ``word_byte`` has. A null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = int(ends[0]) if len(ends) else 0
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[first : int(ends[-1])] if len(texts) and ends[-1] > first else np.zeros(0, np.uint8)
    data, ends = _LOWER[raw], ends - first
    inside = np.concatenate([[False], word_byte[data], [False]])
    opens, closes = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cuts = ends[1:-1]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # two words that only a text's end parts
    opens[cuts] = closes[cuts] = True
    starts = np.flatnonzero(opens)
    return data, starts, np.flatnonzero(closes) - starts, np.searchsorted(ends, starts, "right") - 1


def joined_small(rows: DataFrame, small: DataFrame, keys: list[str], most: int = 100_000) -> DataFrame:
    """An inner join, which broadcasts ``small`` if it has at most ``most`` rows, as is counted."""
    few = len(small.select(F.lit(1)).limit(most + 1).collect()) <= most
    return rows.join(F.broadcast(small) if few else small, keys)
