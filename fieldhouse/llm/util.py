"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldhouse.storage import new_folder, removed, shared_dir, written  # noqa: F401

#: Bytes of text that one vectorised step in a Python worker handles at a time.
CHUNK_BYTES = 500_000
#: Rows with texts in one Arrow batch.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows in an Arrow batch from now on: rows with texts are large, and workers hold a few batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def trimmed(run: Callable) -> Callable:
    """run (for mapInArrow), after whose last batch a task's freed memory goes back to the system: a worker process lives on,
    and would keep the peak of each task beside the next one's."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
            if trim:
                trim(0)

    return whole


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """Only the two columns that document operators read; other columns, whatever their names, are pruned."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def byte_values(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def chunks(values: list[bytes], most: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of whole values of about `most` bytes; a longer value is a slice of its own."""
    start, size = 0, 0
    for i, value in enumerate(values):
        if size and size + len(value) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(value)
    if start < len(values):
        yield slice(start, len(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordCodes(dict):
    """word -> 64-bit code, computed on first use. It forgets all when it holds too many words: that costs time only."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        from hashlib import blake2b

        if len(self) >= self.most:
            self.clear()
        code = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little") | 1
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
