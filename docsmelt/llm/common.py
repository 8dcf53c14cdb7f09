"""Shared plumbing of the training-data operators: scratch tables, Arrow access, batching."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass handles; bounds the temporary arrays of a task.
PASS_BYTES = 1 << 20


_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared one the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent the warehouse folder serves in local mode (tests on one
    machine); elsewhere that is an error, as a folder may be one machine's own. Folders are
    deleted at the end of their ``scratch_scope``, or of the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{base.rstrip('/')}/docsmelt-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_discard_all)
    _made.append(path)
    return path


def materialise(df: DataFrame, name: str = "t", folder: str | None = None) -> DataFrame:
    """Cut lineage: write to the shared scratch folder as Parquet and read back."""
    path = f"{folder or scratch_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more, through the store's own file system."""
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), path)
    if path in _made:
        _made.remove(path)


def _delete(jvm, configuration, path: str) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(configuration).delete(where, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the folders made inside at the end, when their readers have been written out."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before]:
            discard(spark, path)


def _discard_all() -> None:
    jvm = SparkContext._jvm
    try:
        for path in _made:
            _delete(jvm, jvm.org.apache.hadoop.conf.Configuration(), path)
    except Exception:  # the process ends; a store that is gone already needs no cleaning
        pass


def kept_names(keep: tuple[str, ...], own: list[str]) -> dict[str, str]:
    """What columns that an operator passes on are called: their names, with ``_input`` where the operator has one of that name."""
    return {f"_k{i}": f"{c}_input" if c in own else c for i, c in enumerate(keep)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = PASS_BYTES):
    """Cut rows into (first, last) ranges of about ``limit`` bytes, one row at least each."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def passes(column, limit: int = PASS_BYTES):
    """(first row, last row, bytes, offsets) of each pass over an Arrow string column."""
    data, offsets = text_buffer(column)
    for lo, hi in spans(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


@lru_cache(1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start_i, start_i + 1, ... for each range, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total, dtype=np.int64)
