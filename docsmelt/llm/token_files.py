"""Token-id output in Arrow file format with fixed-size-list batches (operator 10).

A data set is a folder of pairs of files, one pair for each range of document ids:

``part-NNNNN.tokens.arrow``  rows of equal length: ``ids`` fixed_size_list<T>[L], T the
    least of uint16 and uint32 that holds the vocabulary, and ``mask``
    fixed_size_list<bool>[L], true where an id is real; only a file's last row has
    false. Row r of a file holds its ids r*L to r*L + L - 1, so a memory-mapped reader
    reaches any sequence without a copy and without reading what lies before it.
``part-NNNNN.docs.arrow``  doc_id, start (in the file) and n_tokens of its documents, in
    ascending order of doc_id.

Files go through ``pyarrow.fs``, so the folder may be any URI that it opens (file, hdfs,
s3, gs). A task writes under a name of its own and renames at the end: a task that runs
again, or twice at once, leaves the same file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from docsmelt.llm.bpe import byte_bpe
from docsmelt.llm.common import scratch_dir
from docsmelt.llm.token_ops import encoded_passes

#: Sequences in one record batch of a file.
BATCH_ROWS = 256
#: Bytes of text aimed at for one file.
FILE_BYTES = 32 << 20


def _open(folder: str):
    if "://" not in folder and folder.startswith("file:"):
        folder = folder[5:]
    return pafs.FileSystem.from_uri(folder)


def _fixed(values: np.ndarray, length: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values), length)


class TokenWriter:
    """Writes one pair of files row batch by row batch; memory is one batch."""

    def __init__(self, folder: str, part: int, length: int, doc_type: pa.DataType, id_type=np.uint32):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.length, self.id_type = length, id_type
        self.final = f"{base}/part-{part:05d}"
        self.temp = f"{base}/_{uuid.uuid4().hex}"
        tokens = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(id_type), length)), ("mask", pa.list_(pa.bool_(), length))])
        docs = pa.schema([("doc_id", doc_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(f"{self.temp}.{kind}") for kind in ("tokens", "docs")]
        self.tokens, self.docs = (pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (tokens, docs)))
        self.rest, self.rest_size, self.total = [], 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray):
        starts = self.total + np.cumsum(sizes) - sizes
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], schema=self.docs_schema(doc_ids)))
        self.total += len(ids)
        self.rest.append(ids.astype(self.id_type))
        self.rest_size += len(ids)
        unit = BATCH_ROWS * self.length
        if self.rest_size >= unit:
            flat = np.concatenate(self.rest)
            whole = len(flat) // unit * unit
            for at in range(0, whole, unit):
                self._write(flat[at : at + unit], unit)
            self.rest, self.rest_size = [flat[whole:]], len(flat) - whole

    @staticmethod
    def docs_schema(doc_ids):
        return pa.schema([("doc_id", doc_ids.type), ("start", pa.int64()), ("n_tokens", pa.int64())])

    def _write(self, flat: np.ndarray, real: int):
        mask = np.zeros(len(flat), bool)
        mask[:real] = True
        self.tokens.write_batch(pa.RecordBatch.from_arrays([_fixed(flat, self.length), _fixed(mask, self.length)], ["ids", "mask"]))

    def close(self):
        flat = np.concatenate([*self.rest, np.zeros(0, self.id_type)])
        if len(flat):
            self._write(np.concatenate((flat, np.zeros(-len(flat) % self.length, self.id_type))), len(flat))
        for writer, sink, kind in zip((self.tokens, self.docs), self.sinks, ("tokens", "docs")):
            writer.close()
            sink.close()
            self.fs.move(f"{self.temp}.{kind}", f"{self.final}.{kind}.arrow")


class TokenReader:
    """Random access to one pair of files; rows come out of the map without a copy."""

    def __init__(self, folder: str, part: int):
        fs, base = _open(folder)
        if isinstance(fs, pafs.LocalFileSystem):
            self.source = pa.memory_map(f"{base}/part-{part:05d}.tokens.arrow")
        else:
            self.source = fs.open_input_file(f"{base}/part-{part:05d}.tokens.arrow")
        self.tokens = pa.ipc.open_file(self.source)
        with fs.open_input_file(f"{base}/part-{part:05d}.docs.arrow") as f:
            self.docs = pa.ipc.open_file(f).read_all()
        self.length = self.tokens.schema.field("ids").type.list_size
        self._at, self._held = -1, None

    def arrow(self, row: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of one row as Arrow arrays; both are views of the map, where the file is local."""
        batch = self._batch(row // BATCH_ROWS)
        a = row % BATCH_ROWS * self.length
        return tuple(c.flatten().slice(a, self.length) for c in batch.columns)

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the map, where the file is local) and mask (one byte for each bit) of one row."""
        ids, mask = self.arrow(row)
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def _batch(self, k: int) -> pa.RecordBatch:
        if k != self._at:
            self._at, self._held = k, self.tokens.get_batch(k)
        return self._held

    def ids(self, start: int, size: int) -> np.ndarray:
        """The ids [start, start + size) of the file's stream."""
        unit, out, stop = BATCH_ROWS * self.length, [], start + size
        while start < stop:
            k = start // unit
            flat = self._batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
            out.append(flat[start - k * unit : min(stop - k * unit, unit)])
            start = (k + 1) * unit
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.uint16), *out])


def write_tokens(df: DataFrame, folder: str, vocabulary: str, end_id: int = 2, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every text, ``end_id`` after each, in ascending id order.

    Returns one row for each file: part (long), tokens (long). Null or empty texts are
    the end id alone. Null doc ids come first, repeated ids in the order of a hash of their texts.
    An empty table writes no file. Other columns play no part.

    The range partitioning by id is the only shuffle; the number of files follows the
    input's bytes. Files are written as the result is computed, which is at once.
    """
    spark = df.sparkSession
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // FILE_BYTES))
    id_type = np.uint16 if max(end_id + 1, len(byte_bpe(vocabulary).pieces)) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]):
        writer = None
        part = TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi, ids, cut in encoded_passes(batch, 1, vocabulary):
                if writer is None:
                    writer = TokenWriter(folder, part, length, batch.schema.field(0).type, id_type)
                writer.add(batch.column(0).slice(lo, hi - lo), np.insert(ids, cut[1:], end_id), np.diff(cut) + 1)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([writer.total], pa.int64())], ["part", "tokens"])

    # the second key spreads rows of one id (or none), the third those that are equal in text too;
    # a hash, so that range sampling never carries texts
    keyed = rows.withColumns({"h": F.xxhash64("text"), "n": F.monotonically_increasing_id()})
    order = keyed.repartitionByRange(parts, "id", "h", "n").sortWithinPartitions("id", "h", "text").drop("h", "n")
    manifest = f"{folder}/manifest"
    order.mapInArrow(run, "part bigint, tokens bigint").write.parquet(manifest)
    return spark.read.schema("part bigint, tokens bigint").parquet(manifest)


def read_digests(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Where each file begins in the whole stream is a running sum over the manifest, which
    has one row for each file. Every file is read by one task.
    """
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("part", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = TokenReader(folder, part)
                for docs in reader.docs.to_batches(max_chunksize=4096):
                    starts, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crc = [zlib.crc32(reader.ids(a, n).astype("<u4").tobytes()) for a, n in zip(starts.tolist(), sizes.tolist())]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + base), docs.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = files.repartition(max(1, manifest.count()), "part")
    return dealt.mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(df: DataFrame, vocabulary: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``write_tokens`` into ``folder`` (a fresh scratch folder if none), then ``read_digests`` of it."""
    folder = folder or scratch_dir(df.sparkSession)
    manifest = write_tokens(df, folder, vocabulary, id_col=id_col, text_col=text_col)
    return read_digests(df.sparkSession, folder, manifest, dict(df.dtypes)[id_col])
