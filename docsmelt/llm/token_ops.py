"""BPE encoding and decoding of document tables (operator 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docsmelt.llm.bpe import byte_bpe
from docsmelt.llm.common import passes


def encoded_passes(batch: pa.RecordBatch, text: int, vocabulary: str):
    """(first row, last row, ids, offsets) of each pass over one Arrow batch."""
    bpe = byte_bpe(vocabulary)
    for lo, hi, data, offsets in passes(batch.column(text)):
        raw = data.tobytes()
        cut = offsets.tolist()
        yield lo, hi, *bpe.encode_batch([raw[a:b].decode() for a, b in zip(cut, cut[1:])])


def encode_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text and the text they decode to.

    Returns ``id_col``, ``ids`` (array<int>), ``decoded`` (string), one row for each
    input row, repeated rows and null ids included. A null text counts as empty: no
    ids, an empty decoded text. Special strings inside texts become their ids, as the
    library does by default. Other columns of the input play no part, whatever their
    names.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]):
        bpe = byte_bpe(vocabulary)
        for batch in batches:
            for lo, hi, ids, cut in encoded_passes(batch, 1, vocabulary):
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.view("i4")))
                texts = pa.array([bpe.decode(ids[a:b]) for a, b in zip(cut.tolist(), cut[1:].tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, texts], ["id", "ids", "decoded"])

    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_decode`` reduced to digests where the ids are, so that only digests travel.

    Returns ``id_col``, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 (decoded text in UTF-8). Nulls, empty texts, repeated
    rows and other columns as in ``encode_decode``.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]):
        bpe = byte_bpe(vocabulary)
        for batch in batches:
            for lo, hi, ids, cut in encoded_passes(batch, 1, vocabulary):
                ids, cut = ids.astype("<u4"), cut.tolist()
                spans = list(zip(cut, cut[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([b - a for a, b in spans], pa.int64()),
                        pa.array([hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in spans], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(ids[a:b]).encode()).hexdigest() for a, b in spans], pa.string()),
                    ],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
