"""Removal of repeated word passages by fixed-block anchors (operator 2).

Every text is cut into non-overlapping blocks of half a window; these reference blocks are
the index. Every rolling window of the same length probes it. Any repeated window of w
words holds one whole block of each place it occurs at, so the blocks that a probe from
elsewhere hits are anchors: only windows around them can be repeats. Hits extend to the
windows that hold them, and windows found at two places at least are confirmed by 96 bits
of two independent hashes (among 10^13 windows two different ones agree with a chance of
10^-3 at most in all); adjoining confirmed windows are the maximal repeats.

Rows travel in batches of a few megabytes of text. A batch sends each hash once, however
often it occurs there, packed in one row for each bucket of hashes; a passage that a third
of all texts share is one entry for each batch. Texts are shuffled once, into batches, and
the three passes over them read the same exchange. Batches and buckets both grow with the
square root of the table once rows would get short, so neither has a largest number.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsmelt.llm import textscan as ts
from docsmelt.llm.common import kept_names, passes, release_memory

#: Text bytes of one batch, and words of one bucket of hashes, at least.
BATCH_BYTES = 4 << 20
BUCKET_WORDS = 1 << 20
#: Hashes that a batch has for a bucket at least, on average, so that rows don't get tiny:
#: batches and buckets grow beyond the least sizes for it.
LEAST_PER_ROW = 64
#: Bytes that a word is taken to have with its blank.
WORD_BYTES = 6
#: Words beyond this many bytes are hashed by a digest that nobody can make collide.
LONG_WORD = 1 << 9

_SECOND = np.uint64(0xD6E8FEB86659FD93)
_THIRD = np.uint64(0xA0761D6478BD642F)
#: What identifies a window: 64 bits of one hash and 32 of the other.
WIDE = np.dtype([("a", "<u8"), ("b", "<u4")])


class _Windows:
    """Hashes of all windows of one batch, and the words they cover; second hashes of those of size ``twice``."""

    def __init__(self, texts, sizes: tuple[int, ...], twice: int = 0):
        self.hashes = {s: [] for s in sizes}
        self.second = []
        self.starts = {s: [] for s in sizes}  # number of a window's first word in the batch
        self.counts = []
        self.word_in_doc = []
        base = 0
        for _, _, data, offsets in passes(texts):
            starts, ends, first = ts.words(data, offsets)
            count = np.diff(first)
            self.counts.append(count)
            plain = ts.byte_hashes(data, starts, ends)
            for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
                plain[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
            sums = ts.prefix_sums(ts.mix(plain ^ _SECOND))
            other = ts.prefix_sums(ts.mix(ts.mix(plain + _THIRD) ^ _SECOND)) if twice else None
            owner = np.repeat(np.arange(len(count)), count)
            nth = np.arange(len(starts)) - first[owner]
            for s in sizes:
                at = np.flatnonzero(nth + s <= count[owner])
                self.hashes[s].append(ts.span_hash(sums, at, at + s))
                self.starts[s].append(at + base)
                if s == twice:
                    self.second.append((ts.span_hash(other, at, at + s) >> np.uint64(32)).astype(np.uint32))
            self.word_in_doc.append(nth)
            base += len(starts)
        none = np.zeros(0, np.int64)
        self.words = base
        self.counts = np.concatenate([none, *self.counts])
        self.word_in_doc = np.concatenate([none, *self.word_in_doc])
        for s in sizes:
            self.hashes[s] = np.concatenate([np.zeros(0, np.uint64), *self.hashes[s]])
            self.starts[s] = np.concatenate([none, *self.starts[s]])
        self.second = np.concatenate([np.zeros(0, np.uint32), *self.second])


def wide_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = np.empty(len(first), WIDE)
    out["a"], out["b"] = first, second
    return out


def distinct_wide(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct windows, and those of them that occur more than once."""
    values = values[np.lexsort((values["b"], values["a"]))]
    new = np.ones(len(values), bool)
    new[1:] = (values["a"][1:] != values["a"][:-1]) | (values["b"][1:] != values["b"][:-1])
    at = np.flatnonzero(new)
    return values[at], values[at[np.diff(np.append(at, len(values))) > 1]]


def in_wide(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which windows are in the sorted table; entries with one first hash are looked at one after another."""
    out = np.zeros(len(values), bool)
    at = np.searchsorted(table["a"], values["a"])
    live = np.flatnonzero(at < len(table))
    while len(live):
        live = live[table["a"][at[live]] == values["a"][live]]
        out[live] |= table["b"][at[live]] == values["b"][live]
        at[live] += 1
        live = live[~out[live] & (at[live] < len(table))]
    return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _rows(batch: int, bucket: np.ndarray, columns: list[np.ndarray], names: list[str], sort: bool = True) -> pa.Table:
    """One row for each bucket, each column's values of it as bytes. ``bucket`` goes with the first column; others are (bucket, values)."""
    keys = np.unique(bucket)
    out = {"batch": pa.array(np.full(len(keys), batch), pa.int64()), "bucket": pa.array(keys)}
    for name, (where, values) in zip(names, columns):
        order = np.argsort(where, kind="stable")
        where, values = where[order], values[order]
        a, b = np.searchsorted(where, keys), np.searchsorted(where, keys, "right")
        out[name] = pa.array([values[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist())], pa.binary())
    return pa.table(out)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and those of them that occur more than once."""
    distinct, count = np.unique(values, return_counts=True)
    return distinct, distinct[count > 1]


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _gathered(blobs: list[bytes], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(b, kind) for b in blobs)])


def layout(size: int) -> tuple[int, int]:
    """Numbers of batches and of buckets for ``size`` bytes of text.

    A batch has hashes for all buckets, so the rows between them are the product of both
    numbers; beyond some size both units grow with the square root of it, which keeps
    ``LEAST_PER_ROW`` hashes in a row at any size.
    """
    words = -(-size // WORD_BYTES)
    least = math.isqrt(LEAST_PER_ROW * words)
    return max(1, -(-words // max(BATCH_BYTES // WORD_BYTES, least))), max(1, -(-words // max(BUCKET_WORDS, least)))


def _hash_in_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low half of the hash as one number, as the first exchange carries them."""
    return (_bucket(hashes, buckets).astype(np.uint64) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def remove_repeats(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that occurs anywhere else.

    Words are ``[^\\x20\\x09-\\x0D]+`` and compared unchanged; windows lie in one text, are
    judged on the input, and may repeat within one text or overlap. Returns ``id_col``,
    n_words, n_removed, kept_text (kept words joined by one space), then the columns of
    ``keep``, one row for each input row. Null and empty texts have no words. Repeated rows
    (null or equal ids too) are separate texts, so rows of ``window`` words or more that
    repeat lose all words. An empty table gives none. Other columns play no part.
    """
    block = (window + 1) // 2
    rows = df.select(df[id_col].alias("_id"), df[text_col].alias("_text"), *[df[c].alias(f"_k{i}") for i, c in enumerate(keep)])
    kinds = dict(rows.dtypes)
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    batches, buckets = layout(size)
    # dealt by a hash of the row and its number in the input, so that not even equal rows gather in one batch
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("_id", "_text", F.monotonically_increasing_id()), F.lit(batches)))

    def probe(key, table):
        w = _Windows(table.column("_text"), (block,))
        rolling, _ = _distinct(w.hashes[block])
        anchors = np.unique(w.hashes[block][w.word_in_doc[w.starts[block]] % block == 0])
        where = _bucket(rolling, buckets)
        low = lambda h: (h & np.uint64(0xFFFFFFFF)).astype("<u4")
        return _rows(key[0].as_py(), where, [(where, low(rolling)), (_bucket(anchors, buckets), low(anchors))], ["rolling", "anchors"])

    def match(key, table):
        hit = _distinct(_gathered([np.unique(np.frombuffer(b, "<u4")).tobytes() for b in table.column("rolling").to_pylist()], "<u4"))[1]
        bucket, out = key[0].as_py(), []
        for batch, blob in zip(table.column("batch").to_pylist(), table.column("anchors").to_pylist()):
            mine = np.unique(np.frombuffer(blob, "<u4"))
            mine = mine[_member(mine, hit)]
            if len(mine):
                out.append((batch, bucket, mine.tobytes()))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["batch", "bucket", "hits"])

    def extend(key, table, replies):
        w = _Windows(table.column("_text"), (block, window), window)
        hits = [np.frombuffer(b, "<u4").astype(np.uint64) | np.uint64(k << 32) for k, b in zip(replies.column("bucket").to_pylist(), replies.column("hits").to_pylist())]
        hits = np.sort(np.concatenate([np.zeros(0, np.uint64), *hits]))
        at, hashes = w.starts[block], w.hashes[block]
        lies = w.word_in_doc[at] % block == 0
        at, hashes = at[lies], hashes[lies]
        anchor = _member(hashes, _distinct(w.hashes[block])[1]) | _member(_hash_in_bucket(hashes, buckets), hits)
        # windows that hold the block: from window - block words before it to its own start
        edge = np.zeros(w.words + 1, np.int64)
        np.add.at(edge, np.maximum(at[anchor] - (window - block), 0), 1)
        np.add.at(edge, at[anchor] + 1, -1)
        near = np.cumsum(edge)[w.starts[window]] > 0
        wide = distinct_wide(wide_of(w.hashes[window][near], w.second[near]))[0]
        where = _bucket(wide["a"], buckets)
        return _rows(key[0].as_py(), where, [(where, wide)], ["wide"])

    def confirm(key, table):
        blobs = table.column("wide").to_pylist()
        again, out = distinct_wide(_gathered(blobs, WIDE))[1], []
        for batch, blob in zip(table.column("batch").to_pylist(), blobs):
            mine = np.frombuffer(blob, WIDE)
            mine = mine[in_wide(mine, again)]
            if len(mine):
                out.append((batch, mine.tobytes()))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary()))], ["batch", "again"])

    def mark(key, table, replies):
        texts = table.column("_text")
        w = _Windows(texts, (window,), window)
        here = wide_of(w.hashes[window], w.second)
        again = _gathered(replies.column("again").to_pylist(), WIDE)
        again = distinct_wide(np.concatenate((again, distinct_wide(here)[1])))[0]
        at = w.starts[window][in_wide(here, again)]
        edge = np.zeros(w.words + window + 1, np.int64)
        edge[at] += 1
        edge[at + window] -= 1
        gone = np.cumsum(edge)[: w.words] > 0
        first = np.concatenate(([0], np.cumsum(w.counts)))
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[first])
        kept, base = [], 0
        for lo, hi, data, offsets in passes(texts):
            starts, ends, mine = ts.words(data, offsets)
            stay = ~gone[base : base + len(starts)]
            base += len(starts)
            flat, begin, end = ts.joined(data, starts[stay], ends[stay])
            cut = np.concatenate(([0], np.cumsum(stay)))[mine]
            raw, begin, end = flat.tobytes(), begin.tolist(), end.tolist()
            kept += [raw[begin[a] : end[b - 1]].decode() if b > a else "" for a, b in zip(cut.tolist(), cut[1:].tolist())]
        return pa.table(
            [table.column("_id"), pa.array(w.counts), pa.array(removed), pa.array(kept, pa.string()), *[table.column(f"_k{i}") for i in range(len(keep))]],
            ["_id", "n_words", "n_removed", "kept_text", *[f"_k{i}" for i in range(len(keep))]],
        )

    def lean(work):
        """A group's work, after which its memory goes back: the next group is another worker's or as large."""

        def two(key, table):
            try:
                return work(key, table)
            finally:
                release_memory()

        def three(key, table, replies):
            try:
                return work(key, table, replies)
            finally:
                release_memory()

        return three if work in (extend, mark) else two

    texts = dealt.groupBy("batch")
    probes = texts.applyInArrow(lean(probe), "batch bigint, bucket bigint, rolling binary, anchors binary")
    hits = probes.groupBy("bucket").applyInArrow(lean(match), "batch bigint, bucket bigint, hits binary")
    wide = texts.cogroup(hits.groupBy("batch")).applyInArrow(lean(extend), "batch bigint, bucket bigint, wide binary")
    again = wide.groupBy("bucket").applyInArrow(lean(confirm), "batch bigint, again binary")
    schema = f"_id {kinds['_id']}, n_words bigint, n_removed bigint, kept_text string" + "".join(f", _k{i} {kinds[f'_k{i}']}" for i in range(len(keep)))
    out = texts.cogroup(again.groupBy("batch")).applyInArrow(lean(mark), schema)
    return out.withColumnRenamed("_id", id_col).withColumnsRenamed(kept_names(keep, ["n_words", "n_removed", "kept_text", id_col]))
