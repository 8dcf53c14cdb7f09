"""Quality classifier: hashed n-grams, FTRL-trained logistic regression (operator 9).

Words are runs of letters and digits, or of one kind of other sign; their lower-cased and
their written forms, adjoining pairs, and the pair of any word with itself are hashed
into ``SLOTS`` weights. A text is the
sparse vector of its n-grams, each occurrence weighing one over the square root of their
number. Training follows the regularised leader, coordinate by coordinate; scoring is a
sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsmelt.llm import textscan as ts
from docsmelt.llm.common import kept_names, passes, release_memory

BITS = 20
SLOTS = 1 << BITS
#: Labelled rows that training takes at most: those with the least hashes of their ids.
TRAIN_ROWS = 6_000
#: Bytes of features that training takes at most: rows in the order of those hashes until they are reached.
TRAIN_BYTES = 96 << 20
#: Texts of more bytes are not learnt from (they are scored), so that one row is bounded too.
TRAIN_TEXT_BYTES = 1 << 18
#: Passes over the training rows.
EPOCHS = 3

_SIGN = np.zeros(256, np.uint8)  # 0 white space, 1 letters, digits and bytes beyond ASCII, else one kind each
_SIGN[:] = np.arange(256)
_SIGN[ts.WORD_SPACE] = 0
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _SIGN[_a:_b] = 1
_SAME = np.uint64(0x5A5A5A5A5A5A5A5A)  # the n-gram "a word, then the same word", whichever it is
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-gram occurrences, text by text, and each text's first one."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _SIGN[data]
    change = np.empty(n, bool)
    change[0], change[1:] = True, kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    cut = np.flatnonzero(change | edge[:n])
    starts = cut[kind[cut] > 0]
    ends = np.append(cut[1:], n)[kind[cut] > 0]
    first = np.searchsorted(starts, offsets)
    lower = ts.byte_hashes(_LOWER[data], starts, ends)
    written = ts.byte_hashes(data, starts, ends)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    pair = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    pairs = ts.mix(lower[pair] * np.uint64(3) + lower[pair + 1])
    same = pair[lower[pair] == lower[pair + 1]]
    slots = np.concatenate((lower, ts.mix(written + np.uint64(1)), pairs, np.full(len(same), _SAME)))
    whose = np.concatenate((owner, owner, owner[pair], owner[same]))
    order = np.argsort(whose, kind="stable")
    return (slots[order] >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(whose[order], np.arange(len(count) + 1))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], alpha=10.0, beta=1.0, l1=0.01, l2=0.01, epochs=EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias) from (slots, values, label) rows in their order."""
    z, n, w = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            slots, values, label = rows[k]
            wi = w[slots]
            g = (_sigmoid(wi @ values) - label) * values
            ni = n[slots]
            grown = ni + g * g
            z[slots] += g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * wi
            n[slots] = grown
            zi = z[slots]
            w[slots] = np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(grown)) / alpha + l2))
    return w


def _sparse(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, count = np.unique(slots, return_counts=True)
    return np.append(distinct, SLOTS), np.append(count / np.sqrt(max(1, len(slots))), 1.0)


def training_rows(
    texts: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, most_bytes: int = TRAIN_BYTES, text_bytes: int = TRAIN_TEXT_BYTES
) -> list:
    """A bounded sample of labelled texts as sparse rows, in the order of their hashes.

    Which rows are taken depends on ids alone: the ``rows`` least by hash, as far as
    ``most_bytes`` of features go. They are picked from the labels first; of texts that
    share an id one is taken (that with the least hash), and texts of more than
    ``text_bytes`` none. So what comes to the driver, and to the one task that adds up the
    bytes, is bounded in rows and bytes however often an id repeats.
    """
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("_label"))
    # one label for each id; ids labelled both ways teach nothing
    picked = picked.groupBy(id_col).agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where("_label = _most")
    picked = picked.withColumn("_order", F.xxhash64(id_col, F.lit(9))).orderBy("_order", id_col).limit(rows)
    short = texts.select(id_col, F.col(text_col).alias("_text")).where(F.coalesce(F.octet_length("_text"), F.lit(0)) <= text_bytes)
    joined = short.join(F.broadcast(picked), id_col)  # at most ``rows`` rows

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(0)):
                slots, first = features(data, offsets)
                sparse = [_sparse(slots[a:b]) for a, b in zip(first.tolist(), first[1:].tolist())]
                columns = [pa.array([s.astype("<i4").tobytes() for s, _ in sparse], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in sparse], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(k).slice(lo, hi - lo) for k in (1, 2, 3))], ["slots", "values", "label", "ord", "id"])

    made = joined.select("_text", "_label", "_order", F.col(id_col).cast("string").alias("_id")).mapInArrow(run, "slots binary, values binary, label int, ord bigint, id string")
    one = made.groupBy("ord", "id").agg(F.min_by(F.struct("slots", "values", "label"), F.xxhash64("slots", "values")).alias("row")).select("ord", "id", "row.*")
    size = F.sum(F.octet_length("slots") + F.octet_length("values")).over(Window.orderBy("ord", "id"))
    taken = one.withColumn("size", size).where(F.col("size") <= most_bytes).select("slots", "values", "label", "ord", "id").toArrow().combine_chunks()
    slots, values, label = (taken.column(c).to_pylist() for c in ("slots", "values", "label"))
    keys = list(zip(taken.column("ord").to_pylist(), taken.column("id").to_pylist()))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return [(np.frombuffer(slots[k], "<i4"), np.frombuffer(values[k], "<f4"), label[k]) for k in order]


def quality_scores(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, score (0 to 1, higher: label 1 likelier), predicted, then ``keep``.

    One row for each input row; null and empty texts have no n-grams and score as the bias
    alone. The model is a fixed-size broadcast of ``SLOTS`` floats (4 MB). Null ids and
    repeated rows are scored like others; other columns play no part.
    """
    rows = df.select(df[id_col].alias("_id"), df[text_col].alias("_text"), *[df[c].alias(f"_k{i}") for i, c in enumerate(keep)])
    kinds = dict(rows.dtypes)
    model = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    names = ["_id", "score", "predicted", *[f"_k{i}" for i in range(len(keep))]]

    def run(batches: Iterator[pa.RecordBatch]):
        w = model.value
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(1)):
                slots, first = features(data, offsets)
                total = np.concatenate(([0.0], np.cumsum(w[slots].astype(float))))
                size = np.maximum(np.diff(first), 1)
                score = _sigmoid((total[first[1:]] - total[first[:-1]]) / np.sqrt(size) + float(w[SLOTS]))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(2 + i).slice(lo, hi - lo) for i in range(len(keep)))], names)

    schema = f"_id {kinds['_id']}, score double, predicted int" + "".join(f", _k{i} {kinds[f'_k{i}']}" for i in range(len(keep)))
    out = rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
    return out.withColumnsRenamed(kept_names(keep, ["score", "predicted", id_col]))


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves 0 modulo 5; such labels are never learnt."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit_quality(texts: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from at most ``rows`` labelled texts that are not held out, ``TRAIN_BYTES`` of features.

    Labels that are null, of unknown ids, or contradict each other are left out. Without
    any label all weights are zero, so every score is a half.
    """
    weights = train(training_rows(texts, labels.where(~held_out(id_col)), id_col, text_col, label_col, rows))
    release_memory()  # the training rows, of which nothing is kept
    return weights
