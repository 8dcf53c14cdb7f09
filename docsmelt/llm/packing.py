"""Sequence packing by Karmarkar-Karp multiway differencing (operator 6)."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docsmelt.llm.common import kept_names, release_memory
from docsmelt.llm.token_ops import encoded_passes

#: Tokens that a task gathers before it packs them; whole windows, so little is padded.
GATHER_TOKENS = 1 << 20


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Partition items into k windows of near-equal sums.

    Every item starts as a partial partition of one filled and k - 1 empty windows. The
    two partitions with the largest imbalance merge, fullest window on emptiest, until
    one is left. Ties go to the partition made first, so the outcome is deterministic.
    Partitions keep filled windows only; emptiness stands for the rest.
    """
    heap, order = [], 0
    for i, s in enumerate(sizes.tolist()):
        # imbalance = fullest - emptiest; with windows kept as (sum, members), descending
        heap.append((-s if k > 1 else 0, order, [(s, [i])]))
        order += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a) - len(b)
        if free >= 0:  # each filled window finds an empty one
            merged = a + b
        else:
            over = -free  # the emptiest of a meet the emptiest of b in opposite order
            head_a, tail_a = a[: len(a) - over], a[len(a) - over :]
            head_b, tail_b = b[: len(b) - over], b[len(b) - over :]
            merged = head_a + head_b
            for (x, m), (y, n) in zip(tail_a, reversed(tail_b)):
                merged.append((x + y, m + n))
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (-(merged[0][0] - low), order, merged))
        order += 1
    return [members for _, members in heap[0][2]] if heap else []


def pack(sizes: np.ndarray, capacity: int):
    """Cut documents into pieces and lay the pieces in windows of at most ``capacity``.

    Returns arrays (document, start, length, window, offset). Every document first gives
    whole windows of its own. The remainders are partitioned by ``differencing`` into as
    few windows as their sum allows, with near-equal sums. What exceeds the capacity of a
    window is cut from the end of its longest member and moves to windows with room; the
    window count rises where no room is left. So less than one window is padding.
    """
    sizes = np.asarray(sizes, np.int64)
    whole = sizes // capacity
    doc = np.repeat(np.arange(len(sizes)), whole)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    full = (doc, nth * capacity, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), np.int64))
    rest = sizes - whole * capacity
    items = [(d, int(whole[d]) * capacity, int(rest[d])) for d in np.flatnonzero(rest).tolist()]
    if not items:
        return full
    total = int(rest.sum())
    least = -(-total // capacity)
    lengths = np.array([n for _, _, n in items], np.int64)
    windows = differencing(lengths, least)
    room = [capacity - int(lengths[w].sum()) for w in windows]
    spare = [w for w in range(len(windows)) if room[w] > 0]
    for w in [w for w in range(len(windows)) if room[w] < 0]:
        while room[w] < 0:  # the end of its longest member moves to windows with room
            i = max(windows[w], key=lambda j: (items[j][2], -j))
            d, s, n = items[i]
            if not spare:  # no room anywhere: the window count rises
                windows.append([])
                room.append(capacity)
                spare.append(len(windows) - 1)
            to = spare[-1]
            part = min(-room[w], room[to], n)
            windows[to].append(len(items))
            items.append((d, s + n - part, part))
            items[i] = (d, s, n - part)
            room[w] += part
            room[to] -= part
            if not room[to]:
                spare.pop()
            if part == n:
                windows[w].remove(i)
    out = []
    for w, members in enumerate(windows, len(doc)):
        offset = 0
        last = None
        for d, s, n in sorted(items[i] for i in members):
            if last is not None and out[last][0] == d and out[last][1] + out[last][2] == s:
                out[last] = (d, out[last][1], out[last][2] + n, w, out[last][4])  # halves that met again
            else:
                last = len(out)
                out.append((d, s, n, w, offset))
            offset += n
    return tuple(np.concatenate((a, np.array(b, np.int64))) for a, b in zip(full, zip(*out)))


def pack_documents(
    df: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False
) -> DataFrame:
    """Pack the ids of every text, ``end_id`` after each, into sequences of ``capacity``.

    One row for each piece: ``id_col``, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, then the columns named in ``keep``; with ``with_ids`` also the
    piece's ``ids``. A null or empty text is the end id alone. Null ids and repeated rows
    are documents like others (their pieces share the id). An empty table gives no row.
    Input columns that clash with output names are left out unless named in ``keep``;
    then they end in ``_input``.

    Tasks pack what they read, about a million tokens at a time: no shuffle, memory
    bound by that and the longest document, and the same outcome when a task runs again.
    """
    rows = df.select(df[id_col].alias("_id"), df[text_col].alias("_text"), *[df[c].alias(f"_k{i}") for i, c in enumerate(keep)])
    kinds = dict(rows.dtypes)

    def emit(held: list[pa.RecordBatch], ids: list[np.ndarray], cut: np.ndarray, base: int):
        flat = np.concatenate(ids).astype("<u4")
        doc, start, length, window, offset = pack(np.diff(cut), capacity)
        at = (cut[doc] + start).tolist()
        crc = [zlib.crc32(flat[a : a + n].tobytes()) for a, n in zip(at, length.tolist())]
        table = pa.Table.from_batches(held).combine_chunks().take(pa.array(doc))
        columns = [table.column(0).combine_chunks()]
        columns += [pa.array(x, pa.int64()) for x in (start, length, crc, np.diff(cut)[doc], base + window, offset)]
        names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(pa.array([flat[a : a + n].astype("i4") for a, n in zip(at, length.tolist())], pa.list_(pa.int32())))
            names.append("ids")
        columns += [table.column(1 + i).combine_chunks() for i in range(len(keep))]
        names += [f"_k{i}" for i in range(len(keep))]
        return pa.RecordBatch.from_arrays(columns, names), int(window.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]):
        base = TaskContext.get().partitionId() << 40
        held, ids, sizes, gathered = [], [], [], 0
        for batch in batches:
            others = batch.select([0, *range(2, batch.num_columns)])
            for lo, hi, flat, cut in encoded_passes(batch, 1, vocabulary):
                flat = np.insert(flat, cut[1:], end_id)
                cut = cut + np.arange(len(cut))
                held.append(others.slice(lo, hi - lo))
                ids.append(flat)
                sizes.append(np.diff(cut))
                gathered += len(flat)
                if gathered >= GATHER_TOKENS:
                    out, used = emit(held, ids, np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), base)
                    base += used
                    yield out
                    held, ids, sizes, gathered = [], [], [], 0
        if held:
            yield emit(held, ids, np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), base)[0]
        held, ids = [], []
        release_memory()

    schema = f"_id {kinds['_id']}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    schema += ", ids array<int>" * with_ids + "".join(f", _k{i} {kinds[f'_k{i}']}" for i in range(len(keep)))
    out = rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
    return out.withColumnsRenamed(kept_names(keep, ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", id_col]))
