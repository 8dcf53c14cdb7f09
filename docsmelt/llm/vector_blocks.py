"""Query vectors against all vectors, in blocks: what the two vector searches share.

Rows are dealt into blocks by a hash; a block's vectors travel once and its index is built
once, in the task that holds it. The stated queries travel to every block, sorted behind
its vectors, and stream past the index in chunks, so a task holds one block and one chunk
whatever their numbers. Work, and the traffic of queries, are the product of the number of
queries and the number of blocks, as the task states it; blocks grow with the square root
of the table up to ``BLOCK_VALUES``, beyond which their number grows with the table. No
pair of rows leaves a task unless it is among a query's best of the block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsmelt.llm.common import gather_ranges

#: Components that a block holds at most, and rows that it holds at least.
BLOCK_VALUES, LEAST_ROWS = 1 << 22, 1 << 12
#: Queries that go past an index at once.
QUERY_ROWS = 512


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> tuple[DataFrame, int, int, float]:
    """(id, vec) of the rows that take part, their number, their components, their largest norm.

    They have an id and a vector without null or non-finite components, with as many
    components as most valid rows have (the larger number if two are as frequent); empty
    ones, and zero ones if ``nonzero``, take no part.
    """
    kind = "array<float>" if dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = df.select(df[id_col].cast("bigint").alias("id"), df[vector_col].cast(kind).alias("vec"))
    good = "forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    rows = rows.where(f"id is not null and vec is not null and size(vec) > 0 and {good}")
    if nonzero:
        rows = rows.where("exists(vec, x -> x <> 0)")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("norm")).orderBy(F.desc("n"), F.desc("d")).first()
    n, d, longest = (sizes["n"], sizes["d"], sizes["norm"]) if sizes else (0, 0, 0.0)
    return rows.where(F.size("vec") == F.lit(d)), n, d, longest


def matrix(column: pa.Array) -> np.ndarray:
    """Rows by components of an Arrow list column, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
    return flat.reshape(len(column), -1).astype(float)


class Block:
    """The distinct vectors of a block, in the order of their smallest ids, and the ids of the rows that have each, ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, k: int):
        self.k = k
        raw = np.ascontiguousarray(vectors + 0.0)  # -0.0 is 0.0
        which = np.unique(raw.view(f"V{8 * raw.shape[1]}").ravel(), return_inverse=True)[1]
        order = np.lexsort((ids, which))
        head = order[np.flatnonzero(np.diff(which[order], prepend=-1))]  # each vector's row with the smallest id
        head = head[np.argsort(ids[head], kind="stable")]
        place = np.empty(len(head), np.int64)
        place[which[head]] = np.arange(len(head))
        which = place[which]
        order = np.lexsort((ids, which))
        times = np.minimum(copies, k)[order]  # more rows of one id and vector than k are never asked for
        self.vectors = raw[head]
        self.ids = np.repeat(ids[order], times)
        owner = np.repeat(which[order], times)
        self.cuts = np.searchsorted(owner, np.arange(len(head) + 1))
        # the smallest id of each vector, and the next one that differs (or none)
        self.first = self.ids[self.cuts[:-1]]
        self.second = np.full(len(head), np.iinfo(np.int64).max)
        other = np.flatnonzero(self.ids != self.first[owner])[::-1]
        self.second[owner[other]] = self.ids[other]
        self.lone = self.second == np.iinfo(np.int64).max  # all rows have one id

    def smallest(self, vectors: np.ndarray, but: np.ndarray) -> np.ndarray:
        """The smallest id of each of some vectors that is not the id beside it."""
        return np.where(self.first[vectors] == but, self.second[vectors], self.first[vectors])

    def best(self, query: np.ndarray, vectors: np.ndarray, scores: np.ndarray, query_ids: np.ndarray):
        """Each query's k best rows from (query number, vector number, score): query numbers, ids, scores."""
        # k rows of a vector are enough beside those with the query's own id, which are k at most
        size = np.minimum(np.diff(self.cuts)[vectors], 2 * self.k)
        ids = self.ids[gather_ranges(self.cuts[vectors], size)]
        query, scores = np.repeat(query, size), np.repeat(scores, size)
        other = ids != query_ids[query]
        return ranked(query[other], ids[other], scores[other], self.k)


def ranked(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best of each query, ties to the smaller id: (query, id, score) arrays in that order."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(ids)), key=lambda i: (query[i], -scores[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -scores, query))
    begin = np.searchsorted(query[order], query[order])
    order = order[np.arange(len(order)) - begin < k]
    return query[order], ids[order], scores[order]


def search_blocks(
    vectors: DataFrame, count: int, components: int, is_query: Column, k: int, index: Callable[[Block], Callable], score_type: str
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best rows, ties to the smaller vec_id.

    ``index(block)`` gives a function from (query ids, query matrix) to arrays of query
    numbers, ids and scores, in which each query's best ``k`` of the block are.
    """
    most = max(1, BLOCK_VALUES // max(1, components))
    blocks = max(1, -(-count // min(most, max(LEAST_ROWS, 64 * math.isqrt(count)))))
    # rows that are equal in id and vector become one with a number, combined before the shuffle
    once = vectors.groupBy("id", "vec").agg(F.count("*").alias("copies"))
    target = lambda block, asks: F.struct(block.cast("int").alias("block"), F.lit(asks).alias("asks"))
    home = F.array(target(F.pmod(F.xxhash64("id", "vec", F.lit(1)), F.lit(blocks)), False))
    everywhere = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: target(b, True))
    sent = once.select("id", "vec", "copies", F.explode(F.when(is_query, F.concat(home, everywhere)).otherwise(home)).alias("to"))
    rows = sent.select("to.block", "to.asks", "id", F.when(F.col("to.asks"), F.xxhash64("vec")).otherwise(0).alias("twin"), "copies", "vec")
    rows = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks", "id")
    kind = pa.int64() if score_type == "bigint" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]):
        block, held, search = None, [], None
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(np.diff(key, prepend=-1)).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if key[lo] // 2 != block:
                    block, held, search = key[lo] // 2, [], None
                if not key[lo] % 2:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if search is None and held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    column = lambda c: table.column(c).combine_chunks()
                    search = index(Block(column("id").to_numpy(), matrix(column("vec")), column("copies").to_numpy(), k))
                    held = []
                for at in range(lo, hi if search else lo, QUERY_ROWS):
                    some = batch.slice(at, min(hi - at, QUERY_ROWS))
                    ids = some.column(2).to_numpy()
                    query, found, score = search(ids, matrix(some.column(5)))
                    columns = [pa.array(ids[query]), pa.array(some.column(3).to_numpy()[query]), pa.array(found, pa.int64()), pa.array(score, kind)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "twin", "vec_id", "score"])

    found = rows.mapInArrow(run, f"query_id bigint, twin bigint, vec_id bigint, score {score_type}")
    rank = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
