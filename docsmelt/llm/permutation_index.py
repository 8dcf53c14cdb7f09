"""Approximate nearest neighbours by a permutation index (operator 3).

Largest inner products become least distances by one added component: a vector x gets
sqrt(M^2 - |x|^2), with M the largest norm of the table, and a query, which ranks the same
at any length, is brought to norm M and gets zero. A vector is represented by its nearest
pivots in order. Each pivot's inverted file posts the vectors that have it among theirs,
with its place. The footrule distance of two such orders, with missing pivots at the end,
falls by twice (places - the later of the two places) for each shared pivot, so walking the
files of a query's pivots ranks all vectors that share one. The nearest by footrule are
reranked by the exact inner product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsmelt.llm.vector_blocks import Block, search_blocks, valid_vectors

#: Vectors that pivots are chosen from (those with the least hashes), and pivots, which are broadcast.
SAMPLE, PIVOTS = 2_048, 512
#: Pivots in the order that represents a vector.
PLACES = 96
#: Distinct vectors of a block that are reranked, at least, and as a part of the block.
RERANK, RERANK_PART = 400, 0.07
#: Rows whose distances to all pivots are formed at once.
ORDER_ROWS = 2_048


class PermutationIndex:
    """Index of distinct vectors whose norms are ``longest`` at most."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, places: int, longest: float):
        self.longest, self.places = longest, min(places, len(pivots))
        self.pivots = np.hstack((pivots, self.added(pivots)))
        orders = self.order(np.hstack((vectors, self.added(vectors))))
        flat = orders.ravel()
        post = np.argsort(flat, kind="stable")
        self.first = np.searchsorted(flat[post], np.arange(len(pivots) + 1))
        self.rows = post // self.places
        self.kind = np.int16 if self.places < 181 else np.int32  # holds the sum of all places
        self.place = (post % self.places).astype(self.kind)
        self.size = len(vectors)
        most = self.places * (self.places + 1) // 2  # what an order shares with itself
        self.numbers = np.arange(self.size, dtype=np.int32 if (most + 1) * self.size < 2**31 else np.int64)

    def added(self, vectors: np.ndarray) -> np.ndarray:
        """The component that brings vectors to the largest norm."""
        return np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1, keepdims=True), 0))

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """Each vector's nearest pivots (Euclidean), nearest first, ties to the earlier pivot."""
        out = np.empty((len(vectors), self.places), np.int16)
        for i in range(0, len(vectors), ORDER_ROWS):
            far = (self.pivots**2).sum(axis=1)[None, :] - 2 * (vectors[i : i + ORDER_ROWS] @ self.pivots.T)
            out[i : i + ORDER_ROWS] = np.argsort(far, axis=1, kind="stable")[:, : self.places]
        return out

    def order_of_queries(self, queries: np.ndarray) -> np.ndarray:
        unit = queries / np.abs(queries).max(axis=1, keepdims=True)  # so that no square over- or underflows
        unit *= self.longest / np.sqrt((unit**2).sum(axis=1, keepdims=True))
        return self.order(np.hstack((unit, np.zeros((len(unit), 1)))))

    def near(self, orders: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` vectors nearest to an order by footrule distance, ties to the earlier one; all, if they are fewer."""
        if self.size <= count:
            return np.arange(self.size)
        shared = np.zeros(self.size, self.kind)
        for place, pivot in enumerate(orders.tolist()):
            a, b = self.first[pivot], self.first[pivot + 1]
            shared[self.rows[a:b]] += self.kind(self.places) - np.maximum(self.place[a:b], self.kind(place))
        key = self.numbers - shared.astype(self.numbers.dtype) * self.numbers.dtype.type(self.size)
        return np.sort(np.argpartition(key, count)[:count])


def sample_vectors(vectors: DataFrame, rows: int, count: int) -> np.ndarray:
    """At most ``count`` distinct vectors, those with the least hashes.

    Only rows with hashes in the least part that holds some times as many, going by their
    number, are made distinct; all rows, where copies leave too few.
    """
    hashed = vectors.select("vec", F.xxhash64("vec").alias("h"))
    part = min(1.0, 8 * count / max(1, rows))
    for share in (part, 1.0) if part < 1 else (1.0,):
        least = hashed if share == 1.0 else hashed.where(F.col("h") < F.lit(int(-(2**63) + share * 2**64)))
        found = least.groupBy("h", "vec").count().orderBy("h", "vec").limit(count).select("vec").collect()
        if len(found) == count:
            break
    return np.array([r["vec"] for r in found], float)


def spread_pivots(sample: np.ndarray, count: int, longest: float) -> np.ndarray:
    """``count`` of the sampled vectors that lie far apart: each is the one farthest from those before it.

    Distances are those of the index, with the added component. A crowd of near copies,
    which holds as large a part of a plain sample as of the table, gets few pivots, so the
    orders of all other vectors still tell them apart.
    """
    if len(sample) <= count:
        return sample
    x = np.hstack((sample, np.sqrt(np.maximum(longest**2 - (sample**2).sum(axis=1, keepdims=True), 0))))
    far = ((x - x[0]) ** 2).sum(axis=1)
    taken = [0]
    while len(taken) < count:
        taken.append(int(np.argmax(far)))
        far = np.minimum(far, ((x - x[taken[-1]]) ** 2).sum(axis=1))
    return sample[taken]


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    pivots: int = PIVOTS,
    places: int = PLACES,
    rerank: int = RERANK,
    rerank_part: float = RERANK_PART,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found with the largest inner products.

    Which rows are found is approximate; scores are exact, in double precision. Queries
    are the rows where ``is_query`` (over the column ``id``) holds; candidates are all rows
    but those with the query's own id, every distinct vector is indexed. Ties go to the smaller
    vec_id. Rows with a null id, a null, zero or empty vector, null or non-finite
    components, or another number of components than most take no part. Repeated rows are
    candidates each; repeated queries are one. An empty table gives none. Other columns
    play no part.
    """
    vectors, rows, components, longest = valid_vectors(df, id_col, vector_col, True)
    chosen = spread_pivots(sample_vectors(vectors, rows, max(SAMPLE, pivots)), pivots, longest)
    shared = df.sparkSession.sparkContext.broadcast((chosen, longest))

    def index(block: Block):
        made = PermutationIndex(block.vectors, shared.value[0], places, shared.value[1])
        count = max(rerank, k, int(rerank_part * made.size))

        def search(ids: np.ndarray, queries: np.ndarray):
            asked, taken, gained = [], [], []
            for j, order in enumerate(made.order_of_queries(queries)):
                found = made.near(order, count)
                found = found[~block.lone[found] | (block.first[found] != ids[j])]  # each has a row besides the query's own
                scores = (block.vectors[found] * queries[j]).sum(axis=1)
                some = np.flatnonzero(scores >= np.partition(scores, -k)[-k]) if len(scores) > k else np.arange(len(scores))
                asked.append(np.full(len(some), j))
                taken.append(found[some])
                gained.append(scores[some])
            return block.best(*(np.concatenate(x) for x in (asked, taken, gained)), ids)

        return search

    return search_blocks(vectors, rows, components, is_query, k, index, "double")
