"""Exact top-k by inner product over an impact-ordered index (operator 1).

Components are quantised to impacts of -127 to 127 parts of the block's largest one. A
posting (row, impact) lies in the segment of its component and its impact's magnitude;
segments are stored by descending magnitude, in levels. Rows lie in tiles by descending
norm, and each row has the norm of what its postings leave over after each level.

Queries take a tile level by level: the segments of a level are added to the accumulators
of all queries of a chunk together. A row's score then differs from its accumulator by the
query's norm times the row's rest at most, so rows whose accumulator plus that is below the
k-th best exact score found are out. Once the proof leaves few rows, or no level is left,
the rows that may be members are scored exactly. Nothing but this proof ends a search.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsmelt.llm.vector_blocks import Block, search_blocks, valid_vectors

#: Rows of a tile.
TILE_ROWS = 1 << 12
#: The largest quantised impact, and the least one of each level.
STEPS, LEVELS = 127, (64, 32, 16, 8, 3, 1)
#: Exact scores begin when the proof leaves at most this part of a tile's (query, row) pairs.
RESCORE_PART = 1 / 64
#: Bounds are looked at when a level, with those before it, adds one in so many of a tile's components.
CHECK_PART = 8
#: Component products that exact scoring forms at once.
STEP_VALUES = 1 << 21


def quantise(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where they all fit, else as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * vectors)
    if not len(scaled) or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    whole = lambda x: int(x) * scale if abs(x) >= 2.0**53 else math.floor(scale * x)
    out = np.empty(vectors.shape, object)
    out.ravel()[:] = [whole(x) for x in vectors.ravel().tolist()]
    return out


def _largest(values: np.ndarray) -> int:
    return max(int(values.max()), -int(values.min())) if values.size else 0


def _parts(values: np.ndarray, largest: int) -> np.ndarray:
    """Values as parts of the largest magnitude, each correctly rounded."""
    return (values / (largest or 1)).astype(float)


class _Tile:
    """Posting segments of some rows by descending level, and the rows' rests."""

    def __init__(self, parts: np.ndarray, at: np.ndarray):
        self.at = at  # numbers of the rows in the block
        self.shape = parts.shape
        code = np.rint(parts * STEPS).astype(np.int8)
        size = np.abs(code)
        level = np.searchsorted(-np.array(LEVELS), -size.ravel().astype(int), "left")  # len(LEVELS): no posting
        order = np.argsort(level.reshape(parts.shape).T.ravel(), kind="stable")  # by level, then component, then row
        order = order[: int((level < len(LEVELS)).sum())]
        self.component, self.row = np.divmod(order.astype(np.int32), np.int32(len(at)))
        self.impact = code[self.row, self.component]
        self.cuts = np.concatenate(([0], np.cumsum(np.bincount(level, minlength=len(LEVELS) + 1))))
        norm = np.sqrt((parts**2).sum(axis=1))
        slack = norm * (parts.shape[1] + 16) * 2.0**-23 + 1e-30  # of 32-bit accumulators
        self.norm, self.rest, left = norm + slack, [], parts.copy()
        for k in range(len(LEVELS)):
            a, b = self.cuts[k], self.cuts[k + 1]
            left[self.row[a:b], self.component[a:b]] -= self.impact[a:b] / STEPS
            self.rest.append((np.sqrt((left**2).sum(axis=1)) * (1 + 1e-6) + slack).astype(np.float32))

    def segments(self, k: int) -> np.ndarray | None:
        """A level's segments laid out by row and component, so that one product adds them all; None if it has none."""
        a, b = self.cuts[k], self.cuts[k + 1]
        if a == b:
            return None
        out = np.zeros(self.shape, np.float32)
        out[self.row[a:b], self.component[a:b]] = self.impact[a:b]
        out /= STEPS
        return out


class ImpactIndex:
    """Index of a block's distinct vectors, given as integers."""

    def __init__(self, values: np.ndarray, block: Block):
        self.values, self.block, self.largest = values, block, _largest(values)
        parts = _parts(values, self.largest)
        order = np.argsort(-(parts**2).sum(axis=1), kind="stable")
        self.tiles = [_Tile(parts[at], at) for at in (order[i : i + TILE_ROWS] for i in range(0, len(order), TILE_ROWS))]
        #: vectors that only rows of one id have, by that id: they don't count for queries of the id
        lone = np.flatnonzero(block.lone)
        self.lone = lone[np.argsort(block.first[lone], kind="stable")]
        self.lone_ids = block.first[self.lone]

    def own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, vector number) of vectors that have no row but those with the query's own id."""
        a, b = np.searchsorted(self.lone_ids, ids), np.searchsorted(self.lone_ids, ids, "right")
        query = np.repeat(np.arange(len(ids)), b - a)
        return query, self.lone[np.arange(len(query)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]

    def exact(self, queries: np.ndarray, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products of (query, row) pairs, exact at any magnitude."""
        bound = len(queries[0]) * _largest(queries) * self.largest
        kind = float if bound < 2**53 else np.int64 if bound < 2**63 else object
        values, queries = self.values.astype(kind, copy=False), queries.astype(kind, copy=False)
        out, step = np.zeros(len(query), kind), max(1, STEP_VALUES // queries.shape[1])
        for i in range(0, len(query), step):
            out[i : i + step] = (values[rows[i : i + step]] * queries[query[i : i + step]]).sum(axis=1)
        return out.astype(np.int64) if kind is float else out

    def search(self, ids: np.ndarray, queries: np.ndarray):
        """Query numbers, vec ids and scores of each query's k best rows."""
        k, m, most = self.block.k, len(ids), _largest(queries)
        parts = _parts(queries, most)
        narrow, norm = parts.astype(np.float32), np.sqrt((parts**2).sum(axis=1)) * (1 + 1e-6)
        unit = self.largest * most  # accumulators are parts of it
        own_query, own_row = self.own(ids)
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query, vector, score
        floor = np.full(m, -np.inf)  # below the k-th best exact score, in accumulator parts

        def take(query: np.ndarray, rows: np.ndarray):
            nonlocal kept
            score = self.exact(queries, query, rows)
            query, rows = np.concatenate((kept[0], query)), np.concatenate((kept[1], rows))
            score = np.concatenate((kept[2].astype(score.dtype), score))
            # of vectors with equal scores, k with the smallest ids are enough
            smallest = self.block.smallest(rows, ids[query])
            if score.dtype == object:
                order = np.array(sorted(range(len(query)), key=lambda i: (query[i], -score[i], smallest[i], rows[i])), np.int64)
            else:
                order = np.lexsort((rows, smallest, -score, query))
            query, rows, score = query[order], rows[order], score[order]
            new = np.ones(len(query), bool)  # a row may come twice, first to set the floor
            new[1:] = (query[1:] != query[:-1]) | (rows[1:] != rows[:-1])
            query, rows, score = query[new], rows[new], score[new]
            nth = np.arange(len(query)) - np.searchsorted(query, query)
            last = np.flatnonzero(nth == k - 1)
            least = np.array([s / unit if unit else 0.0 for s in score[last].tolist()], float)
            floor[query[last]] = least - np.abs(least) * 1e-6 - 1e-30
            kept = query[nth < k], rows[nth < k], score[nth < k]

        for tile in self.tiles:
            ask = np.flatnonzero(norm * tile.norm[0] >= floor)  # norms descend, so later tiles fall to the same proof
            if not len(ask):
                break
            n = len(tile.at)
            total = np.zeros((len(ask), n), np.float32)
            where = np.full(len(self.values), -1, np.int64)
            where[tile.at] = np.arange(n)
            place = np.full(m, -1, np.int64)
            place[ask] = np.arange(len(ask))
            mine = (where[own_row] >= 0) & (place[own_query] >= 0)
            out = place[own_query[mine]], where[own_row[mine]]
            alive, added = None, 0
            for level in range(len(LEVELS)):
                segments = tile.segments(level)
                if segments is not None:
                    total += narrow[ask] @ segments.T
                added += int(tile.cuts[level + 1] - tile.cuts[level])
                if level + 1 < len(LEVELS) and added * CHECK_PART < total.shape[1] * len(queries[0]):
                    continue  # too little has changed to look at the bounds again
                added = 0
                reach = norm[ask].astype(np.float32)[:, None] * (1 + np.float32(1e-6)) * tile.rest[level][None, :]
                if np.isneginf(floor[ask]).any():  # exact scores of likely members set the floor
                    likely = total - reach
                    likely[out] = -np.inf
                    head = min(k, n)
                    top = np.argpartition(-likely, head - 1, axis=1)[:, :head] if head < n else np.tile(np.arange(n), (len(ask), 1))
                    a, b = np.repeat(np.arange(len(ask)), head), top.ravel()
                    good = ~np.isneginf(likely[a, b])
                    take(ask[a[good]], tile.at[b[good]])
                reach += total
                reach[out] = -np.inf
                alive = reach >= floor[ask].astype(np.float32)[:, None]
                alive[out] = False
                if alive.sum() <= RESCORE_PART * alive.size:
                    break
            a, b = np.nonzero(alive)
            take(ask[a], tile.at[b])
        query, rows, score = kept
        query, found, score = self.block.best(query, rows, score, ids)
        if score.dtype == object:
            if any(abs(s) >= 2**63 for s in score.tolist()):
                raise OverflowError("a score among the best is beyond 64 bits")
            score = score.astype(np.int64)
        return query, found, score


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products of floor(scale * x).

    Queries are the rows where ``is_query`` (over the column ``id``) holds; candidates are
    all rows but those with the query's own id. Ties go to the smaller vec_id. Rows with a
    null id, a null vector, null or non-finite components, or another number of components
    than most take no part. Repeated rows are candidates each; repeated queries are one.
    Fewer candidates than k give fewer rows, an empty table none. Other columns play no
    part. Components may be of any magnitude; a score among the best that does not fit in
    64 bits is an error, never cut.
    """
    rows, count, components, _ = valid_vectors(df, id_col, vector_col, False)

    def index(block: Block):
        made = ImpactIndex(quantise(block.vectors, scale), block)
        return lambda ids, queries: made.search(ids, quantise(queries, scale))

    return search_blocks(rows, count, components, is_query, k, index, "bigint")


def every(n: int) -> Column:
    return F.col("id") % n == 0
