"""SimHash near-duplicates by tiled exact comparison (operator 7).

Fingerprints are made where the texts are. Distinct fingerprints are laid in tiles by the
population counts of their parts: two fingerprints within the radius have part counts
whose differences sum to the radius at most, so tile pairs beyond that are never formed.
Pairs of tiles that remain are compared completely, by exclusive-or and bit counts in
numpy blocks. What leaves a tile pair is a spanning forest of its links, not the links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsmelt.llm import textscan as ts
from docsmelt.llm.common import materialise, passes
from docsmelt.llm.components import connected_components, link_roots

#: Rows of one side of a numpy comparison; a block holds its square in bytes and words.
BLOCK = 512
#: Tiles that a fingerprint may visit before tiles become ranges of the population count.
MOST_STEPS = 100
#: Rows of such a range tile, and of a tile of part counts before there are more parts.
TILE_ROWS = 1 << 15
#: Numbers of parts of a fingerprint word.
PARTS = (4, 8, 16)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int, seeds: tuple[int, ...]) -> np.ndarray:
    """One row of 64-bit fingerprint words for each text, one word for each seed."""
    starts, ends, first = ts.words(data, offsets)
    flat, begin, stop = ts.joined(_LOWER[data], starts, ends)
    view, digest = memoryview(flat.tobytes()), xxhash.xxh64_intdigest
    counts = np.diff(first)
    # a shingle begins at each word that has shingle - 1 after it; a short text has one
    owner = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(starts)) - first[owner]
    left = np.minimum(shingle, counts[owner])
    here = np.flatnonzero(nth + left <= counts[owner])
    here = here[(counts[owner[here]] >= shingle) | (nth[here] == 0)]
    a, b = begin[here].tolist(), stop[here + left[here] - 1].tolist()
    cuts = np.searchsorted(owner[here], np.arange(len(counts) + 1))
    size = np.diff(cuts)
    out = np.zeros((len(counts), len(seeds)), np.uint64)
    some = np.flatnonzero(size)
    for k, seed in enumerate(seeds):
        hashes = np.fromiter((digest(view[i:j], seed) for i, j in zip(a, b)), np.uint64, len(a))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if len(some):
            ones = np.add.reduceat(bits, cuts[some], axis=0, dtype=np.int64)
            over = (2 * ones > size[some][:, None]).astype(np.uint8)
            out[some, k] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(df: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the fingerprint (16 lower-case hex digits for each 64-bit word).

    Letters A-Z are lowered; words are ``[^\\x20\\x09-\\x0D]+``; shingles of ``shingle``
    words count as often as they occur; a shorter text is one shingle, a null or empty
    one has fingerprint zero. A bit is set when over half the shingles' XXH64 have it.
    Word k uses seed 42 + k.
    """
    seeds = tuple(range(42, 42 + words))
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(1)):
                found = fingerprints_of(data, offsets, shingle, seeds)
                text = ["".join(f"{x:016x}" for x in row) for row in found.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(text, pa.string())], ["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fingerprint string").withColumnRenamed("id", id_col)


def near_steps(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of part counts that sum to ``radius`` at most, one of each opposite two, and none."""
    out, none = [], (0,) * parts

    def grow(prefix: tuple[int, ...], left: int):
        if len(prefix) == parts:
            if prefix > none:
                out.append(prefix)
            return
        for d in range(-left, left + 1):
            grow((*prefix, d), left - abs(d))

    grow((), radius)
    return out


def close_links(mine: np.ndarray, other: np.ndarray, radius: int, same: bool):
    """Row numbers (i, j) of fingerprints that differ in at most ``radius`` bits, block by block."""
    mine, other = np.ascontiguousarray(mine.T), np.ascontiguousarray(other.T)
    n, m = mine.shape[1], other.shape[1]
    mixed, bits, far = np.empty(BLOCK * BLOCK, np.uint64), np.empty(BLOCK * BLOCK, np.uint8), np.empty(BLOCK * BLOCK, np.uint8)
    for i in range(0, n, BLOCK):
        for j in range(i if same else 0, m, BLOCK):
            a, b = mine[:, i : i + BLOCK], other[:, j : j + BLOCK]
            shape, size = (a.shape[1], b.shape[1]), a.shape[1] * b.shape[1]
            x, c, f = mixed[:size].reshape(shape), bits[:size].reshape(shape), far[:size].reshape(shape)
            for k in range(len(mine)):
                np.bitwise_xor(a[k][:, None], b[k][None, :], out=x)
                np.bitwise_count(x, out=c if k else f)
                if k:
                    np.add(f, c, out=f)
            at = np.flatnonzero(f.ravel() <= radius)
            u, v = at // shape[1], at % shape[1]
            if same and i == j:
                u, v = u[u < v], v[u < v]
            if len(u):
                yield u + i, v + j


def _forest(name: np.ndarray, home: int, radius: int, inside: bool = True) -> pa.Table:
    """Links (child, root) that span the components of links between the first ``home`` names and the rest, and, if ``inside``, within the first."""
    value = _values("".join(name.tolist()), len(name))
    within = close_links(value[:home], value[:home], radius, True) if inside else ()
    across = ((a, b + home) for a, b in close_links(value[:home], value[home:], radius, False))
    root = np.arange(len(name))
    for a, b in itertools.chain(within, across):  # folded in block by block, so links never pile up
        root = link_roots(root, a, b)
    child = np.flatnonzero(root != np.arange(len(name)))
    return pa.table([pa.array(name[child], pa.string()), pa.array(name[root[child]], pa.string())], ["a", "b"])


def _values(hexadecimal: str, rows: int) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(hexadecimal), ">u8").astype(np.uint64).reshape(rows, -1)


def fingerprint_links(prints: DataFrame, radius: int, parts: int | None = None, words: int = 1) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``radius`` bits.

    ``prints`` has one column, fingerprint, of distinct values. For small radii each
    64-bit word is cut in ``parts`` parts (``least_parts``, if not given) and a tile holds
    the fingerprints with the same part counts (``_part_tiles``); where that would make more than ``MOST_STEPS`` visits
    of each fingerprint, tiles are ranges of the whole population count (``_range_tiles``).
    Either way every pair within the radius is compared.
    """
    if count_steps((parts or PARTS[0]) * words, radius) <= MOST_STEPS or parts and parts > PARTS[0]:
        return _part_tiles(prints, radius, parts or least_parts(prints, radius, words, TILE_ROWS))
    return _range_tiles(prints, radius)


def count_steps(parts: int, radius: int) -> int:
    """Number of whole vectors of ``parts`` numbers whose magnitudes sum to ``radius`` at most."""
    return sum(2**k * math.comb(parts, k) * math.comb(radius, k) for k in range(min(parts, radius) + 1))


def part_counts(value: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of the ``parts`` parts of each fingerprint word."""
    width = 64 // parts
    cut = np.arange(parts, dtype=np.uint64) * np.uint64(width)
    mask = np.uint64((1 << width) - 1)
    return np.concatenate([np.bitwise_count((value[:, [k]] >> cut[None, :]) & mask) for k in range(value.shape[1])], axis=1).astype(np.int64)


def tile_keys(counts: np.ndarray, width: int) -> np.ndarray:
    key = np.zeros(len(counts), np.int64)
    for column in counts.T:
        key = key * (width + 1) + column
    return key


def least_parts(prints: DataFrame, radius: int, words: int, tile_rows: int) -> int:
    """The least of ``PARTS`` whose fullest tile has ``tile_rows`` fingerprints at most; the last, if none has.

    Tiles shrink by the power of the number of parts, and visits grow with its square for
    a radius of two (41, 145, 545 tiles), so parts follow the table's own counts.
    """
    for parts in PARTS[:-1]:
        if count_steps(parts * 2 * words, radius) > MOST_STEPS * 6:
            return parts

        def homes(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                if batch.num_rows:
                    value = _values("".join(batch.column(0).to_pylist()), batch.num_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(tile_keys(part_counts(value, parts), 64 // parts))], ["tile"])

        fullest = prints.select("fingerprint").mapInArrow(homes, "tile bigint").groupBy("tile").count().agg(F.max("count")).first()[0] or 0
        if fullest <= tile_rows:
            return parts
    return PARTS[-1]


def _part_tiles(prints: DataFrame, radius: int, parts: int) -> DataFrame:
    """A tile goes to itself and, as a visitor, to the tiles at each of ``near_steps``.

    A group is one tile and its visitors, compared block by block; the memory of a task is
    the fingerprints of one group.
    """
    width = 64 // parts

    def keyed(batches: Iterator[pa.RecordBatch]):
        steps = None
        for batch in batches:
            if not batch.num_rows:
                continue
            value = _values("".join(batch.column(0).to_pylist()), batch.num_rows)
            if steps is None:
                steps = np.array([(0,) * (parts * value.shape[1]), *near_steps(parts * value.shape[1], radius)])
            pops = part_counts(value, parts)
            for s, step in enumerate(steps):
                near = pops + step
                ok = np.flatnonzero(((near >= 0) & (near <= width)).all(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(tile_keys(near[ok], width)), pa.array(np.full(len(ok), s > 0)), batch.column(0).take(pa.array(ok))], ["tile", "visitor", "fingerprint"])

    def compare(key, table):
        visitor = table.column("visitor").to_numpy()
        name = table.column("fingerprint").to_numpy()
        order = np.argsort(visitor, kind="stable")
        return _forest(name[order], int((~visitor).sum()), radius)

    tiles = prints.select("fingerprint").mapInArrow(keyed, "tile bigint, visitor boolean, fingerprint string")
    return tiles.groupBy("tile").applyInArrow(compare, "a string, b string")


def _range_tiles(prints: DataFrame, radius: int) -> DataFrame:
    """Tiles of about ``TILE_ROWS`` fingerprints with adjoining population counts.

    Pairs of tiles whose counts differ by more than the radius are skipped. A tile travels
    as one packed row for each tile it meets, and a group is two such rows. All pairs of
    tiles that remain are compared, so the work grows with the square of the distinct
    fingerprints; their number is what exact copies don't raise.
    """
    def counted(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            value = _values("".join(batch.column(0).to_pylist()), batch.num_rows) if batch.num_rows else np.zeros((0, 1), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bitwise_count(value).sum(axis=1, dtype=np.int64))], ["fingerprint", "pop"])

    rows = prints.select("fingerprint").mapInArrow(counted, "fingerprint string, pop bigint")
    histogram = rows.groupBy("pop").count().orderBy("pop").collect()  # one row for each population count
    tiles, first, spread, last = [], {}, {}, None  # tiles: (least count, largest count)
    for pop, count in histogram:
        n = max(1, -(-count // TILE_ROWS))
        if n == 1 and last is not None and last + count <= TILE_ROWS:
            tiles[-1][1], last = pop, last + count
        else:
            tiles += [[pop, pop] for _ in range(n)]
            last = count if n == 1 else None
        first[pop], spread[pop] = len(tiles) - n, n
    if not tiles:
        return prints.selectExpr("fingerprint as a", "fingerprint as b").limit(0)
    lookup = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("pop"))
    dealt = rows.select("fingerprint", (lookup(first) + F.pmod(F.xxhash64("fingerprint"), lookup(spread))).cast("int").alias("tile"))

    def pack(key, table):
        mine, (low, high) = key[0].as_py(), tiles[key[0].as_py()]
        names = "".join(table.column("fingerprint").to_pylist()).encode()
        width = len(names) // table.num_rows
        meets = [t for t, (a, b) in enumerate(tiles) if a - high <= radius and low - b <= radius]
        n = len(meets)
        columns = [[min(mine, t) for t in meets], [max(mine, t) for t in meets], [mine] * n, [width] * n, [names] * n]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["u", "v", "tile", "width", "names"])

    def compare(key, table):
        names, home = [], 0
        for tile, width, raw in sorted(zip(*(table.column(c).to_pylist() for c in ("tile", "width", "names")))):
            raw = raw.decode()
            names += [raw[i : i + width] for i in range(0, len(raw), width)]
            if tile == key[0].as_py():
                home = len(names)
        return _forest(np.array(names, object), home, radius, key[0].as_py() == key[1].as_py())

    packed = dealt.groupBy("tile").applyInArrow(pack, "u int, v int, tile int, width int, names binary")
    return packed.groupBy("u", "v").applyInArrow(compare, "a string, b string")


def near_duplicates(df: DataFrame, shingle: int = 3, radius: int = 2, words: int = 1, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint, component_id: the smallest id reachable over close fingerprints.

    Texts link when their fingerprints differ in ``radius`` bits or fewer. Rows with the
    same fingerprint are one node, so copies never meet in pairs; their smallest id is
    found by aggregation. Null and empty texts have fingerprint zero and link like any
    other. Rows with a null id take part as links but never name a component unless all
    ids of it are null. Repeated rows give repeated results; an empty table gives none.
    Other columns play no part, whatever their names.
    """
    rows = materialise(fingerprints(df, shingle, words, id_col, text_col), "fingerprints")
    nodes = materialise(rows.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "nodes")
    roots = connected_components(fingerprint_links(nodes, radius, parts, words), "a", "b")
    grouped = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = grouped.join(named, "root").select("fingerprint", "component_id")
    return rows.join(labels, "fingerprint").select(id_col, "fingerprint", "component_id")
