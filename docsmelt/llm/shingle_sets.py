"""Near-duplicates by exact Jaccard similarity of shingle sets (the pipeline's stage).

Each text becomes the set of its shingles' 64-bit hashes and a sketch: hashes toggle bits,
so two sketches differ in no more bits than the sets differ in shingles, and sets of a
stated similarity differ in a bounded number. Sketches of like sizes are compared
completely, in tiles; since the bound holds for every pair, no pair at or above the
similarity is missed. What leaves a tile pair is a spanning forest of candidates. The sets
of a candidate component then meet once, and links are decided on the sets themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsmelt.llm import textscan as ts
from docsmelt.llm.common import gather_ranges, materialise, passes, release_memory, scratch_dir, scratch_scope, spans
from docsmelt.llm.components import connected_components, link_roots
from docsmelt.llm.simhash import _LOWER

#: Rows of one side of a numpy comparison.
BLOCK = 256
#: Rows of a tile: sets of adjoining sizes.
TILE_ROWS = 1 << 13
#: Shingles of candidate sets that one group of components holds, about; a component with more is compared block by block.
GROUP_SHINGLES = 1 << 21
#: Bits of the smallest sketch.
LEAST_BITS = 128
#: Words of sketches that are gathered at once for the second comparison.
GATHER_WORDS = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text, and each text's first place among them."""
    starts, ends, first = ts.words(data, offsets)
    flat, begin, stop = ts.joined(_LOWER[data], starts, ends)
    counts = np.diff(first)
    # a shingle begins at each word that has shingle - 1 after it; a short text has one
    owner = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(starts)) - first[owner]
    left = np.minimum(shingle, counts[owner])
    here = np.flatnonzero(nth + left <= counts[owner])
    here = here[(counts[owner[here]] >= shingle) | (nth[here] == 0)]
    hashes, owner = ts.byte_hashes(flat, begin[here], stop[here + left[here] - 1]), owner[here]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(counts) + 1))


def sketch_bits(sizes: np.ndarray) -> np.ndarray:
    """Bits of the sketches of sets: the power of two that is twice the size at least."""
    return np.maximum(LEAST_BITS, 2 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))


def sketches(hashes: np.ndarray, cuts: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all sketches and each one's first byte: shingle h toggles bit h modulo ``bits``."""
    base = np.concatenate(([0], np.cumsum(bits)))
    owner = np.repeat(np.arange(len(bits)), np.diff(cuts))
    at = base[owner] + (hashes & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(base[-1])).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little"), base // 8


def _binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def text_sets(df: DataFrame, shingle: int, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, text, name of the set, its size and sketch, for each row, then the columns of ``keep`` as _k0, _k1 and so on."""
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"), *[df[c].alias(f"_k{i}") for i, c in enumerate(keep)])
    names = ["id", "text", "set", "size", "sketch", *rows.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(1)):
                hashes, cuts = shingle_sets(data, offsets, shingle)
                size = np.diff(cuts)
                sketch, first = sketches(hashes, cuts, sketch_bits(size))
                raw = hashes.tobytes()
                name = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                given = [c.slice(lo, hi - lo) for c in batch.columns]
                columns = [*given[:2], pa.array(name, pa.string()), pa.array(size, pa.int64()), _binary(sketch, first), *given[2:]]
                yield pa.RecordBatch.from_arrays(columns, names)
        release_memory()

    kinds = dict(rows.dtypes) | {"set": "string", "size": "bigint", "sketch": "binary"}
    return rows.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def folded(rows: list[bytes], bits: int) -> np.ndarray:
    """Sketches cut to ``bits`` bits, one row of words each; toggles beyond fall on the bits they are equal to modulo ``bits``."""
    out = np.empty((len(rows), bits // 64), np.uint64)
    for i, raw in enumerate(rows):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, bits // 64), axis=0)
    return out


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between each row of ``a`` and each of ``b``."""
    out = np.zeros((len(a), len(b)), np.int32)
    mixed, bits = np.empty(out.shape, np.uint64), np.empty(out.shape, np.uint8)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        np.bitwise_xor(x[:, None], y[None, :], out=mixed)
        np.bitwise_count(mixed, out=bits)
        np.add(out, bits, out=out)
    return out


class Similarity:
    """A least Jaccard similarity as whole-number tests."""

    def __init__(self, least: float):
        self.part = Fraction(str(least))
        self.p, self.q = self.part.numerator, self.part.denominator

    def may(self, differ, sizes):
        """Whether sets with that sum of sizes may differ in ``differ`` shingles."""
        return differ * (self.p + self.q) <= (self.q - self.p) * sizes

    def holds(self, shared, sizes):
        """Whether sets with that sum of sizes and so many shingles in common are similar."""
        return shared * (self.p + self.q) >= self.p * sizes


def candidate_pairs(left: tuple[np.ndarray, list[bytes]], right: tuple[np.ndarray, list[bytes]], same: bool, rule: Similarity):
    """Row numbers (i, j) of sets, given as ascending sizes and sketches, that the sketches don't tell apart."""
    (n, a), (m, b) = left, right
    memo: dict[tuple, np.ndarray] = {}

    def block(side: int, rows: list[bytes], at: int, bits: int) -> np.ndarray:
        if (side, at, bits) not in memo:
            memo[side, at, bits] = folded(rows[at : at + BLOCK], bits)
        return memo[side, at, bits]

    for i in range(0, len(n), BLOCK):
        memo = {k: v for k, v in memo.items() if k[0]}
        for j in range(i if same else 0, len(m), BLOCK):
            x, y = n[i : i + BLOCK], m[j : j + BLOCK]
            gap = max(int(y[0] - x[-1]), int(x[0] - y[-1]), 0)
            small = int(x[-1]) if y[0] > x[-1] else int(y[-1])
            if gap and not rule.may(gap, 2 * small + gap):
                continue
            bits = 8 * min(len(a[i]), len(b[j]))
            whole = block(0, a, i, bits), block(1, b, j, bits)
            half = max(LEAST_BITS, bits // 2)
            cut = whole if half == bits else (block(0, a, i, half), block(1, b, j, half))
            differ = _differing(*cut)
            u, v = np.divmod(np.flatnonzero((differ * (rule.p + rule.q) <= (rule.q - rule.p) * int(x[-1] + y[-1])).ravel()), len(y))
            sizes = x[u] + y[v]
            ok = rule.may(np.maximum(differ[u, v], np.abs(x[u] - y[v])), sizes)
            if same and i == j:
                ok &= u < v
            u, v, sizes = u[ok], v[ok], sizes[ok]
            step = max(1, GATHER_WORDS // (bits // 64))
            for k in range(0, len(u) if half < bits else 0, step):
                part = slice(k, k + step)
                full = np.bitwise_count(whole[0][u[part]] ^ whole[1][v[part]]).sum(axis=1, dtype=np.int64)
                good = rule.may(full, sizes[part])
                if good.any():
                    yield u[part][good] + i, v[part][good] + j
            if half == bits and len(u):
                yield u + i, v + j


def candidate_links(nodes: DataFrame, rule: Similarity) -> DataFrame:
    """Links (a, b) whose components are those of all pairs that the sketches don't tell apart.

    ``nodes`` has at (a number of its own), size (one at least) and sketch. Tiles are
    ranges of sizes; a tile goes to each tile with sizes near enough to be similar.
    """
    band = F.floor(F.log2("size") * 8).cast("int")
    rows = nodes.select("at", "size", "sketch", band.alias("band"))
    histogram = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high")).orderBy("band").collect()
    tiles, first, spread, last = [], {}, {}, None  # tiles: (least size, largest size)
    for r in histogram:
        n = -(-r["n"] // TILE_ROWS)
        if n == 1 and last is not None and last + r["n"] <= TILE_ROWS:
            tiles[-1][1], last = r["high"], last + r["n"]
        else:
            tiles += [[r["low"], r["high"]] for _ in range(n)]
            last = r["n"] if n == 1 else None
        first[r["band"]], spread[r["band"]] = len(tiles) - n, n

    # sizes a <= b may be similar where a * q >= b * p, so the tiles near to one are neighbours
    low, high = (np.array([t[k] for t in tiles], np.int64) for k in (0, 1))
    begin = np.searchsorted(high * rule.q, low * rule.p, "left")
    reach = np.searchsorted(low * rule.p, high * rule.q, "right") - begin

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            bands, at = batch.column(3).to_numpy(), batch.column(0).to_numpy()
            mixed = ts.mix(at.astype(np.uint64))
            tile = np.array([first[b] for b in bands.tolist()]) + (mixed % np.array([spread[b] for b in bands.tolist()], np.uint64)).astype(np.int64)
            # few copies at a time, whatever the number of tiles, and fewer where sketches are long
            for lo, hi in spans(np.concatenate(([0], np.cumsum(reach[tile]))), 4096):
                mine = tile[lo:hi]
                other = gather_ranges(begin[mine], reach[mine])
                take = np.repeat(np.arange(lo, hi), reach[mine])
                u, v, some = np.minimum(tile[take], other), np.maximum(tile[take], other), pa.array(take)
                columns = [pa.array(c, pa.int32()) for c in (u, v, tile[take])]
                yield pa.RecordBatch.from_arrays([*columns, *[batch.column(c).take(some) for c in range(3)]], ["u", "v", "tile", "at", "size", "sketch"])

    def compare(key, table):
        table = table.sort_by("size")
        tile, at, size = (table.column(c).to_numpy() for c in ("tile", "at", "size"))
        sketch = np.array(table.column("sketch").to_pylist() + [None], object)[:-1]
        u, same = key[0].as_py(), key[0].as_py() == key[1].as_py()
        one, two = np.flatnonzero(tile == u), np.flatnonzero(tile == u if same else tile != u)
        root = np.arange(len(at))
        if len(one) and len(two):
            for a, b in candidate_pairs((size[one], sketch[one].tolist()), (size[two], sketch[two].tolist()), same, rule):
                root = link_roots(root, one[a], two[b])  # folded in block by block, so pairs never pile up
        child = np.flatnonzero(root != np.arange(len(root)))
        return pa.table([pa.array(at[child]), pa.array(at[root[child]])], ["a", "b"])

    dealt = rows.mapInArrow(deal, "u int, v int, tile int, at bigint, size bigint, sketch binary")
    return dealt.groupBy("u", "v").applyInArrow(compare, "a bigint, b bigint")


def similar_roots(sets: list[np.ndarray], rule: Similarity) -> np.ndarray:
    """For each of some sets, of ascending sizes, the first that is reachable over exactly similar pairs."""
    size, root = np.array([len(s) for s in sets]), np.arange(len(sets))
    if len(sets) > 2:
        bits = sketch_bits(size[-1:])
        cuts = np.concatenate(([0], np.cumsum(size)))
        words = sketches(np.concatenate(sets), cuts, np.repeat(bits, len(sets)))[0].view(np.uint64).reshape(len(sets), -1)
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, int(np.searchsorted(size, int(size[i]) * rule.q // rule.p, "right")))
        rest = rest[root[rest] != root[i]]  # what is reached already needs no link
        step = max(1, GATHER_WORDS // words.shape[1]) if len(sets) > 2 else 1
        if len(sets) > 2 and len(rest):
            ok = [rule.may(np.bitwise_count(words[r] ^ words[i]).sum(axis=1, dtype=np.int64), size[r] + size[i]) for r in (rest[k : k + step] for k in range(0, len(rest), step))]
            rest = rest[np.concatenate(ok)]
        hits = [j for j in rest.tolist() if rule.holds(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), int(size[i] + size[j]))]
        if hits:
            root = link_roots(root, np.full(len(hits), i), np.array(hits))
    return root


def confirmed(nodes: DataFrame, rows: DataFrame, links: DataFrame, shingle: int, rule: Similarity) -> DataFrame:
    """(at, root) for the nodes of candidate components, root the node they reach over exactly similar pairs.

    One text of each set of a component comes to the component's group, and sets are made
    of it again. A component of more than ``GROUP_SHINGLES`` shingles is dealt into blocks,
    and each pair of its blocks is a group of its own, so a task holds about two blocks
    whatever the size of the component; the roots of the pairs are links between tasks.
    """
    parts = materialise(connected_components(links, "a", "b").select(F.col("node").alias("at"), F.col("root").alias("part")), "candidates")
    weights = parts.join(nodes.select("at", "size"), "at").groupBy("part").agg(F.sum("size").alias("weight"))
    total, most = weights.agg(F.sum("weight"), F.max("weight")).first()
    groups = F.pmod(F.xxhash64("part"), F.lit(max(1, -(-(total or 0) // GROUP_SHINGLES))))

    def decide(key, table):
        table = table.sort_by([("part", "ascending"), ("size", "ascending"), ("at", "ascending")])
        part, at = table.column("part").to_numpy(), table.column("at").to_numpy()
        sets = []
        for _, _, data, offsets in passes(table.column("text")):
            hashes, cuts = shingle_sets(data, offsets, shingle)
            sets += [hashes[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        root = np.arange(len(at))
        edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))).tolist()
        for a, b in zip(edges[:-1], edges[1:]):
            root[a:b] = a + similar_roots(sets[a:b], rule)
        return pa.table([pa.array(at), pa.array(at[root])], ["at", "root"])

    def decided(parts: DataFrame, *keys: str) -> DataFrame:
        return rows.select("at", "size", "text").join(parts, "at").groupBy(*keys).applyInArrow(decide, "at bigint, root bigint")

    if (most or 0) <= GROUP_SHINGLES:
        return decided(parts.withColumn("group", groups), "group")
    cut = parts.join(weights.select("part", F.ceil(F.col("weight") / GROUP_SHINGLES).alias("blocks")), "part")
    block = F.pmod(F.xxhash64("at"), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda b: b != block)
    pairs = cut.where("blocks > 1").select("at", "part", block.alias("block"), F.explode(others).alias("other"))
    pairs = pairs.select("at", "part", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"))
    light = decided(cut.where("blocks = 1").select("at", "part", groups.alias("group")), "group")
    return light.unionByName(connected_components(decided(pairs, "part", "u", "v"), "at", "root").withColumnRenamed("node", "at"))


def _firsts(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """set, first: of the component of a set, the row (none, id, at) that comes first by its id, null ids last, then by its number."""
    rule, spark = Similarity(similarity), rows.sparkSession
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at"))
    folder = scratch_dir(spark)
    with scratch_scope(spark):
        nodes = materialise(rows.where("size > 0").groupBy("set", "size", "sketch").agg(least.alias("least"), F.min("at").alias("at")), "nodes")
        roots = confirmed(nodes, rows, candidate_links(nodes, rule), shingle, rule)
        grouped = nodes.select("set", "at", "least").join(roots, "at", "left").select("set", "least", F.coalesce("root", "at").alias("root"))
        return materialise(grouped.join(grouped.groupBy("root").agg(F.min("least").alias("first")), "root").select("set", "first"), "firsts", folder)


def _numbered(sets: DataFrame) -> DataFrame:
    return materialise(sets.withColumn("at", F.monotonically_increasing_id()), "sets")


def similar_texts(df: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, component_id: the smallest id reachable over texts of that Jaccard similarity and more.

    Letters A-Z are lowered; words are ``[^\\x20\\x09-\\x0D]+``; a text is the set of its
    shingles of ``shingle`` words, a shorter text is one shingle. Texts with the same set
    are one node. A text without words has no shingle and links to none. Rows with a null
    id take part as links but never name a component unless all ids of it are null.
    Repeated rows give repeated results; an empty table gives none.
    """
    rows = _numbered(text_sets(df, shingle, id_col, text_col))
    found = rows.where("size > 0").select("id", "set").join(_firsts(rows, shingle, similarity), "set").select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))
    return found.unionByName(rows.where("size = 0").select(F.col("id").alias(id_col), F.col("id").alias("component_id")))


def one_of_each(df: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, whole, that remain when one row of each component of ``similar_texts`` stays.

    That with the smallest id stays, and of rows with equal ids any one; rows with a null
    id stay only where no other is in the component. It goes by rows, not by ids: of
    repeated rows one stays, and of rows that share an id but no component each may stay.
    Null texts and texts without words are in no component and all stay. An empty table
    gives none.
    """
    rows = _numbered(text_sets(df, shingle, id_col, text_col, tuple(c for c in df.columns if c not in (id_col, text_col))))
    stay = _firsts(rows, shingle, similarity).select(F.col("first.at").alias("at")).distinct()
    kept = rows.where("size > 0").join(stay, "at", "left_semi").unionByName(rows.where("size = 0").select(*["at", *[c for c in rows.columns if c != "at"]]))
    rest = [c for c in df.columns if c not in (id_col, text_col)]
    names = {id_col: "id", text_col: "text"} | {c: f"_k{i}" for i, c in enumerate(rest)}
    return kept.select(*[F.col(names[c]).alias(c) for c in df.columns])
