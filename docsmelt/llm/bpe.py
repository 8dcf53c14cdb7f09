"""Byte-level BPE: vectorised splitting into short words, rank-array merging, decoding.

A tokenizer file in the ``tokenizers`` JSON format (byte-level, no normalizer) is read
from a path that is a parameter. Texts are split with numpy over whole batches; each
distinct word of a batch is looked up once by a 64-bit key (hash and length) and merged
only when the worker has not met it before.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np

from docsmelt.llm import textscan as ts
from docsmelt.llm.common import gather_ranges

#: Words up to this many bytes are merged by scanning the rank array, longer ones by a heap.
SHORT_WORD = 96
#: Words kept by a worker before it forgets them all and starts again.
CACHE_WORDS = 600_000

NO_RANK = np.iinfo(np.int32).max


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return table | {chr(256 + k): b for k, b in enumerate(rest)}


class PairTable:
    """Pairs of ids and the id they merge to, for lookups of whole arrays.

    Two open tables under different multipliers: a pair that finds its slot of the
    first taken lies in the second, whose multiplier is chosen free of clashes.
    """

    _BITS = 20

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.tables = []
        for level in range(8):
            multiplier = np.uint64(0x9E3779B97F4A7C15 + 0x1000193 * 2 * level)
            slot = (keys * multiplier) >> np.uint64(64 - self._BITS)
            _, first = np.unique(slot, return_index=True)
            held, value = np.full(1 << self._BITS, (1 << 64) - 1, np.uint64), np.full(1 << self._BITS, NO_RANK, np.int32)
            held[slot[first]], value[slot[first]] = keys[first], merged[first]
            self.tables.append((multiplier, held, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, merged = keys[rest], merged[rest]
            if not len(keys):
                return
        raise ValueError("pairs do not fit the tables")

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NO_RANK where a pair does not merge. Ids rise with merge order, so they serve as ranks."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(keys.shape, NO_RANK, np.int32)
        for multiplier, held, value in self.tables:
            slot = (keys * multiplier) >> np.uint64(64 - self._BITS)
            np.copyto(out, value[slot], where=held[slot] == keys)
        return out


def merge_rank_arrays(parts: np.ndarray, pairs: PairTable):
    """Merge many words of equal length, one per row of byte ids, at once.

    Each row has a contiguous array of parts and one of the ranks of adjacent parts. A
    round finds every row's least rank (leftmost first), deletes that boundary and
    refreshes the two neighbouring ranks; rows without a rank are done and leave.
    Yields (row numbers, their ids as a matrix).
    """
    rows = np.arange(len(parts))
    ranks = pairs.find(parts[:, :-1], parts[:, 1:])
    while len(rows):
        if not ranks.shape[1]:
            yield rows, parts
            return
        at = ranks.argmin(axis=1)
        each = np.arange(len(rows))
        least = ranks[each, at]
        done = least == NO_RANK
        if done.any():
            yield rows[done], parts[done]
            go = ~done
            rows, parts, ranks, at, least = rows[go], parts[go], ranks[go], at[go], least[go]
            each = np.arange(len(rows))
            if not len(rows):
                return
        parts[each, at] = least
        keep = np.ones(parts.shape, bool)
        keep[each, at + 1] = False
        parts = parts[keep].reshape(len(rows), -1)
        ranks = ranks[keep[:, 1:]].reshape(len(rows), -1)
        width = ranks.shape[1]
        if not width:
            continue
        r = np.flatnonzero(at < width)
        ranks[r, at[r]] = pairs.find(parts[r, at[r]], parts[r, at[r] + 1])
        r = np.flatnonzero(at > 0)
        ranks[r, at[r] - 1] = pairs.find(parts[r, at[r] - 1], parts[r, at[r]])


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word in n log n: a heap of joins over linked parts."""
    n = len(word)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], nxt[i] = 0, stop, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prv[i] >= 0 and (r := ranks.get(word[prv[i] : stop])) is not None:
            heapq.heappush(heap, (r, prv[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


class ByteBpe:
    """Encoder and decoder of one vocabulary file; one instance lives in each worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level vocabulary without normalizer is needed")
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = [vocab[bytes(alphabet[c] for c in a + b)] for a, b in pairs]
        if any(b <= a for a, b in zip(order, order[1:])):
            raise ValueError("ids must rise in the order of the merges")
        self.ranks = vocab
        single = np.array([vocab[bytes([b])] for b in range(256)], np.int32)
        self.single = single
        left = [vocab[bytes(alphabet[c] for c in a)] for a, _ in pairs]
        right = [vocab[bytes(alphabet[c] for c in b)] for _, b in pairs]
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(order, np.int32))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = token
        for content, i in self.special.items():
            self.pieces[i] = content.encode()
        self.forget()

    def forget(self):
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted keys and their words' slots
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = self.count = 0
        self.begins, self.sizes = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Merge new words and keep their ids; returns their slots."""
        first, n = self.count, len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        counts = np.zeros(n, np.int64)
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        blocks = []
        for group in np.split(order, cuts) if n else []:
            size = int(sizes[group[0]])
            if size > SHORT_WORD:
                for w in group.tolist():
                    blocks.append((np.array([w]), np.array([merge_long(words[w], self.ranks)], np.int32)))
                continue
            raw = np.frombuffer(b"".join(words[w] for w in group.tolist()), np.uint8).reshape(len(group), size)
            for rows, ids in merge_rank_arrays(self.single[raw], self.pairs):
                blocks.append((group[rows], ids))
        for rows, ids in blocks:
            counts[rows] = ids.shape[1]
        begins = self.used + np.concatenate(([0], np.cumsum(counts)[:-1])) if n else counts
        total = int(counts.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while first + n > len(self.begins):
            self.begins = np.concatenate((self.begins, np.zeros_like(self.begins)))
            self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
        for rows, ids in blocks:
            self.pool[begins[rows][:, None] + np.arange(ids.shape[1])] = ids
        self.begins[first : first + n], self.sizes[first : first + n] = begins, counts
        self.used += total
        self.count += n
        return np.arange(first, first + n)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the offsets of each text's ids."""
        if not any(s in t for s in self.special for t in texts):
            return self._encode(texts)
        parts, owner, marks = [], [], []
        for k, text in enumerate(texts):
            for part, mark in _cut(text, self.special):
                parts.append(part)
                owner.append(k)
                marks.append(mark)
        ids, offsets = self._encode(parts)
        marks = np.array(marks, np.int64)
        has = marks >= 0
        ids = np.insert(ids, offsets[1:][has], marks[has].astype(np.uint32))
        sizes = np.diff(offsets) + has
        per_text = np.bincount(np.array(owner, np.int64), weights=sizes, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_text)))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        big = "\0".join([*texts, ""])
        points = np.frombuffer(big.encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        starts = np.flatnonzero(word_starts(points, stops))
        ends = np.append(starts[1:], len(points))
        keep = np.ones(len(starts), bool)
        keep[np.searchsorted(starts, stops)] = False
        word_first = np.concatenate(([0], np.cumsum(keep)[np.searchsorted(starts, stops)]))
        starts, ends = starts[keep], ends[keep]
        keys = ts.span_hash(ts.prefix_sums(ts.mix(points.astype(np.uint64) + np.uint64(1))), starts, ends)
        distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > CACHE_WORDS:
            self.forget()
        at_key = np.searchsorted(self.keys, distinct)
        hit = np.zeros(len(distinct), bool)
        inside = np.flatnonzero(at_key < len(self.keys))
        hit[inside] = self.keys[at_key[inside]] == distinct[inside]
        slots = np.empty(len(distinct), np.int32)
        slots[hit] = self.slots[at_key[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            a, b = starts[at[new]].tolist(), ends[at[new]].tolist()
            slots[new] = self._learn([big[i:j].encode() for i, j in zip(a, b)])
            self.keys = np.insert(self.keys, at_key[new], distinct[new])
            self.slots = np.insert(self.slots, at_key[new], slots[new])
        sizes = self.sizes[slots][back].astype(np.int64)
        ids = self.pool[gather_ranges(self.begins[slots][back].astype(np.int64), sizes)]
        return ids, np.concatenate(([0], np.cumsum(sizes)))[word_first]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, malformed UTF-8 replaced as the library does."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _cut(text: str, special: dict[str, int]):
    """Text between special strings and the id of the one that ends it, or -1; one pass, of strings that begin together the longest wins."""
    at = 0
    for found in _special_pattern(tuple(special)).finditer(text) if special else ():
        yield text[at : found.start()], special[found[0]]
        at = found.end()
    yield text[at:], -1


@lru_cache(16)
def _special_pattern(special: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)))


def word_starts(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where the byte-level pattern starts a word; ``stops`` are positions between texts.

    The pattern: contractions 's 't 're 've 'm 'll 'd; runs of letters, numbers or other
    characters, each with one blank before it; white space, whose last character before
    a word stands alone or joins the word.
    """
    kind = ts.class_table()[points]
    kind[stops] = ts.END
    n = len(points)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = ts.END, kind[:-1]
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = ts.END, kind[1:]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (points[:-1] == 0x20) & (kind[:-1] == ts.SPACE)
    in_space = kind == ts.SPACE
    start = np.where(in_space, (before != ts.SPACE) | (after < ts.SPACE) | (after == ts.OTHER), (kind != before) & ~blank_before)
    start[stops] = True
    quote = np.flatnonzero((points == 0x27) & start & (after == ts.LETTER) & (kind == ts.OTHER))
    if len(quote):
        one = points[quote + 1]
        two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        for which, length in ((short, 2), (long, 3)):
            q = quote[which]
            start[q + 1] = False
            q = q + length
            q = q[q < n]
            start[q[kind[q] == ts.LETTER]] = True
    return start


@lru_cache(4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
