"""Token counts by finite-state transducers (operator 4).

Two deterministic machines are compiled from a word-level BPE file.

1. The splitter has seven states over ten character classes and marks where words start.
   Texts are cut into chunks; each chunk's state map (state before -> state after) is
   found for all start states at once, the maps are composed by a parallel prefix scan,
   and then every chunk emits its marks from its now known start state.

2. The counter reads the bytes of a word. A transition carries the change in the number
   of tokens of what has been read. It rests on a property of BPE: the last token of
   each prefix is the one suffix token that goes with the last token of the rest, where
   two tokens go together when their own concatenation encodes to just them. So a state
   needs only the longest suffix that can still grow into a token, the last token at each
   position of it, and counts relative to the newest. States are determinised when first
   met; beyond ``MAX_STATES`` a worker drops them and starts again. All words of a batch
   step through the table together.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docsmelt.llm import textscan as ts
from docsmelt.llm.bpe import _cut, byte_alphabet
from docsmelt.llm.common import passes

CHUNK = 64
MAX_STATES = 200_000
#: Words that are left in step k are stepped one by one when they are fewer.
FEW_WORDS = 48

# Character classes of the splitter: white space, letter, number, other, the quote, and
# the letters of the contractions 's 't 'm 'd 're 've 'll.
_SPACE, _LETTER, _NUMBER, _OTHER, _QUOTE, _SINGLE, _R, _V, _L, _E = range(10)
_LETTERS = (_LETTER, _SINGLE, _R, _V, _L, _E)
# States: free (whatever comes starts a word), in letters, in others, after a quote that
# starts a word, and after 'r, 'v or 'l where the next letter decides.
_FREE, _IN_LETTERS, _IN_OTHERS, _AFTER_QUOTE, _MAYBE_RE, _MAYBE_VE, _MAYBE_LL = range(7)
_HERE, _BEFORE = 1, 2  # marks: a word starts here, a word started one character before


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    go, mark = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)

    def set_(state, kinds, to, marks):
        for k in kinds:
            go[state, k], mark[state, k] = to, marks

    for state in (_FREE, _IN_LETTERS, _IN_OTHERS):
        set_(state, [_SPACE], _FREE, 0)
        set_(state, _LETTERS, _IN_LETTERS, 0 if state == _IN_LETTERS else _HERE)
        set_(state, [_NUMBER], _FREE, _HERE)
        set_(state, [_OTHER], _IN_OTHERS, 0 if state == _IN_OTHERS else _HERE)
        set_(state, [_QUOTE], _IN_OTHERS if state == _IN_OTHERS else _AFTER_QUOTE, 0 if state == _IN_OTHERS else _HERE)
    go[_AFTER_QUOTE], mark[_AFTER_QUOTE] = go[_IN_OTHERS], mark[_IN_OTHERS]
    set_(_AFTER_QUOTE, [_SINGLE], _FREE, 0)
    for kind, state, last in ((_R, _MAYBE_RE, _E), (_V, _MAYBE_VE, _E), (_L, _MAYBE_LL, _L)):
        set_(_AFTER_QUOTE, [kind], state, 0)
        go[state], mark[state] = go[_IN_LETTERS], mark[_IN_LETTERS] | _BEFORE
        set_(state, [last], _FREE, 0)
    return go, mark


_GO, _MARK = _splitter()


@lru_cache(1)
def _kinds() -> np.ndarray:
    base = ts.class_table()
    table = np.array([_LETTER, _NUMBER, _SPACE, _OTHER], np.uint8)[base]
    table[ord("'")] = _QUOTE
    for letters, kind in (("stmd", _SINGLE), ("r", _R), ("v", _V), ("l", _L), ("e", _E)):
        for c in letters:
            table[ord(c)] = kind
    return table


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps: row i becomes maps[i] after ... after maps[0]."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


def split_marks(kinds: np.ndarray) -> np.ndarray:
    """Where words start, for the classes of texts that each end in white space."""
    n = len(kinds)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, _SPACE, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    maps = np.tile(np.arange(7, dtype=np.uint8), (rows, 1)).T.copy()
    flat = _GO.ravel()
    for column in grid:
        maps = flat[maps * np.uint8(10) + column]
    state = np.zeros(rows, np.uint8)
    state[1:] = scan_maps(np.ascontiguousarray(maps.T).astype(np.intp))[:-1, _FREE]
    marks, out = np.empty((CHUNK, rows), np.uint8), _MARK.ravel()
    for k, column in enumerate(grid):
        at = state * np.uint8(10) + column
        marks[k] = out[at]
        state = flat[at]
    marks = np.ascontiguousarray(marks.T).ravel()[:n]
    start = (marks & _HERE).astype(bool)
    start[:-1] |= (marks[1:] & _BEFORE).astype(bool)
    return start


class WordCounter:
    """The counting transducer of one vocabulary file; one instance lives in each worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        suffix = model["end_of_word_suffix"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or not suffix:
            raise ValueError("a lower-casing vocabulary with word ends is needed")

        def symbols(token: str) -> tuple[bytes, bool]:
            last = token.endswith(suffix)
            return bytes(alphabet[c] for c in (token[: -len(suffix)] if last else token)), last

        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.token: dict[int, tuple[bytes, bool]] = {}
        for token, i in model["vocab"].items():
            if token in self.special:
                continue
            data, last = symbols(token)
            (self.final if last else self.inner)[data] = i
            self.token[i] = data, last
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[model["vocab"][a], model["vocab"][b]] = rank, model["vocab"][a + b]
        self.growing = {data[:k] for table in (self.inner, self.final) for data in table for k in range(1, len(data))}
        self.longest = max(map(len, (*self.inner, *self.final)))
        self.forget()

    def forget(self):
        self.fits: dict[tuple[int, int], bool] = {}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.column = np.full(512, -1, np.int64)
        self.columns = 0
        self.go = np.full((1024, 64), -1, np.int32)
        self.delta = np.zeros((1024, 64), np.int8)
        self.start = self._number((b"", (-1,), (0,)))

    def encode(self, symbols: list[int]) -> list[int]:
        """Plain BPE over symbol ids: the least rank merges first, leftmost first."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [self.merges[parts[i], parts[i + 1]][1]]
        return parts

    def _symbols(self, token: int) -> list[int]:
        data, last = self.token[token]
        out = [self.inner[data[i : i + 1]] for i in range(len(data))]
        if last:
            out[-1] = self.final[data[-1:]]
        return out

    def _fit(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: together they encode to just these two."""
        key = a, b
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self.encode(self._symbols(a) + self._symbols(b)) == [a, b]
        return known

    def _number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            if n >= len(self.go):
                more = len(self.go) // 4
                self.go = np.concatenate((self.go, np.full_like(self.go[:more], -1)))
                self.delta = np.concatenate((self.delta, np.zeros_like(self.delta[:more])))
        return n

    def _last(self, state: tuple, data: bytes, table: dict[bytes, int]) -> tuple[int, int]:
        """The last token once ``data`` (window and next byte) is read, and the count then."""
        _, last, counts = state
        n = len(data)
        for size in range(min(n, self.longest), 0, -1):
            token = table.get(data[n - size :])
            if token is not None:
                before = last[n - size]
                if before == -1 or self._fit(before, token):
                    return token, counts[n - size] + 1
        raise ValueError("a byte without a token of its own")

    def _transition(self, state: int, symbol: int) -> None:
        """Determinise one transition. Symbols are bytes, plus 256 for a word's last byte."""
        col = self.column[symbol]
        if col < 0:
            col = self.column[symbol] = self.columns
            self.columns += 1
            if col >= self.go.shape[1]:
                self.go = np.concatenate((self.go, np.full_like(self.go[:, :32], -1)), axis=1)
                self.delta = np.concatenate((self.delta, np.zeros_like(self.delta[:, :32])), axis=1)
        here = self.states[state]
        window, last, counts = here
        data = window + bytes([symbol & 255])
        if symbol >= 256:
            _, count = self._last(here, data, self.final)
            to = self.start
        else:
            token, count = self._last(here, data, self.inner)
            keep = 0
            while keep < len(data) and data[keep:] not in self.growing:
                keep += 1
            last, counts = (*last, token)[keep:], tuple(c - count for c in (*counts, count)[keep:])
            to = self._number((data[keep:], last, counts))
        self.go[state, col], self.delta[state, col] = to, count

    def count(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each word data[start : start + size]."""
        if len(self.states) > MAX_STATES:
            self.forget()
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        totals = np.zeros(len(order), np.int64)
        state = np.full(len(order), self.start, np.int64)
        active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1 if len(sizes) else 1), "right")
        for k, n in enumerate(active.tolist()):
            if n < FEW_WORDS:
                for w in range(n):
                    totals[w] += self._rest(state[w], data[starts[w] + k : starts[w] + sizes[w]].tobytes())
                break
            symbol = data[starts[:n] + k].astype(np.int64) + 256 * (sizes[:n] == k + 1)
            cols = self.column[symbol]
            to = np.where(cols < 0, -1, self.go[state[:n], cols])
            lost = np.flatnonzero(to < 0)
            if len(lost):
                for key in np.unique(state[lost] * 512 + symbol[lost]).tolist():
                    self._transition(key >> 9, key & 511)
                cols = self.column[symbol]
                to = self.go[state[:n], cols]
            totals[:n] += self.delta[state[:n], cols]
            state[:n] = to
        out = np.empty_like(totals)
        out[order] = totals
        return out

    def _rest(self, state: int, data: bytes) -> int:
        total = 0
        state = int(state)
        for k, byte in enumerate(data, 1):
            symbol = byte + 256 * (k == len(data))
            col = self.column[symbol]
            if col < 0 or self.go[state, col] < 0:
                self._transition(state, symbol)
                col = self.column[symbol]
            total += int(self.delta[state, col])
            state = int(self.go[state, col])
        return total

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; special strings count as one token each."""
        if any(s in t for s in self.special for t in texts):
            parts, owner, extra = [], [], []
            for k, text in enumerate(texts):
                for part, mark in _cut(text, self.special):
                    parts.append(part)
                    owner.append(k)
                    extra.append(mark >= 0)
            found = self._count(parts) + np.array(extra, np.int64)
            return np.bincount(np.array(owner), weights=found, minlength=len(texts)).astype(np.int64)
        return self._count(texts)

    def _count(self, texts: list[str]) -> np.ndarray:
        texts = [normalised(t) for t in texts]
        big = " ".join([*texts, ""])
        if not big:
            return np.zeros(len(texts), np.int64)
        points = np.frombuffer(big.encode("utf-32-le"), np.uint32)
        kinds = _kinds()[points]
        starts = split_marks(kinds)
        edges = np.flatnonzero(starts | (kinds == _SPACE))
        words = np.flatnonzero(starts[edges])
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.concatenate(([0], np.cumsum(width)))
        begin, end = at[edges[words]], at[edges[words + 1]]
        tokens = self.count(np.frombuffer(big.encode(), np.uint8), begin, end - begin)
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        upto = np.concatenate(([0], np.cumsum(tokens)))[np.searchsorted(edges[words], stops)]
        return np.diff(upto, prepend=0)


def normalised(text: str) -> str:
    """NFC, then lower case letter by letter (so the sigma at a word's end is plain)."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


@lru_cache(4)
def word_counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(df: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts, without special tokens at either end.

    Returns ``id_col``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row
    for each input row, null ids and repeated rows included. A null or empty text has 0
    bytes and 0 tokens. Other columns play no part, whatever their names. No shuffle;
    memory is bound by the passes over a batch, the longest text and ``MAX_STATES``.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        counter = word_counter(vocabulary)
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(1)):
                raw, cut = data.tobytes(), offsets.tolist()
                n = counter.count_texts([raw[a:b].decode() for a, b in zip(cut, cut[1:])])
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "over_limit"])

    schema = f"id {dict(rows.dtypes)['id']}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
