"""Byte-level BPE: boundaries by an associative scan over codepoint classes, cached pair merging, decoding by offsets.

Pre-tokenisation uses no regex. Every code point of a chunk of texts gets a symbol (letter, number, other, apostrophe
of a contraction, white space, with what follows it where that matters). A symbol is a function from automaton state to
automaton state; composition of functions is associative, so blocks of the chunk are composed side by side, a
prefix scan over blocks gives the state that each block begins in, and a last pass marks the boundaries. The first
symbol of a text maps every state alike, so texts lie end to end without running into each other.

The slices between boundaries are merged by rank; results are cached by slice within a worker, up to a bound. Token ids
of all texts of a chunk lie in one array, with the offset of each text; decoding gathers from one table of all tokens'
bytes, by these offsets.

Null and empty texts have no tokens. Every row gives one row; repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PieceCache, chunks

# Symbols
LETTER, NUMBER, OTHER, SHORT, LONG, GAP, BREAK, WHITE = range(8)
#: A symbol plus this is that symbol at the beginning of a text.
FIRST = 8
# States: what the last code point belongs to. JOIN: a space that the next code point joins; ALONE: white space that is
# a token by itself; ONE, TWO: so many letters of a contraction still to come; DONE: a contraction just ended.
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOIN, IN_WHITE, ALONE, ONE, TWO, DONE = range(10)
STATES = 10
#: Code points in a block of the scan.
SPAN = 512
#: Bytes that a worker's cache of slices may hold; with its objects it takes about five times that.
CACHE_BYTES = 10 << 20
#: Bytes of text that are encoded at once; the arrays on the way take about 50 times that.
TEXT_BYTES = 1 << 18


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """State after ``symbol``, and whether a token begins at it."""
    if state == TWO:
        return ONE, False
    if state == ONE:
        return DONE, False
    plain = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SHORT: IN_OTHERS, LONG: IN_OTHERS}
    if state == JOIN:
        return plain.get(symbol, BEGIN), False
    if symbol in (SHORT, LONG) and state != IN_OTHERS:
        return (ONE if symbol == SHORT else TWO), True
    if symbol in plain:
        return plain[symbol], plain[symbol] != state
    if symbol == WHITE:
        return IN_WHITE, state != IN_WHITE
    return (JOIN if symbol == GAP else ALONE), True


def _tables() -> tuple[np.ndarray, np.ndarray]:
    pairs = [_step(BEGIN if s >= FIRST else q, s % FIRST) for s in range(2 * FIRST) for q in range(STATES)]
    return np.array([p[0] for p in pairs], np.uint8), np.array([p[1] for p in pairs], bool)


NEXT, BEGINS = _tables()


@functools.cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    white = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[white] = WHITE
    return table


def symbols(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Symbol of each code point; texts begin at ``offsets`` (the last entry is the end)."""
    sym = classes()[points]
    n = len(points)
    first = offsets[:-1][offsets[:-1] < n]
    last = first[first > 0] - 1

    def shifted(a, k, fill):
        out = np.full(n, fill, a.dtype)
        out[: n - k] = a[k:]
        return out

    white = sym == WHITE
    ends = shifted(white, 1, True)
    ends[last] = True  # white space at a text's end is one run
    solid = white & ~ends
    out = sym.copy()
    out[solid] = np.where(points[solid] == 0x20, GAP, BREAK)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        stop = np.searchsorted(offsets, at, "right")
        end = offsets[stop]
        one = np.where(at + 1 < end, points[np.minimum(at + 1, n - 1)], 0)
        two = np.where(at + 2 < end, points[np.minimum(at + 2, n - 1)], 0)
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[at[pairs]] = LONG
    out[first] += FIRST
    return out


def boundaries(sym: np.ndarray) -> np.ndarray:
    """Positions where a token begins."""
    n = len(sym)
    blocks = -(-n // SPAN)
    grid = np.full(blocks * SPAN, FIRST, np.int32)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(blocks, SPAN).T) * STATES
    function = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for column in grid:
        function = NEXT[column[:, None] + function]
    shift = 1
    while shift < blocks:  # prefix scan: function of a block becomes that of all blocks up to it
        function[shift:] = np.take_along_axis(function[shift:], function[:-shift], 1)
        shift *= 2
    state = np.empty(blocks, np.uint8)
    state[0], state[1:] = BEGIN, function[:-1, BEGIN]
    marks = np.empty((SPAN, blocks), bool)
    for k, column in enumerate(grid):
        at = column + state
        marks[k] = BEGINS[at]
        state = NEXT[at]
    return np.flatnonzero(marks.T.reshape(-1)[:n])


class Slices(NamedTuple):
    data: bytes
    edges: np.ndarray  # byte positions of token slices, and the end
    bounds: np.ndarray  # slices of text i: bounds[i] to bounds[i + 1]


def pre_tokens(texts: list[str]) -> Slices:
    joined = "".join(texts)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    if not joined:
        return Slices(b"", np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64))
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    begins = boundaries(symbols(points, offsets))
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    places = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    return Slices(joined.encode(), places[np.append(begins, len(points))], np.searchsorted(begins, offsets))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one slice: the pair of lowest rank is merged first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 48:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here; 0 once it is merged into another
    before = list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n:
            r = ranks.get(piece[i : end[end[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not end[i] or end[i] >= n or end[end[i]] != stop or end[i] == stop:
            continue
        end[end[i]], end[i] = 0, stop
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one rank file, with a cache of slices."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.cache = PieceCache(CACHE_BYTES)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            tokens[i] = token
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offset of each text."""
        data, edges, bounds = pre_tokens(texts)
        at = edges.tolist()
        pieces = [data[a:b] for a, b in zip(at, at[1:])]
        held = self.cache.fill(set(pieces), lambda new: [np.array(merge(p, self.ranks), "<u4").tobytes() for p in new])
        coded = list(map(held.__getitem__, pieces))
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        return np.frombuffer(b"".join(coded), "<u4"), np.concatenate([[0], np.cumsum(sizes)])[bounds]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all texts end to end, and the offset of each text."""
        sizes = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.places[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.table[at].tobytes(), ends[offsets]


@functools.cache
def codec_of(path: str) -> Codec:
    """The worker's codec, which keeps its cache across tasks."""
    return Codec(path)


def round_trip(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row, and the ids themselves if asked for."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            for i, j in chunks(batch.column(1), TEXT_BYTES):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                flat, at = codec.encode(texts)
                back, where = codec.decode(flat, at)
                cuts, wheres, raw = (at * 4).tolist(), where.tolist(), flat.tobytes()
                out = [
                    batch.column(0).slice(i, j - i),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([sha(raw[a:b]) for a, b in zip(cuts, cuts[1:])], pa.string()),
                    pa.array([sha(back[a:b]) for a, b in zip(wheres, wheres[1:])], pa.string()),
                ]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])
                del texts, flat, back, raw, out
            del batch
            pa.default_memory_pool().release_unused()  # the worker lives on

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text of ``tokens`` (doc_id, ids). Null ids give an empty text; bytes that are not UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            back, where = codec.decode(np.concatenate([np.empty(0, np.int64), *lists]), at)
            texts = [back[a:b].decode("utf-8", "replace") for a, b in zip(where.tolist(), where.tolist()[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
