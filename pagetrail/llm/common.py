"""Shared helpers: cut points, chunks of a text column, words and their hashes as flat arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import scratch_dir

#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
#: Bytes whose rolling hash is computed at once; longer words are taken whole.
BLOCK = 1 << 17

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def new_path(df_or_spark) -> str:
    """A fresh path in the shared folder of the session."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return f"{scratch_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back. Runs a job; a lost executor costs nothing before it."""
    path = new_path(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text; every row is in one, an empty column gives none."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths) - lengths) // size
    edges = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(lengths)]) if len(lengths) else ()


class Flat(NamedTuple):
    """Texts end to end: bytes, and where each one begins (one entry more than texts)."""

    data: np.ndarray
    offsets: np.ndarray


def flat(column: pa.Array) -> Flat:
    """The UTF-8 bytes of a string column; nulls are empty."""
    col = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.empty(0, np.uint8)
    return Flat(raw, at - at[0])


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags, false in the closed ranges."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Words between ASCII white space.
NOT_SPACE = byte_set((0x09, 0x0D), (0x20, 0x20))
#: Words of ASCII letters, digits and everything beyond ASCII.
ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words(NamedTuple):
    """Byte positions of words; words of text i are bounds[i] to bounds[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def words(text: Flat, table: np.ndarray = NOT_SPACE) -> Words:
    data, offsets = text
    inside = table[data]
    if not len(inside):
        none = np.empty(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64))
    cuts = offsets[:-1][offsets[:-1] < len(inside)]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return Words(starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


_POWERS = {base: _powers(base, 2 * BLOCK) for base in (_BASE, _INVERSE)}


def powers(base: int, n: int) -> np.ndarray:
    kept = _POWERS[base]
    return kept[:n] if n <= len(kept) else _powers(base, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slice_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice of ``data``; starts ascend. Equal bytes, equal hash."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        low, high = int(starts[i]), int(ends[i:j].max())
        sums = np.zeros(high - low + 1, U64)
        np.cumsum((data[low:high].astype(U64) + U64(1)) * powers(_BASE, high - low), out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * powers(_INVERSE, high - low + 1)[a]
        i = j
    return mix(out + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def texts_of(folder: str) -> str:
    return f"{folder}/documents.parquet"


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts of at most ``per_class`` labelled ids of either label among those that ``keep`` (of doc_id) lets in:
    text, label; and how many labelled ids either label has. The ids are those of lowest hash, so a retry, or another
    partitioning, takes the same ones. Null labels and ids are left out, and so is an id that has both labels; of several
    texts of an id the one that sorts first is taken. Only the ids, at most ``2 * per_class``, are broadcast.
    """
    from pyspark.sql import functions as F

    rows = labels.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("label").isin(0, 1) & F.col("labelled_id").isNotNull() & keep(F.col("labelled_id")))
    known = rows.groupBy("labelled_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    known = known.where(F.col("label") == F.col("other")).drop("other")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = (F.xxhash64("labelled_id"), F.col("labelled_id"))
    picked = [r for k in (0, 1) for r in known.where(F.col("label") == k).orderBy(*order).limit(per_class).collect()]
    chosen = docs.sparkSession.createDataFrame(picked, "labelled_id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("id") == F.col("labelled_id"))
    return joined.groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label"), sizes


def remainder(doc_id, divisor: int):
    """crc32 of doc_id as text, modulo ``divisor``; null stays null."""
    from pyspark.sql import functions as F

    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


class PieceCache:
    """Piece -> encoded bytes, kept by a worker across its tasks. Holds at most about ``limit`` bytes of both (several
    times that in memory): when the young half is full, it becomes the old half, and what is asked for moves back."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old, self.held = limit, {}, {}, 0

    def fill(self, pieces: set, make) -> dict:
        """A dict that has all ``pieces``; ``make`` encodes a list of those that are missing."""
        missing = pieces.difference(self.young)
        if missing and self.held > self.limit // 2:
            self.old, self.young, self.held = self.young, {}, 0
            missing = pieces
        new = [p for p in missing if p not in self.old]
        for p in missing:
            if p in self.old:
                self.young[p] = self.old[p]
                self.held += len(p) + len(self.old[p])
        for p, coded in zip(new, make(new) if new else ()):
            self.young[p] = coded
            self.held += len(p) + len(coded)
        return self.young
