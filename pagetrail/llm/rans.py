"""Token-id files coded by a static range asymmetric numeral system.

Texts are tokenised once and written; one shared frequency table is counted over all ids and scaled to ``2^BITS``.
Documents are dealt out in ranges of doc_id (shards), sorted, and packed into blocks of whole documents. A block is
coded by ``LANES`` interleaved states, independently of every other. It keeps the states and the place in the stream
of every ``STEPS`` steps (checkpoints) and a checksum for each such segment, so that decoding may begin at any segment;
the decoder here runs all segments of a block side by side and raises on a checksum that does not hold.

A file is Parquet rows of blocks: shard, block, ids before the block in its shard, doc_ids, lengths, n_ids, and the
binary parts ``states`` (LANES little-endian 64-bit numbers for each segment), ``at`` (64-bit place of each segment),
``stream`` (32-bit words) and ``crcs`` (32-bit checksums of segments). The table is written beside them (id, freq).

Null and empty texts have the end id alone. Rows with equal doc_id lie side by side in order of their ids; a null
doc_id comes first. An empty table gives no blocks and no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, chunks, flat, new_path, slice_hash, words
from .vocabulary import word_bpe

BITS = 18
LANES = 1024
STEPS = 128
#: A block is closed by the document that brings it to so many ids.
BLOCK_IDS = 2 * LANES * STEPS
LOW = U64(1 << 31)
END_ID = 1
#: Bytes of text whose words are tokenised together, each different one once.
TEXT_BYTES = 8 << 20


def encode_texts(column: pa.Array, path: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the offset of each text, by way of their words: this kind of tokenizer drops white
    space and merges nothing across it, so a text's ids are those of its words between ASCII white space.

    Equal words are found by hash and tokenised once, and their ids dealt out to where they stand. All bytes are compared
    with those of the word that stands for them; should a hash be shared, every word is tokenised by itself."""
    text = flat(column)
    starts, ends, bounds = words(text)
    _, first, same = np.unique(slice_hash(text.data, starts, ends), return_index=True, return_inverse=True)
    lengths = ends - starts
    if not _equal(text.data, starts, lengths, starts[first][same], lengths[first][same]):
        first = same = np.arange(len(starts))
    raw = text.data.tobytes()
    coded = word_bpe(path).encode([raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())], dtype)
    ids = np.frombuffer(b"".join(coded), dtype)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // np.dtype(dtype).itemsize
    places, sizes = (np.cumsum(sizes) - sizes)[same], sizes[same]
    return ids[_runs(places, sizes)], np.concatenate([[0], np.cumsum(sizes)])[bounds]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them, end to end."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(len(at))
    return at


def _equal(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, others: np.ndarray, other_lengths: np.ndarray) -> bool:
    if not np.array_equal(lengths, other_lengths):
        return False
    step = 1 << 16  # slices at once, which bounds the arrays of positions
    parts = ((starts[k : k + step], lengths[k : k + step], others[k : k + step]) for k in range(0, len(starts), step))
    return all(np.array_equal(data[_runs(a, n)], data[_runs(b, n)]) for a, n, b in parts)


def tokenize(docs: DataFrame, path: str, dtype: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (as ``dtype``, with the end id) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, width = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        for batch in batches:
            for i, j in chunks(batch.column(1), TEXT_BYTES):
                ids, at = encode_texts(batch.column(1).slice(i, j - i), path, dtype)
                raw, cuts = ids.tobytes(), (at * width).tolist()
                made = pa.array([raw[a:b] + end for a, b in zip(cuts, cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), made], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def count_ids(tokens: DataFrame, dtype: str) -> DataFrame:
    """id, n over all of ``tokens``; each task sends one row for an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                part = np.bincount(np.frombuffer(raw, dtype))
                if len(part) > len(total):
                    total = np.pad(total, (0, len(part) - len(total)))
                total[: len(part)] += part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def scale(counts: dict[int, int], bits: int = BITS) -> dict[int, int]:
    """Frequencies that sum to 2^bits, at least 1 each, near the shares of ``counts``."""
    if not counts:
        return {}
    ids = np.array(sorted(counts))
    n = np.array([counts[i] for i in ids.tolist()], np.float64)
    if len(ids) > 1 << bits:
        raise ValueError(f"{len(ids)} distinct ids do not fit a table of {bits} bits")
    freq = np.maximum(1, np.floor(n / n.sum() * (1 << bits))).astype(np.int64)
    order = np.argsort(-n, kind="stable")
    over = int(freq.sum()) - (1 << bits)
    k = 0
    while over:  # what rounding left goes to or comes from the most frequent ids
        i = order[k % len(order)]
        step = -over if over < 0 else min(over, max(0, int(freq[i]) // 2))
        freq[i] += step if over < 0 else -step
        over += step if over < 0 else -step
        k += 1
    return dict(zip(ids.tolist(), freq.tolist()))


class Table:
    def __init__(self, freq: dict[int, int], bits: int = BITS):
        self.bits, self.ids = bits, np.array(sorted(freq), np.uint32)
        share = np.array([freq[i] for i in self.ids.tolist()], U64)
        size = int(self.ids[-1]) + 1 if len(self.ids) else 0
        self.freq, self.base = np.zeros(size, U64), np.zeros(size, U64)
        self.freq[self.ids] = share
        self.base[self.ids] = np.cumsum(share) - share
        self.slots = np.repeat(self.ids, share.astype(np.int64))
        self.filler = int(self.ids[np.argmax(share)]) if len(self.ids) else 0

    def encode(self, ids: np.ndarray) -> dict:
        steps = max(1, -(-len(ids) // LANES))
        grid = np.full(steps * LANES, self.filler, np.uint32)
        grid[: len(ids)] = ids
        grid = grid.reshape(steps, LANES)
        freq, base = self.freq, self.base
        x, out, states, marks, words = np.full(LANES, LOW, U64), [], [], [], 0
        limit, bits = U64(63 - self.bits), U64(self.bits)
        for step in range(steps - 1, -1, -1):
            f = freq[grid[step]]
            full = x >= f << limit
            if full.any():
                low = (x[full] & U64(0xFFFFFFFF)).astype("<u4")
                out.append(low)
                words += len(low)
                x[full] >>= U64(32)
            share = x // f
            x = (share << bits) + (x - share * f) + base[grid[step]]
            if step % STEPS == 0:
                states.append(x.copy())
                marks.append(words)
        crcs = [zlib.crc32(np.ascontiguousarray(grid[k : k + STEPS], "<u4")) for k in range(0, steps, STEPS)]
        return {
            "n_ids": len(ids),
            "states": np.array(states[::-1], "<u8").tobytes(),
            "at": (words - np.array(marks[::-1], "<i8")).tobytes(),
            "stream": np.concatenate([np.empty(0, "<u4"), *out[::-1]]).astype("<u4").tobytes(),
            "crcs": np.array(crcs, "<u4").tobytes(),
        }

    def decode(self, block: dict) -> np.ndarray:
        at = np.frombuffer(block["at"], "<i8").copy()
        x = np.frombuffer(block["states"], "<u8").reshape(len(at), LANES).astype(U64)
        stream = np.frombuffer(block["stream"], "<u4")
        steps = max(1, -(-block["n_ids"] // LANES))
        out = np.empty((len(at), STEPS, LANES), np.uint32)
        mask, bits = U64((1 << self.bits) - 1), U64(self.bits)
        for step in range(STEPS):
            live = -(-(steps - step) // STEPS) if step < steps else 0  # the last segment may be shorter
            if live <= 0:
                break
            own = x[:live]
            slot = own & mask
            found = self.slots[slot]
            out[:live, step] = found
            own = self.freq[found] * (own >> bits) + slot - self.base[found]
            short = own < LOW
            place = at[:live, None] + np.cumsum(short, 1) - 1
            own[short] = (own[short] << U64(32)) | stream[place[short]].astype(U64)
            at[:live] += short.sum(1)
            x[:live] = own
        for k, crc in enumerate(np.frombuffer(block["crcs"], "<u4").tolist()):
            rows = min(STEPS, steps - k * STEPS)
            if zlib.crc32(np.ascontiguousarray(out[k, :rows], "<u4")) != crc:
                raise ValueError(f"segment {k} of block {block.get('block')} does not match its checksum")
        return out.reshape(-1)[: block["n_ids"]]


BLOCKS = (
    "shard int, block int, before long, doc_ids array<long>, lengths array<long>, n_ids long, "
    "states binary, at binary, stream binary, crcs binary"
)
NAMES = [field.split()[0] for field in BLOCKS.split(", ")]


def write(tokens: DataFrame, freq: dict[int, int], path: str, dtype: str) -> None:
    """Codes ``tokens`` (doc_id, ids) in ascending order of doc_id into ``path``/blocks, and the table into ``path``/table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shard = Table(freq), TaskContext.get().partitionId()
        docs, parts, size, before, number = [], [], 0, 0, 0
        width = np.dtype(dtype).itemsize

        def close() -> pa.RecordBatch:
            coded = table.encode(np.frombuffer(b"".join(parts), dtype))
            row = {"shard": shard, "block": number, "before": before, "doc_ids": docs, "lengths": [len(p) // width for p in parts]}
            row |= coded
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in zip(NAMES, types)], NAMES)

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc)
                parts.append(raw)
                size += len(raw) // width
                if size >= BLOCK_IDS:
                    yield close()
                    docs, parts, before, number, size = [], [], before + size, number + 1, 0
        if parts:
            yield close()

    spark = tokens.sparkSession
    dealt = tokens.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions("doc_id", "ids")
    dealt.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    spark.createDataFrame(sorted(freq.items()), "id long, freq long").coalesce(1).write.parquet(f"{path}/table")


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in the files of ``path``, and their ids if asked for."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    freq = {r.id: r.freq for r in spark.read.parquet(f"{path}/table").collect()}  # at most 2^BITS rows
    # one row for a shard, so few that they fit one task
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    first, total = {}, 0
    for r in sorted(sizes, key=lambda r: r.shard):
        first[r.shard], total = total, total + r.n
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in NAMES}
                flat = table.decode(row).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(row["lengths"], dtype=np.int64)])
                cuts = ends.tolist()
                out = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(first[row["shard"]] + row["before"] + ends[:-1], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(flat[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64()),
                ]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return blocks.mapInArrow(run, schema)


def write_documents(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> str:
    """Tokenises ``docs`` (doc_id, text), counts the table over all ids, writes the files; their folder. Runs jobs."""
    path = path or new_path(docs)
    dtype = "<u2" if word_bpe(tokenizer_path).size <= 1 << 16 else "<u4"
    tokenize(docs, tokenizer_path, dtype).write.parquet(f"{path}/tokens")
    tokens = docs.sparkSession.read.schema("doc_id long, ids binary").parquet(f"{path}/tokens")
    counts = {r.id: r.n for r in count_ids(tokens, dtype).collect()}  # bounded by the vocabulary
    write(tokens, scale(counts), path, dtype)
    return path
