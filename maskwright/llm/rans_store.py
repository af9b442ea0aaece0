"""Token ids in files coded with a static range asymmetric numeral system.

A file holds the ids of consecutive documents and one frequency table, shared
by its blocks. A block holds whole documents, is coded on its own with
interleaved lanes (id i of a block belongs to lane i mod lanes), and carries
checkpoints (lane states and place in the stream at regular steps), from which
parts of a block can be decoded in parallel, and checksums of its bytes and of
its ids. Files are rows of a Parquet table in the shared folder, so Spark's
writers commit them, and a task that is lost is done again.

Block, little-endian: magic `MWR2`, crc32 of all that follows, crc32 of the
ids, documents u32, ids u64, lanes u32, steps u32, steps between checkpoints
u32, sizes of the parts u32 x 3; then document ids and lengths (deflated),
checkpoints (place u32 each, then states u64), and the stream of u32 words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_ids import tokenizer
from .common import arrow_batches, columns_only, slices, stored

MAGIC = b"MWR2"
HEAD = struct.Struct("<4sIIIQIIIIII")
#: Frequencies sum to 2 ** SCALE, or to the next power that gives every id of a file two parts.
SCALE = 20
ONE, LOWEST = np.uint64(1), np.uint64(1 << 31)
BLOCK_IDS, FILE_IDS = 1 << 18, 1 << 22
LANES, EVERY = 512, 128
#: Vocabularies of more ids are searched, smaller ones indexed.
WIDE = 1 << 22
END_ID = 2
NULL_ID = np.iinfo(np.int64).min
FILES = "part int, seq int, start bigint, n_ids bigint, n_docs bigint, freqs binary, blocks array<binary>"


class Frequencies:
    """Frequencies of ids, scaled to sum to 2 ** scale."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq.astype(np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.scale = int(self.freq.sum()).bit_length() - 1

    @classmethod
    def of(cls, ids: np.ndarray) -> "Frequencies":
        if ids.max() < WIDE:
            count = np.bincount(ids)
            symbols = np.flatnonzero(count)
            n = count[symbols]
        else:
            symbols, n = np.unique(ids, return_counts=True)
        scale = max(SCALE, (2 * len(symbols) - 1).bit_length())
        freq = np.maximum(1, np.floor(n * ((1 << scale) / n.sum())).astype(np.int64))
        over = int(freq.sum()) - (1 << scale)
        order = np.argsort(-freq, kind="stable")
        if over < 0:
            freq[order[0]] -= over
        for i in order:  # frequencies of 1 that stand for less are paid by the most frequent
            if over <= 0:
                break
            take = min(over, int(freq[i]) // 2)
            freq[i] -= take
            over -= take
        return cls(symbols.astype(np.int64), freq)

    def packed(self) -> bytes:
        return zlib.compress(np.diff(self.symbols, prepend=0).astype("<u4").tobytes() + self.freq.astype("<u4").tobytes(), 6)

    @classmethod
    def unpacked(cls, raw: bytes) -> "Frequencies":
        a, b = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64).reshape(2, -1)
        return cls(np.cumsum(a), b)

    def coded(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.symbols, ids) if self.symbols[-1] >= WIDE else self._places()[ids]

    def _places(self) -> np.ndarray:
        place = np.zeros(int(self.symbols[-1]) + 1, np.int64)
        place[self.symbols] = np.arange(len(self.symbols))
        return place

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freq.astype(np.int64))


def encode_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, table: Frequencies) -> bytes:
    n = len(ids)
    lanes = 1
    while lanes < LANES and lanes * 128 <= n:
        lanes *= 2
    steps = -(-n // lanes)
    code = np.zeros(steps * lanes, np.int64)
    code[:n] = table.coded(ids)
    code = code.reshape(steps, lanes)
    freq, cum = table.freq[code], table.cum[code]
    limit = freq << np.uint64(63 - table.scale)
    x = np.full(lanes, LOWEST)
    words: list[np.ndarray] = []
    states: list[np.ndarray] = []
    written: list[int] = []
    size = 0
    for t in range(steps - 1, -1, -1):  # the last id goes in first, and so comes out last
        f = freq[t]
        full = x >= limit[t]
        if full.any():
            words.append(x[full].astype("<u4"))
            size += len(words[-1])
            x[full] >>= np.uint64(32)
        q = x // f
        x = (q << np.uint64(table.scale)) + (x - q * f) + cum[t]
        if t % EVERY == 0:
            states.append(x.copy())
            written.append(size)
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    places = np.array([size - w for w in written[::-1]], "<u4")
    points = places.tobytes() + b"".join(s.astype("<u8").tobytes() for s in states[::-1])
    index = zlib.compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<u4").tobytes(), 6)
    body = index + points + stream.tobytes()
    ids_crc = zlib.crc32(ids.astype("<u4").tobytes())
    rest = HEAD.pack(MAGIC, 0, ids_crc, len(doc_ids), n, lanes, steps, EVERY, len(index), len(points), len(stream))[8:] + body
    return MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest


class Block:
    """A block, checked and opened."""

    def __init__(self, raw: bytes, table: Frequencies, slots: np.ndarray | None = None):
        magic, crc, self.ids_crc, docs, self.n, self.lanes, self.steps, self.every, a, b, c = HEAD.unpack_from(raw)
        if magic != MAGIC or zlib.crc32(raw[8:]) != crc:
            raise ValueError("a block of token ids is damaged")
        self.table, self.slot = table, table.slots() if slots is None else slots
        at = HEAD.size
        index = zlib.decompress(raw[at : at + a])
        self.doc_ids, self.lengths = np.frombuffer(index[: 8 * docs], "<i8"), np.frombuffer(index[8 * docs :], "<u4").astype(np.int64)
        points = -(-self.steps // self.every)
        self.places = np.frombuffer(raw, "<u4", points, at + a)
        self.states = np.frombuffer(raw, "<u8", points * self.lanes, at + a + 4 * points).reshape(points, -1)
        self.words = np.frombuffer(raw, "<u4", c, at + a + b).astype(np.uint64)

    def part(self, point: int) -> np.ndarray:
        """The ids from a checkpoint to the next; parts can be decoded in any order."""
        table, x, at = self.table, self.states[point].copy(), int(self.places[point])
        mask, down, up = np.uint64((1 << table.scale) - 1), np.uint64(table.scale), np.uint64(32)
        steps = min(self.every, self.steps - point * self.every)
        out = np.empty((steps, self.lanes), np.int32)
        for t in range(steps):
            low = x & mask
            s = self.slot[low]
            out[t] = s
            x = table.freq[s] * (x >> down) + low - table.cum[s]
            empty = x < LOWEST
            n = int(np.count_nonzero(empty))
            if n:
                x[empty] = (x[empty] << up) | self.words[at : at + n]
                at += n
        return table.symbols[out.ravel()[: self.n - point * self.every * self.lanes]]

    def ids(self) -> np.ndarray:
        got = np.concatenate([self.part(i) for i in range(len(self.places))]) if self.n else np.zeros(0, np.int64)
        if zlib.crc32(got.astype("<u4").tobytes()) != self.ids_crc:
            raise ValueError("a block of token ids doesn't decode to what was written")
        return got


def write_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Encode whole texts in ascending order of id (equal ids by text) and write the files; gives the table of files as read
    back: part and seq (their order), start (ids before it in the part), n_ids, n_docs, freqs, blocks.

    Defined results: a null text is empty, so only end_id is written; a null id sorts first and is kept; repeated rows are
    documents of their own; an empty table has no files; further columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = columns_only(docs, **{id_col: "bigint", text_col: "string"}).toDF("doc_id", "text")
    dealt = src.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for b in slices(batches, "text"):
            null = np.asarray(b.column("doc_id").is_null())
            doc = np.where(null, NULL_ID, b.column("doc_id").fill_null(0).to_numpy()).astype(np.int64)
            ids, n = tok.encode(b.column("text"))
            if end_id is not None:
                n = n + 1
                all_ids = np.full(n.sum(), end_id, np.int32)
                body = np.ones(len(all_ids), bool)
                body[np.cumsum(n) - 1] = False
                all_ids[body] = ids
                ids = all_ids
            held.append((doc, n, ids.astype(np.uint16 if tok.size <= 1 << 16 else np.int32)))
            size += len(ids)
            if size >= FILE_IDS:
                yield _file(part, seq, start, held)
                seq, start, held, size = seq + 1, start + size, [], 0
        if held:
            yield _file(part, seq, start, held)

    return stored(dealt.mapInArrow(encode, FILES), "ids", "none")[0]


def _file(part: int, seq: int, start: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    doc, n, ids = (np.concatenate(x) for x in zip(*held, strict=True))
    table = Frequencies.of(ids) if len(ids) else Frequencies(np.zeros(1, np.int64), np.array([1 << SCALE]))
    end = np.cumsum(n)
    blocks, lo = [], 0
    while lo < len(doc):
        base = end[lo] - n[lo]
        hi = max(lo + 1, int(np.searchsorted(end, base + BLOCK_IDS, "right")))
        blocks.append(encode_block(doc[lo:hi], n[lo:hi], ids[base : end[hi - 1]], table))
        lo = hi
    cols = [[part], [seq], [start], [len(ids)], [len(doc)], [table.packed()], [blocks]]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "seq", "start", "n_ids", "n_docs", "freqs", "blocks"])


def read_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decode a table of files: a row for each document with doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, and if asked for its ids."""
    spark = files.sparkSession
    # one number for each part of the writing job comes to the driver
    totals = files.groupBy("part").agg(F.max(F.col("start") + F.col("n_ids")).alias("n")).orderBy("part").collect()
    before, run = {}, 0
    for part, n in totals:
        before[part] = run
        run += n
    shipped = spark.sparkContext.broadcast(before)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                table = Frequencies.unpacked(b.column("freqs")[row].as_py())
                slots = table.slots()
                start = shipped.value[b.column("part")[row].as_py()] + b.column("start")[row].as_py()
                for raw in b.column("blocks")[row]:
                    block = Block(raw.as_py(), table, slots)
                    ids = block.ids().astype("<u4")
                    end = np.cumsum(block.lengths)
                    begin = end - block.lengths
                    view = memoryview(ids)
                    crc = [zlib.crc32(view[i:j]) for i, j in zip(begin, end, strict=True)]
                    cols = [pa.array(block.doc_ids, mask=block.doc_ids == NULL_ID), pa.array(start + begin), pa.array(block.lengths), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, end), pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                    start += len(ids)

    return files.select("part", "start", "freqs", "blocks").mapInArrow(decode, schema)
