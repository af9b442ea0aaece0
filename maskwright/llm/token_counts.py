"""Token counts from flat token files, by a scan for separators.

A flat file is ids of 16 or 32 bits after each other, each document followed
by the end-of-document id; nothing says where documents begin. Files are held
as rows of blocks of bytes in the shared folder, cut anywhere between two ids.
A scan searches each block for the end id with one vectorised comparison. It
gives the counts of the documents that lie within the block, and the ids
before its first and after its last separator; those are stitched over the
blocks of a file by a prefix scan of a few numbers a block, so a document may
span any number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_ids import tokenizer
from .common import arrow_batches, columns_only, slices, stored

END_ID = 50256
BLOCK_BYTES = 1 << 20
FLAT = "file int, block int, width int, bytes binary"


def write_flat(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Encode whole texts (special tokens' strings are ordinary text, so no text has the end id) and write a file for each
    part; gives the blocks and, apart from them, the ids of each file's documents in order (file, nth, doc_id)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    src = columns_only(docs, **{id_col: "bigint", text_col: "string"}).toDF("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path, plain=True)
        kind = np.dtype("<u2" if max(tok.size, end_id + 1) <= 1 << 16 else "<u4")
        part, block, nth, held = TaskContext.get().partitionId(), 0, 0, b""

        def row(raw: bytes | None, ids: pa.Array | None, first: int, n: int) -> pa.RecordBatch:
            lists = pa.array([None], pa.list_(pa.int64())) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64()))
            cols = [pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([kind.itemsize], pa.int32()), pa.array([raw], pa.binary()), pa.array([first], pa.int64()), lists]
            return pa.RecordBatch.from_arrays(cols, ["file", "block", "width", "bytes", "first", "ids"])

        for b in slices(batches, "text"):
            ids, n = tok.encode(b.column("text"))
            flat = np.full(len(ids) + len(n), end_id, kind)
            body = np.ones(len(flat), bool)
            body[np.cumsum(n + 1) - 1] = False
            flat[body] = ids
            held += flat.tobytes()
            while len(held) >= block_bytes:
                yield row(held[:block_bytes], None, 0, block)
                held, block = held[block_bytes:], block + 1
            yield row(None, b.column("doc_id"), nth, -1)
            nth += b.num_rows
        if held:
            yield row(held, None, 0, block)

    written, _ = stored(src.mapInArrow(encode, FLAT + ", first bigint, ids array<bigint>"), "flat")
    flat = written.filter("bytes is not null").select("file", "block", "width", "bytes")
    named = written.filter("ids is not null").select("file", "first", F.posexplode("ids").alias("at", "doc_id"))
    return flat, named.select("file", (F.col("first") + F.col("at")).alias("nth"), "doc_id")


def separators(raw: bytes, width: int, end_id: int) -> np.ndarray:
    """Places of the end id in a block."""
    return np.flatnonzero(np.frombuffer(raw, f"<u{width}") == end_id)


def count_tokens(flat: DataFrame, end_id: int = END_ID) -> DataFrame:
    """One row for each document in flat files: file, nth (from 0), n_tokens with the end id. Ids after a file's last
    separator are a document that wasn't ended, and are left out. No blocks, no rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, width = b.column("bytes"), b.column("width").to_pylist()
            at = [separators(raw[i].as_buffer(), width[i], end_id) for i in range(b.num_rows)]
            size = [len(raw[i].as_buffer()) // width[i] for i in range(b.num_rows)]
            inner = pa.array([np.diff(x) for x in at], pa.list_(pa.int64()))
            head = pa.array([int(x[0]) + 1 if len(x) else n for x, n in zip(at, size, strict=True)], pa.int64())
            tail = pa.array([n - int(x[-1]) - 1 if len(x) else 0 for x, n in zip(at, size, strict=True)], pa.int64())
            found = pa.array([len(x) for x in at], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), found, head, tail, inner], ["file", "block", "found", "head", "tail", "inner"])

    blocks, _ = stored(flat.mapInArrow(scan, "file int, block int, found bigint, head bigint, tail bigint, inner array<bigint>"), "blocks")
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    # the prefix scan: documents ended before a block, and ids that wait there for their separator
    small = blocks.select("file", "block", "found", "head", "tail")
    run = small.withColumn("ended", F.coalesce(F.sum("found").over(before), F.lit(0)))
    size = F.when(F.col("found") == 0, F.col("head")).otherwise(0)
    run = run.withColumn("through", F.sum(size).over(order.rowsBetween(W.unboundedPreceding, -1)))
    last = F.last(F.when(F.col("found") > 0, F.struct(F.col("tail").alias("tail"), F.coalesce("through", F.lit(0)).alias("through"))), ignorenulls=True).over(before)
    run = run.withColumn("last", last)
    waiting = F.coalesce("through", F.lit(0)) - F.coalesce("last.through", F.lit(0)) + F.coalesce("last.tail", F.lit(0))
    heads = run.filter("found > 0").select("file", "block", "ended", (F.col("head") + waiting).alias("first"))
    joined = blocks.filter("found > 0").join(heads, ["file", "block"])
    counts = F.concat(F.array("first"), "inner")
    return joined.select("file", "ended", F.posexplode(counts).alias("at", "n_tokens")).select("file", (F.col("ended") + F.col("at")).alias("nth"), "n_tokens")


def token_counts(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write flat files of docs, scan them, and name the documents: doc_id, file, nth, n_tokens (with the end id).

    Defined results: null and empty texts are documents of the end id alone; a null id is kept; repeated rows are documents of
    their own; an empty table gives an empty result; further columns are ignored.
    """
    flat, named = write_flat(docs, tokenizer_path, end_id, id_col, text_col, block_bytes)
    return named.join(count_tokens(flat, end_id), ["file", "nth"]).select("doc_id", "file", "nth", "n_tokens")
