"""What the training-data operators share: table reads, the shared folder,
and a vectorised scan of words over Arrow text columns."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import drop_path, release, shared_dir, stored

__all__ = ["drop_path", "release", "shared_dir", "stored"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes of an Arrow batch (a row of more bytes is one of its own); with the slices of SLICE_BYTES below they bound
#: what a task holds outside the JVM's heap.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches: whole texts can be long, and long ones can follow each other."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def vocabulary(path: str) -> str:
    """A tokenizer's file in this process: where the driver's path isn't there, the installed package's file of that name."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def columns_only(df: DataFrame, **types: str) -> DataFrame:
    """The columns an operator reads, with the types it works on; further columns
    (whatever their names) are left out before any join."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()))


# ---------------------------------------------------------------- Arrow text

LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32
#: Words of [0-9A-Za-z] and of all characters beyond ASCII, as the UTF-8 bytes of those are 0x80 and over.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Words of all but space and TAB, LF, VT, FF, CR.
SOLID = np.ones(256, bool)
SOLID[[0x20, 9, 10, 11, 12, 13]] = False

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
LONG_WORD = 1024


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), in place."""
    t = x >> np.uint64(30)
    x ^= t
    x *= M1
    np.right_shift(x, np.uint64(27), out=t)
    x ^= t
    x *= M2
    np.right_shift(x, np.uint64(31), out=t)
    x ^= t
    return x


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and where each row starts (one more for the end). Null is empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to about `most` bytes of text, at least one row each."""
    for b in batches:
        if not b.num_rows:
            continue
        _, offs = text_buffer(b.column(text))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield b.slice(at, end - at)
            at = end
        pa.default_memory_pool().release_unused()


def word_spans(data: np.ndarray, offs: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end byte of every word, and the number of the first word of each row (one more for the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = solid[data]
    edge = np.zeros(len(w) + 1, bool)
    edge[offs] = True  # a word does not go on into the next row
    start = w.copy()
    start[1:] &= ~w[:-1] | edge[1:-1]
    end = w.copy()
    end[:-1] &= ~w[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes, equal hash, in any process."""
    pad = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray((len(pad) - 8,), "<u8", pad, strides=(1,))
    lens = ends - starts
    h = words[starts] & _KEEP[np.minimum(lens, 8)]
    h += lens.astype(np.uint64) * GOLD
    mix64(h)
    more = np.flatnonzero((lens > 8) & (lens <= LONG_WORD))
    k = 8
    while len(more):
        left = lens[more] - k
        part = words[starts[more] + k] & _KEEP[np.minimum(left, 8)]
        h[more] = mix64((h[more] * GOLD) ^ part)
        more, k = more[left > 8], k + 8
    for i in np.flatnonzero(lens > LONG_WORD):
        h[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "<u8")[0]
    return h


def text_words(col: pa.Array, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, lower-cased in A-Z, and the number of each row's first word (one more for the end)."""
    data, offs = text_buffer(col)
    data = LOW[data]
    starts, ends, rows = word_spans(data, offs, solid)
    return span_hashes(data, starts, ends), rows


def distinct_pairs(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()
