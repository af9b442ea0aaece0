"""Language identification by prediction by partial matching (PPM).

For each language a variable-order byte context tree of at most ORDER bytes is
counted on a bounded sample. Its statistics are then frozen: the probability
of a byte after a context is by method C (a context seen T times with D
distinct next bytes gives n / (T + D) to a byte seen n times, and leaves
D / (T + D) to the shorter context, without the bytes already ruled out). A
context that a language has not seen passes on to its longest seen suffix.
Frozen statistics are sparse: for each language and order, the bits of each
(context, byte) seen and of the escape from each context seen, under sorted keys;
what a model takes grows with what its bounded samples hold, not with alphabet
or languages at a power. A code length depends on the ORDER bytes before a byte
only, so of a batch each distinct run of ORDER + 1 bytes is looked up once in
each language; a text's code length is the sum over its bytes, and the shortest
code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batches, columns_only, slices, text_buffer

ORDER = 3
#: The model is fitted on at most so many texts, and about so many bytes, of each language.
SAMPLE_DOCS = 400
SAMPLE_BYTES = 1 << 20
UNKNOWN = "und"
PAD = 10  # the byte that stands before a text
#: Bytes that are scored at once.
SLICE = 1 << 20
#: Bits of a byte that can't come, as its context leaves it no probability.
IMPOSSIBLE = 99.0


class Ppm:
    """Frozen code lengths of several languages."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        texts = {k: [np.frombuffer(t, np.uint8) for t in v] for k, v in samples.items()}
        seen = np.zeros(256, bool)
        seen[PAD] = True
        for v in texts.values():
            for t in v:
                seen[t] = True
        n = int(seen.sum())
        # bytes never seen share a symbol: in every context they are coded alike, and as contexts they are all unseen
        self.symbol = np.full(256, n, np.int64)
        self.symbol[seen] = np.arange(n)
        self.S = n + 1
        self.tables = [self._frozen(v) for _, v in sorted(texts.items())]

    def _frozen(self, texts: list[np.ndarray]) -> list[tuple[np.ndarray, ...]]:
        """For each order from 0 the seen (context, symbol) with their bits, and the seen contexts with the bits of an escape."""
        n, S = self.S - 1, self.S
        ctx, sym = map(np.concatenate, zip(*(self.contexts(self.symbol[t], np.array([0, len(t)])) for t in texts), strict=True))
        base = np.full(S, 1 / 256)
        base[n] = (256 - n) / 256
        nothing = np.zeros(0, np.int64)
        tables = [(np.arange(S), np.full(S, np.inf) if n == 256 else -np.log2(np.maximum(base, 1e-30)), nothing, nothing.astype(float))]
        tables[0][1][:n] = 8
        for k in range(ORDER + 1):
            cells, times = np.unique(ctx % S**k * S + sym, return_counts=True)
            rows, first, kinds = np.unique(cells // S, return_index=True, return_counts=True)
            total = np.add.reduceat(times, first)
            # of the shorter context's probability, what the bytes not seen here have; it is shared out among them
            left = 1 - np.add.reduceat(np.exp2(-self._bits(tables, cells)), first)
            closed = left <= 1e-9
            bits = -np.log2(times / np.repeat(total + np.where(closed, 0, kinds), kinds))
            escape = np.where(closed, IMPOSSIBLE, -np.log2(kinds / (total + kinds) / np.where(closed, 1, left)))
            tables.append((cells, bits, rows, escape))
        return tables

    def _bits(self, tables: list[tuple[np.ndarray, ...]], grams: np.ndarray) -> np.ndarray:
        """Bits of symbols after contexts (context * S + symbol), by the tables of the first orders."""
        out, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(len(tables) - 2, -2, -1):  # the table before order 0 holds all symbols
            cells, bits, rows, escape = tables[k + 1]
            cell = grams[open_] % self.S ** (k + 1 if k >= 0 else 1)
            at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
            hit = cells[at] == cell
            out[open_[hit]] += bits[at[hit]]
            open_, cell = open_[~hit], cell[~hit]
            if len(rows) and len(open_):
                row = cell // self.S
                at = np.minimum(np.searchsorted(rows, row), len(rows) - 1)
                known = rows[at] == row
                out[open_[known]] += escape[at[known]]
        return out

    def contexts(self, sym: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last three symbols before each one, as a number; texts begin after PAD."""
        S, pad = self.S, self.symbol[PAD]
        long = np.concatenate([np.full(ORDER, pad), sym])
        ctx = long[:-3] * (S * S) + long[1:-2] * S + long[2:-1]
        begin, size = offs[:-1], np.diff(offs)
        for k in range(ORDER):  # the first bytes of each text
            at = begin[size > k] + k
            parts = [sym[at - d] if d <= k else pad for d in (3, 2, 1)]
            ctx[at] = parts[0] * (S * S) + parts[1] * S + parts[2]
        return ctx, sym

    def code_lengths(self, data: np.ndarray, offs: np.ndarray, most: int = SLICE) -> np.ndarray:
        """Bits of each text in each language."""
        ctx, sym = self.contexts(self.symbol[data], offs)
        grams = ctx * self.S + sym
        grams = grams.astype(np.uint32) if self.S**4 < 1 << 32 else grams  # sorts faster
        unseen = np.log2(max(1, 257 - self.S))  # of one of the bytes that share a symbol
        out = np.zeros((len(offs) - 1, len(self.langs)))
        for a in range(0, len(data), most):  # a text can come in parts
            b = min(a + most, len(data))
            own = np.flatnonzero((offs[:-1] < b) & (offs[1:] > a) & (np.diff(offs) > 0))
            cuts = np.maximum(offs[own] - a, 0)
            distinct, which = np.unique(grams[a:b], return_inverse=True)
            distinct = distinct.astype(np.int64)
            extra = np.where(distinct % self.S == self.S - 1, unseen, 0)
            for j, tables in enumerate(self.tables):
                out[own, j] += np.add.reduceat((self._bits(tables, distinct) + extra)[which], cuts)
        return out


def training_sample(docs: DataFrame, sample_docs: int, sample_bytes: int) -> dict[str, list[bytes]]:
    """Texts to fit on, by language: the rows with the smallest hashed ids, at most sample_docs of a language, until
    sample_bytes are reached. docs: row_key, text, lang of the labelled rows."""
    sizes = dict(docs.groupBy("lang").count().collect())
    if not sizes:
        return {}
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 2 * sample_docs / n)))))
    place = (F.xxhash64("row_key", F.lit(11)) / F.lit(2.0**64)) + 0.5
    few = docs.withColumn("place", place).filter(F.col("place") <= F.element_at(share, F.col("lang")))
    few = few.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("place"))).filter(F.col("nth") <= sample_docs)
    out: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, text in few.select("lang", "text").toLocalIterator():
        if size.get(lang, 0) < sample_bytes:
            out.setdefault(lang, []).append(text.encode())
            size[lang] = size.get(lang, 0) + len(out[lang][-1])
    return {k: v for k, v in out.items() if size[k]}


def held_out(id_col: str) -> F.Column:
    """Documents that no model may learn from."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Ppm | None:
    """A model of the languages of those labelled rows that are not held out; None if there are none."""
    rows = docs.filter(~held_out(id_col)).select(
        F.col(f"`{id_col}`").cast("string").alias("row_key"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    )
    samples = training_sample(rows.filter("text is not null and lang is not null"), sample_docs, sample_bytes)
    return Ppm(samples) if samples else None


def identify(docs: DataFrame, model: Ppm | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: id, lang_pred, score (share of the best language if all are as likely beforehand), bits per
    byte under it; with the columns named in keep.

    Defined results: null, empty and letterless texts, and all texts if nothing was learned, are `und` with score 0; of
    languages with equal code lengths the first by name is taken; a null id is kept; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    names = list(dict.fromkeys([id_col, text_col, *keep]))
    src = docs.select(*(F.col(f"`{c}`") for c in names))
    out = [f for f in src.schema.fields if f.name == id_col or f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out), "lang_pred string", "score double", "bits_per_byte double"])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shipped.value
        for b in slices(batches, text_col, SLICE):
            data, offs = text_buffer(b.column(text_col))
            best, score, rate = np.full(b.num_rows, -1), np.zeros(b.num_rows), np.zeros(b.num_rows)
            if ppm is not None and len(data):
                bits = ppm.code_lengths(data, offs)
                ok = _has_letter(data, offs)
                best[ok] = bits[ok].argmin(1)
                short = bits[ok].min(1)
                score[ok] = 1 / np.exp2(np.maximum(short[:, None] - bits[ok], -1000)).sum(1)
                rate[ok] = short / np.diff(offs)[ok]
            names = np.array([*(ppm.langs if ppm else []), UNKNOWN], object)
            cols = [b.column(f.name) for f in out] + [pa.array(names[best], pa.string()), pa.array(score), pa.array(rate)]
            yield pa.RecordBatch.from_arrays(cols, [*(f.name for f in out), "lang_pred", "score", "bits_per_byte"])

    return src.mapInArrow(predict, schema)


def _has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    plain = ((data | 32) >= 97) & ((data | 32) <= 122)
    count = np.concatenate([[0], np.cumsum(plain)])
    ok = count[offs[1:]] > count[offs[:-1]]
    for i in np.flatnonzero(~ok & (np.diff(offs) > 1)):
        ok[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return ok


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out, and predict every row."""
    model = fit(columns_only(docs, **{id_col: "bigint", text_col: "string", lang_col: "string"}), id_col, text_col, lang_col)
    found = identify(columns_only(docs, **{id_col: "bigint", text_col: "string"}), model, id_col, text_col)
    return found.withColumn("held_out", held_out(id_col))
