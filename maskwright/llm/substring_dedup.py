"""Substring deduplication by sliding sentence spans.

A text is cut into sentences: after a line's end, and after `.`, `!` or `?`
before white space; a sentence of over LONG words is cut again at every word, so
equal passages are cut alike wherever they stand. The shortest run of at least
RUN pieces and MIN_WORDS words that begins at each piece, and the shortest that
ends at each, is hashed (96 bits, of lower-case words). Each repeated run of
pieces, however long, is the union of such runs within it, so it is found to its
ends. Runs are joined over the whole corpus by hash; of equal runs the first, by
document id and place, stays, and pieces covered by any other are removed. The
first of each run is found with pre-aggregated minima, and runs meet it in a
join whose partitions can be split, so a passage that stands in a third of all
documents is no bottleneck.

A passage of over 50 words that begins and ends within sentences of at most LONG
words still holds MIN_WORDS words in whole pieces, so it is found (50 - 2 * (LONG
- 1) >= MIN_WORDS); of such a sentence at its ends nothing is removed, as the rest
of it isn't repeated.

Before runs are hashed, those that can't be repeated are left out, without loss:
of the first MIN_WORDS words of a run, the GRAM words with the smallest hash are
its mark. Equal runs have equal marks, so a run is hashed only if its mark is
found more than once in the corpus. Marks are about a seventh of all words.
Runs are stored and taken in PARTS parts by their hash, and each step's shuffle
files go at its end, as all runs on disk at once would be several times the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOW, arrow_batches, columns_only, drop_path, mix64, slices, span_hashes, stored, text_buffer, word_spans

RUN, MIN_WORDS = 2, 20
LONG, GRAM = 16, 8
PARTS = 2
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Odd numbers, and what undoes multiplication by them.
_BASES = [(b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)]


def _extreme(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each `width` values on end."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = of(x[:-step], x[step:])
        have += step
    return x


class Sentences:
    """Pieces of several texts, which are sentences or words of long ones: `begin` is the first byte of each (one more for the
    end), `rows` the number of each text's first piece (one more for the end), `words` the number of words before each piece
    (one more for the end), `before` the number of sentences that begin before each piece (one more for the end)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        low = LOW[data]
        starts, ends, _ = word_spans(low, offs, ALNUM)
        self.hashes = span_hashes(low, starts, ends)
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            space = _SPACE[data]
            cut[1:] = data == 0x0A
            cut[1:-1] |= _STOP[data[:-1]] & space[1:]
        cut[offs] = True
        edges = np.flatnonzero(cut)
        first = np.searchsorted(starts, edges)  # words before each edge
        size = np.diff(first)
        inner = np.repeat(size > LONG, size)
        inner[first[:-1][size > 0]] = False
        sentence = cut.copy()
        cut[starts[inner]] = True
        edges = np.flatnonzero(cut)
        words = np.searchsorted(starts, edges)
        # a piece without words belongs to the one before it, unless it begins a text
        head = np.zeros(len(data) + 1, bool)
        head[offs] = True
        keep = np.append(np.diff(words) > 0, True) | head[edges]
        self.begin, self.words = edges[keep], words[keep]
        self.rows = np.searchsorted(self.begin, offs)
        self.before = np.concatenate([[0], np.cumsum(sentence[self.begin[:-1]])])

    def _sums(self, base: int, inverse: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the hashes before each word, each times a power of base, and what undoes that power."""
        up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(self.hashes), base, np.uint64))])
        down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(self.hashes), inverse, np.uint64))])
        return np.concatenate([[np.uint64(0)], np.cumsum(self.hashes * up[:-1], dtype=np.uint64)]), down

    def _grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the GRAM words from each word on, and the mark of the MIN_WORDS words from each word on."""
        total, down = self._sums(*_BASES[0])
        grams = mix64((total[GRAM:] - total[:-GRAM]) * down[:-GRAM]) | np.uint64(1)
        return grams, _extreme(grams, MIN_WORDS - GRAM + 1, np.minimum)

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct marks of each text: its number, the mark, and at how many places it is one."""
        grams, marks = self._grams()
        first = self.words[self.rows]
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside = np.arange(MIN_WORDS, MIN_WORDS + len(marks)) <= first[1:][row[: len(marks)]]
        width = MIN_WORDS - GRAM + 1
        none = np.zeros(width - 1, np.uint64)
        picked = np.flatnonzero(_extreme(np.concatenate([none, np.where(inside, marks, np.uint64(0)), none]), width, np.maximum)[: len(grams)] == grams)
        row, mark = row[picked], grams[picked]
        order = np.lexsort((mark, row))
        row, mark = row[order], mark[order]
        head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (mark[1:] != mark[:-1])])[: len(row)])
        return row[head], mark[head].view(np.int64), np.diff(np.append(head, len(row)))

    def runs(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each run whose mark is wanted: its text, first piece and end (numbered in the text), and two hashes. A run begins
        at a piece with words: with an empty one before them the same words would be their own repeat."""
        n = len(self.begin) - 1
        at = np.arange(n)
        row = np.searchsorted(self.rows, at, "right") - 1
        worded = np.diff(self.words) > 0
        end = np.maximum(at + RUN, np.searchsorted(self.words, self.words[:-1] + MIN_WORDS))
        ok = (end <= self.rows[row + 1]) & worded if n else np.zeros(0, bool)
        # the shortest that ends at each, where it isn't the shortest of its first sentence too
        back = np.minimum(at + 1 - RUN, np.searchsorted(self.words, self.words[1:] - MIN_WORDS, "right") - 1)
        more = (back >= self.rows[row]) & worded[back] & (end[back] != at + 1) if n else np.zeros(0, bool)
        at, end, row = np.concatenate([at[ok], back[more]]), np.concatenate([end[ok], at[more] + 1]), np.concatenate([row[ok], row[more]])
        _, marks = self._grams()
        turns = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]])[: len(marks)])
        asked = np.repeat(np.isin(marks[turns].view(np.int64), wanted), np.diff(np.append(turns, len(marks))))
        ok = asked[self.words[at]]
        at, end, row = at[ok], end[ok], row[ok]
        keys = []
        for base, inverse in _BASES:
            total, down = self._sums(base, inverse)
            a, b = self.words[at], self.words[end]
            keys.append((((total[b] - total[a]) * down[a]) ^ ((b - a).astype(np.uint64) << np.uint64(40))).view(np.int64))
        return row, at - self.rows[row], end - self.rows[row], keys


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        row, mark, times = Sentences(*text_buffer(b.column("text"))).marks()
        cols = [pa.array(mark), b.column("doc_id").take(pa.array(row)), pa.array(times, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, ["mark", "doc_id", "times"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        wanted = np.unique(b.column("marks").flatten().to_numpy(zero_copy_only=False))
        row, first, end, (one, two) = Sentences(*text_buffer(b.column("text"))).runs(wanted)
        ids = b.column("doc_id").take(pa.array(row))
        cols = [pa.array(one), pa.array(two.astype(np.int32)), ids, pa.array(first, pa.int32()), pa.array(end, pa.int32())]
        out = pa.RecordBatch.from_arrays(cols, ["h1", "h2", "doc_id", "first", "end"])
        for at in range(0, out.num_rows, 50_000):
            yield out.slice(at, 50_000)


def _covered(s: Sentences, runs: pa.ListArray) -> np.ndarray:
    """Whether each piece lies in one of its text's runs."""
    base = np.repeat(s.rows[:-1], pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False))
    flat = runs.flatten()
    n = len(s.begin)
    open_ = np.bincount(base + flat.field("first").to_numpy(zero_copy_only=False), minlength=n)
    shut = np.bincount(base + flat.field("end").to_numpy(zero_copy_only=False), minlength=n)
    return np.cumsum(open_ - shut)[: n - 1] > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        data, offs = text_buffer(b.column("text"))
        s = Sentences(data, offs)
        every = _covered(s, b.column("covered"))
        texts, spans, removed, words = [], [], [], []
        for i in range(b.num_rows):
            gone = every[s.rows[i] : s.rows[i + 1]]
            begin = s.begin[s.rows[i] : s.rows[i + 1] + 1]
            if gone.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                pairs = [(int(begin[x]), int(begin[y])) for x, y in edge.reshape(-1, 2)]
                keep = [int(offs[i]), *(x for p in pairs for x in p), int(offs[i + 1])]
                texts.append(b"".join(data[x:y].tobytes() for x, y in zip(keep[::2], keep[1::2], strict=True)).decode())
                points = np.concatenate([[0], np.cumsum((data[offs[i] : offs[i + 1]] & 0xC0) != 0x80)])
                spans.append(",".join(f"{points[x - offs[i]]}:{points[y - offs[i]]}" for x, y in pairs))
            else:
                texts.append(b.column("text")[i].as_py())
                spans.append("")
            removed.append(len(np.unique(s.before[s.rows[i] + 1 : s.rows[i + 1] + 1][gone])))
            words.append(int(np.diff(s.words[s.rows[i] : s.rows[i + 1] + 1])[gone].sum()))
        cols = [b.column("doc_id"), pa.array(np.diff(s.before[s.rows])), pa.array(removed, pa.int64()), pa.array(words, pa.int64()), pa.array(spans, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_sentences", "n_removed", "words_removed", "removed", "text"])


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside drops its shuffle files at its end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


def _repeats(spans: DataFrame, part: int) -> DataFrame:
    """doc_id, covered: all but the first of equal runs, of one part of them."""
    spark = spans.sparkSession
    spans = spans.filter(F.pmod("h2", F.lit(PARTS)) == part)
    heads = spans.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "first")).alias("head"), F.max(F.struct("doc_id", "first")).alias("last")).filter("head <> last")
    heads, path = stored(heads.select("h1", "h2", "head"), "heads")
    again = spans.join(heads, ["h1", "h2"]).filter((F.col("doc_id") != F.col("head.doc_id")) | (F.col("first") != F.col("head.first")))
    out, _ = stored(again.groupBy("doc_id").agg(F.collect_set(F.struct("first", "end")).alias("covered")), "repeats")
    drop_path(spark, path)
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_sentences, n_removed (sentences of which something was removed), words_removed,
    removed (start:end of what was removed, in code points, comma-joined), text (without it).

    Defined results: a null text stays null, and an empty one empty, with no sentences; a document shorter than a run has none
    and keeps all; rows with a null id keep all and don't count as repeats; rows with the same id are one document, so equal
    places in them are the same place; an empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    src = columns_only(docs, **{id_col: "bigint", text_col: "string"}).toDF("doc_id", "text")
    with _shuffles_dropped(spark):
        marks, marks_path = stored(src.filter("doc_id is not null").mapInArrow(_marks, "mark bigint, doc_id bigint, times int"), "marks")
        twice = marks.groupBy("mark").agg(F.sum("times").alias("n")).filter("n > 1").select("mark")
        wanted, wanted_path = stored(marks.join(twice, "mark").groupBy("doc_id").agg(F.collect_set("mark").alias("marks")), "wanted")
        drop_path(spark, marks_path)
        marked = src.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "marks")
        spans, spans_path = stored(marked.mapInArrow(_spans, "h1 bigint, h2 int, doc_id bigint, first int, end int"), "runs")
        drop_path(spark, wanted_path)
        parts = [_repeats(spans, k) for k in range(PARTS)]
        drop_path(spark, spans_path)
    covered = reduce(DataFrame.unionAll, parts).groupBy("doc_id").agg(F.flatten(F.collect_list("covered")).alias("covered"))
    joined = src.join(covered.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "covered")
    out = "doc_id bigint, n_sentences bigint, n_removed bigint, words_removed bigint, removed string, text string"
    return joined.mapInArrow(_cut, out)
