"""Benchmark decontamination over a distributed positional inverted index.

Indexing: each task cuts its documents into segments and stores, for every
term of a segment, the list of its positions in the segment's word stream
(sorted, as differences). The index is a table in the shared folder; a segment
holds whole documents, so no term's list grows beyond one segment, however
frequent the term, and any segment can be read again after a lost executor.

Search: each window of a benchmark item is a phrase. In each segment it is
anchored at its rarest term; the lists of its other terms, shifted by their
offsets, are intersected from the next rarest on. What remains are exact
phrase places. Proximity matches start from the same anchors and ask that some
run of `slop` words of one document holds every term of the window.

Terms are held as 64-bit hashes of their bytes. Items are taken in blocks of
at most BLOCK_WORDS words, so what is broadcast has a fixed bound; every block
is searched in all segments. If there are several, they are searched one after
the other: each one's matches are stored and its broadcast is given up before
the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, arrow_batches, columns_only, slices, stored, text_words

WINDOW = 8
SLOP = 16
MIN_ITEMS = 2
BLOCK_WORDS = 1_000_000
#: Anchors that are intersected at once.
CHUNK = 2_000_000

INDEX = "docs binary, first_word binary, terms binary, counts binary, gaps binary"
HITS = "segment bigint, nth int, doc_id bigint, n_words bigint, hit array<int>, items array<string>, near array<string>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", solid: np.ndarray = ALNUM) -> DataFrame:
    """The index of docs, a lazy table of segments: document ids, first word of each document, terms (sorted), length and gaps of each term's list."""
    arrow_batches(docs.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            null = np.asarray(b.column("doc_id").is_null())
            ids = np.where(null, np.iinfo(np.int64).min, ids).astype(np.int64)
            words, first = text_words(b.column("text"), solid)
            place = np.argsort(words, kind="stable")
            terms, counts = np.unique(words[place], return_counts=True)
            gaps = np.diff(place, prepend=0).astype(np.int64)
            heads = np.cumsum(counts) - counts
            gaps[heads] = place[heads]
            blobs = [ids.tobytes(), first.astype("<u4").tobytes(), terms.astype("<u8").tobytes(), counts.astype("<u4").tobytes(), gaps.astype("<u4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], ["docs", "first_word", "terms", "counts", "gaps"])

    return columns_only(docs, **{id_col: "bigint", text_col: "string"}).toDF("doc_id", "text").mapInArrow(index, INDEX)


class Phrases:
    """Windows of a block of items: their distinct terms, and for each window a row of term numbers (-1: none)."""

    def __init__(self, item_ids: list[str], texts: list[str | None], window: int, solid: np.ndarray = ALNUM):
        words, first = text_words(pa.array(texts, pa.string()), solid)
        self.terms, code = np.unique(words, return_inverse=True)
        rows, owner = [], []
        for i in range(len(item_ids)):
            w = code[first[i] : first[i + 1]]
            if len(w) > window:
                rows.append(np.lib.stride_tricks.sliding_window_view(w, window))
            elif len(w):
                rows.append(np.pad(w, (0, window - len(w)), constant_values=-1)[None])
            else:
                continue
            owner.append(np.full(len(rows[-1]), i))
        self.windows = np.concatenate(rows) if rows else np.zeros((0, window), np.int64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.item_ids = item_ids


class Segment:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["docs"], np.int64)
        self.first = np.frombuffer(row["first_word"], "<u4").astype(np.int64)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        self.heads = np.cumsum(self.counts) - self.counts
        gaps = np.frombuffer(row["gaps"], "<u4").astype(np.int64)
        run = np.cumsum(gaps)
        self.places = run - np.repeat(run[self.heads] - gaps[self.heads], self.counts) if len(gaps) else gaps
        # all lists in one sorted array: (term's number, place)
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) << 32 | self.places

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = term << 32 | place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (place >= 0)

    def nearest(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Distance from each place to the closest one in the term's list."""
        key = term << 32 | place
        at = np.searchsorted(self.keys, key)
        best = np.full(len(key), 1 << 40)
        for i in (np.maximum(at - 1, 0), np.minimum(at, len(self.keys) - 1)):
            same = self.keys[i] >> 32 == term
            best = np.where(same, np.minimum(best, np.abs(self.places[i] - place)), best)
        return best


def search(seg: Segment, ph: Phrases, slop: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """(window, first place) of exact matches, and (window, anchor's place) of proximity matches, in chunks."""
    exact, near = [], []
    if not len(seg.keys) or not len(ph.windows):
        return exact, near
    at = np.minimum(np.searchsorted(seg.terms, ph.terms), len(seg.terms) - 1)
    local = np.where(seg.terms[at] == ph.terms, at, -1)
    used = ph.windows >= 0
    lists = np.where(used, local[np.maximum(ph.windows, 0)], -1)
    live = np.flatnonzero(((lists >= 0) | ~used).all(1))  # each term occurs here
    if not len(live):
        return exact, near
    lists, used = lists[live], used[live]
    df = np.where(used, seg.counts[np.maximum(lists, 0)], 1 << 40)
    rank = np.argsort(df, axis=1, kind="stable")  # rarest term first
    n_anchor = df[np.arange(len(live)), rank[:, 0]]
    size = np.cumsum(n_anchor)
    cuts = [0, *np.unique(np.searchsorted(size, np.arange(CHUNK, size[-1], CHUNK), "right")), len(live)]
    doc_of = lambda p: np.searchsorted(seg.first, p, "right")
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if lo == hi:
            continue
        n = n_anchor[lo:hi]
        win = np.repeat(np.arange(lo, hi), n)
        head = seg.heads[lists[np.arange(lo, hi), rank[lo:hi, 0]]]
        place = seg.places[np.repeat(head - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        begin = place - rank[win, 0]
        ok_w, ok_b = win, begin
        nr_w, nr_p = win, place
        for k in range(1, rank.shape[1]):
            slot = rank[ok_w, k]
            term = lists[ok_w, slot]
            keep = ~used[ok_w, slot] | seg.has(np.maximum(term, 0), ok_b + slot)
            ok_w, ok_b = ok_w[keep], ok_b[keep]
            if slop:
                slot = rank[nr_w, k]
                term = lists[nr_w, slot]
                keep = ~used[nr_w, slot]
                keep[~keep] = seg.nearest(term[~keep], nr_p[~keep]) < slop
                nr_w, nr_p = nr_w[keep], nr_p[keep]
        length = used[ok_w].sum(1)
        inside = (ok_b >= 0) & (doc_of(ok_b) == doc_of(ok_b + length - 1))
        exact.append((live[ok_w[inside]], ok_b[inside]))
        if slop and len(nr_w):
            keep = _same_run(seg, lists, used, nr_w, nr_p, slop)
            near.append((live[nr_w[keep]], nr_p[keep]))
    return exact, near


def _same_run(seg: Segment, lists: np.ndarray, used: np.ndarray, win: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
    """Whether some run of slop words of the anchor's document holds the anchor and every other term."""
    doc = np.searchsorted(seg.first, place, "right") - 1
    found = np.zeros(len(win), bool)
    for shift in range(slop):
        low = np.maximum(place - shift, seg.first[doc])
        high = np.minimum(low + slop - 1, seg.first[doc + 1] - 1)
        ok = ~found
        for slot in range(lists.shape[1]):
            i = np.flatnonzero(ok & used[win, slot])
            term = lists[win[i], slot]
            ok[i] = np.searchsorted(seg.keys, term << 32 | high[i], "right") > np.searchsorted(seg.keys, term << 32 | low[i], "left")
        found |= ok
    return found


def _item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Phrases]:
    """Items in blocks of at most block_words words (an item of more is a block of its own), one block at a time on the driver."""
    rows = items.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).filter(F.col(f"`{id_col}`").isNotNull())
    ids: list[str] = []
    texts: list[str | None] = []
    size = 0
    for item, text in rows.toLocalIterator():
        n = len(text or "") // 2 + 1  # at most so many words
        if ids and size + n > block_words:
            yield Phrases(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text)
        size += n
    yield Phrases(ids, texts, window)


def _scan(ph_of: Callable[[], Phrases], slop: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph = ph_of()
        for b in batches:
            for row in b.to_pylist():
                seg = Segment(row)
                n = len(seg.ids)
                exact, near = search(seg, ph, slop)
                width = (ph.windows >= 0).sum(1)
                hit, items, close = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
                if exact and (wins := np.concatenate([x for x, _ in exact])).size:
                    begins = np.concatenate([x for _, x in exact])
                    cover = np.unique(np.repeat(begins - (np.cumsum(width[wins]) - width[wins]), width[wins]) + np.arange(width[wins].sum()))
                    _by_document(seg, cover, cover, hit)
                    _by_document(seg, begins, ph.owner[wins], items)
                for wins, places in near:
                    _by_document(seg, places, ph.owner[wins], close)
                name = lambda found: [sorted({ph.item_ids[i] for i in x}) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * n, pa.int64()), pa.array(range(n), pa.int32()),
                        pa.array(seg.ids, mask=seg.ids == np.iinfo(np.int64).min), pa.array(np.diff(seg.first)),
                        pa.array([np.asarray(x, np.int64) - seg.first[i] for i, x in enumerate(hit)], pa.list_(pa.int32())),
                        pa.array(name(items), pa.list_(pa.string())), pa.array(name(close), pa.list_(pa.string())),
                    ],
                    ["segment", "nth", "doc_id", "n_words", "hit", "items", "near"],
                )

    return scan


def _by_document(seg: Segment, places: np.ndarray, values: np.ndarray, out: list[list]) -> None:
    pairs = np.unique(np.stack([np.searchsorted(seg.first, places, "right") - 1, values]), axis=1)
    for d, v in pairs.T.tolist():
        out[d].append(v)


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, slop: int = SLOP, min_items: int = MIN_ITEMS, block_words: int = BLOCK_WORDS, index: DataFrame | None = None,
) -> DataFrame:
    """One row for each document: doc_id, n_words, hit (word numbers inside an exact match), items (ids of items with an exact
    match), near (ids of items with a proximity match), contaminated (at least min_items items).

    index: a stored build_index(docs), to search without indexing again.

    Defined results: a null text has no words and no match; documents with a null id keep it; items with a null id are left out
    and those without words match nothing; repeated rows, of documents or items, are rows of their own; empty tables give no
    match or no row; an item id counts once however many rows have it.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    if index is None:
        index, _ = stored(build_index(docs, id_col, text_col), "index")
    segments = index.withColumn("segment", F.monotonically_increasing_id())
    blocks = _item_blocks(items, item_col, item_text, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        shipped = spark.sparkContext.broadcast(first)
        found = segments.mapInArrow(_scan(lambda: shipped.value, slop), HITS)
    else:
        segments, _ = stored(segments, "segments", "none")  # rows are numbered once for all blocks
        parts = [_searched(segments, ph, slop) for ph in chain([first, second], blocks)]
        every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        matched = reduce(DataFrame.unionAll, parts).groupBy("segment", "nth").agg(every("hit"), every("items"), every("near"))
        plain = segments.mapInArrow(_scan(lambda: Phrases([], [], window), 0), HITS).select("segment", "nth", "doc_id", "n_words")
        lists = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("hit", "array<int>"), ("items", "array<string>"), ("near", "array<string>"))]
        found = plain.join(matched, ["segment", "nth"], "left").select("doc_id", "n_words", *lists)
    return found.select("doc_id", "n_words", "hit", "items", "near", (F.size("items") >= min_items).alias("contaminated"))


def _searched(segments: DataFrame, ph: Phrases, slop: int) -> DataFrame:
    """The documents with a match of a block of items, stored."""
    shipped = segments.sparkSession.sparkContext.broadcast(ph)
    found = segments.mapInArrow(_scan(lambda: shipped.value, slop), HITS).filter((F.size("items") > 0) | (F.size("near") > 0))
    out, _ = stored(found, "matches")
    shipped.destroy()
    return out
