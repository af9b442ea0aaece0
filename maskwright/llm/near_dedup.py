"""Near-duplicate groups: SuperMinHash signatures, banding, verification on
full sets, and union-find.

Documents with equal shingle sets form a class, and only one of each class goes
on. SuperMinHash (Ertl, 2017) gives each shingle correlated ranks at all
positions of the signature: level j puts the shingle at the j-th place of its
own random permutation with rank j + r, and a document is done as soon as no
later level can lower any position. Signatures are cut into bands; documents
that share a band are candidates.

A band's bucket of n documents isn't expanded into pairs: all are compared
with its smallest (n - 1 pairs), and links confirmed on full sets are grouped.
Only in buckets whose documents then lie in different groups are the pairs
across groups compared, so no candidate pair is left open; a bucket of many
documents is cut into blocks, and blocks meet two by two in tasks of bounded
size. Before full sets are fetched, a sketch of a few bits a position rules out
pairs that are far from the threshold (a pair at the threshold is lost less than
once in 100,000); sketch=False compares the full sets of all candidates instead.
With BANDS bands of BAND_ROWS positions a pair at similarity 0.75 shares a band
with probability 0.99998.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SOLID, arrow_batches, columns_only, drop_path, mix64, slices, stored, text_words
from .components import connected_components

SHINGLE = 5
PERCENT = 75
BANDS, BAND_ROWS = 40, 5
SIGNATURE = 400
SHINGLE_SLICE = 1 << 19
SKETCH, PLANES = 384, 4
#: Levels of a signature before permutations are written out.
FIRST_LEVELS = 12
#: Rows of a bucket that meet as many others in one task.
BLOCK_ROWS = 500
SALTS = 32


def _odd(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingle_sets(col: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's runs of `size` words; of fewer words, but not none, the whole."""
    words, rows = text_words(col, SOLID)
    step = _odd(size, 3)
    runs = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        runs += words[k : k + len(runs)] * step[k]
    mix64(runs)
    out = []
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(mix64((words[a:b] * step[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures of m positions, all of several sets at once, level by level. Ranks are j + r with r in 32 bits.

    At level j an element's permutation has its places j and k (k >= j) exchanged, and place j isn't asked for again, so what a
    level leaves is one place and its value. The first levels, after which most sets are done, keep these alone; then the
    permutations of the elements that are left are written out.
    """
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), m), np.iinfo(np.uint64).max)
    flat = out.reshape(-1)
    base = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    moved: list[tuple[np.ndarray, np.ndarray]] = []
    order: np.ndarray | None = None
    low, salt = np.uint64(0xFFFFFFFF), _odd(m, 5)

    def value(place: np.ndarray) -> np.ndarray:
        got = place.copy()
        for k, v in moved:
            np.copyto(got, v, where=k == place)
        return got

    for j in range(m):
        if not len(base):
            break
        rnd = mix64(base ^ salt[j])
        k = (j + ((rnd & low) * np.uint64(m - j) >> np.uint64(32))).astype(np.uint16)
        if j < FIRST_LEVELS:
            place = value(k)
            moved.append((k, value(np.full(len(k), j, np.uint16))))
        else:
            each = np.arange(len(base))
            if order is None:
                order = np.tile(np.arange(m, dtype=np.uint16), (len(base), 1))
                for at, v in moved:
                    order[each, at] = v
            place = order[each, k]
            order[each, k] = order[:, j]
        np.minimum.at(flat, owner * m + place, (np.uint64(j) << np.uint64(32)) | (rnd >> np.uint64(32)))
        open_ = out.max(1) >= np.uint64(j + 1) << np.uint64(32)
        keep = open_[owner]
        if not keep.all():
            base, owner = base[keep], owner[keep]
            if order is None:
                moved = [(at[keep], v[keep]) for at, v in moved]
            else:
                order = order[keep]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    keys = np.zeros((len(signatures), bands), np.uint64) + _odd(bands, 9)
    for r, c in enumerate(_odd(rows, 13)):
        keys += mix64(parts[:, :, r] ^ c) * c
    return mix64(keys).view(np.int64)


def sketch_words(signatures: np.ndarray) -> list[np.ndarray]:
    """PLANES bits of each of SKETCH positions: for each word of 64 positions, a word of every plane. Equal positions have
    equal bits; others have with probability 1 / 2 ** PLANES."""
    at = np.arange(SKETCH) * signatures.shape[1] // SKETCH
    place = np.arange(SKETCH, dtype=np.uint64) % np.uint64(64)
    out = []
    for k in range(0, SKETCH, 64):
        for plane in range(PLANES):
            bits = (signatures[:, at[k : k + 64]] >> np.uint64(plane) & np.uint64(1)) << place[k : k + 64]
            out.append(np.bitwise_or.reduce(bits, axis=1).view(np.int64))
    return out


def sketch_limit(percent: int) -> int:
    """Differing positions that a pair at the threshold exceeds less than once in a hundred thousand."""
    p = (1 - percent / 100) * (1 - 0.5**PLANES)
    return int(SKETCH * p + 4.4 * (SKETCH * p * (1 - p)) ** 0.5)


BITS = [f"s{k}" for k in range(SKETCH // 64 * PLANES)]


def _alike(a: str, b: str, percent: int, sketch: bool) -> F.Column:
    """Whether two sketches differ in few enough positions."""
    if not sketch:
        return F.lit(True)
    differ = [F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in BITS]
    words = [reduce(lambda x, y: x.bitwiseOR(y), differ[k : k + PLANES]) for k in range(0, len(BITS), PLANES)]
    return sum((F.bit_count(w) for w in words), F.lit(0)) <= sketch_limit(percent)


def _sketch(bands: int, rows: int, size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SHINGLE_SLICE):
            sets = shingle_sets(b.column("text"), size)
            signatures = superminhash(sets, max(SIGNATURE, bands * rows))
            keys = band_keys(signatures[:, : bands * rows], bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
            words = sketch_words(signatures)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), lists, *map(pa.array, words)], ["doc_id", "n", "class", "keys", *BITS])

    return run


def _sets(size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column("text"), size)
            ends = np.cumsum([0, *(len(s) for s in sets)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], ["doc_id", "shingles"])

    return run


def full_sets(docs: DataFrame, ids: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, str]:
    """The shingle sets of the documents with these ids, stored. docs: doc_id, text; ids: doc_id."""
    found = docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id bigint, shingles array<bigint>")
    return stored(found, "sets", "none")


def _confirm(percent: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, at_x), (y, at_y) = ((np.asarray(c.values), np.asarray(c.offsets)) for c in (b.column("one"), b.column("two")))
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                both = np.concatenate([x[at_x[i] : at_x[i + 1]], y[at_y[i] : at_y[i + 1]]])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * common >= percent * (len(both) - common)
            yield b.select(["u", "v"]).filter(pa.array(keep))

    return run


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, str]:
    """Those of the pairs (u, v) of ids whose full shingle sets are similar enough, stored."""
    with_v = pairs.join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("two")), "v")
    both = with_v.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("one")), "u")
    return stored(both.mapInArrow(_confirm(percent), "u bigint, v bigint"), "links")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = BAND_ROWS,
    sketch: bool = True,
) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the smallest id reached by links), kept. Without sketch,
    every pair that shares a bucket and isn't linked through it already is compared by its full sets.

    Defined results: a text without words, and null, has no shingles and no links; rows with a null id are linked with
    nothing, have no component and are kept; rows with the same id are one node of the graph; an empty table gives an empty
    result; further columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    src = columns_only(docs, **{id_col: "bigint", text_col: "string"}).toDF("doc_id", "text")
    schema = "doc_id bigint, n bigint, class binary, keys array<bigint>, " + ", ".join(f"{c} bigint" for c in BITS)
    sketches, sketch_path = stored(src.mapInArrow(_sketch(bands, rows, size), schema), "sketches")
    live = sketches.filter("n > 0 and doc_id is not null")
    # the smallest id stands for its class; minima are taken before the shuffle, so a large class is no bottleneck
    heads = live.groupBy("class").agg(F.min(F.struct("doc_id", "n", "keys", *BITS)).alias("rep"))
    heads, reps_path = stored(heads.select("rep.*"), "classes")
    bits = heads.select(F.col("doc_id").alias("rep"), *BITS)
    buckets = heads.select(F.col("doc_id").alias("rep"), "n", F.explode("keys").alias("key"))
    heads = buckets.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("head"), F.count("*").alias("size")).filter("size > 1")
    shared, shared_path = stored(buckets.join(heads, "key").select("key", "rep", "n", "head", "size"), "buckets")
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    pairs = shared.filter(F.col("rep") != F.col("head.rep")).filter(fits(F.col("n"), F.col("head.n")))
    pairs = pairs.select(F.col("rep").alias("u"), F.col("head.rep").alias("v")).distinct().alias("p")
    pairs = pairs.join(bits.alias("a"), F.col("p.u") == F.col("a.rep")).join(bits.alias("b"), F.col("p.v") == F.col("b.rep")).filter(_alike("a", "b", percent, sketch))
    pairs, pairs_path = stored(pairs.select("u", "v").distinct(), "pairs")
    ends = pairs.select(F.col("u").alias("doc_id")).unionAll(pairs.select(F.col("v").alias("doc_id"))).distinct()
    sets, sets_path = full_sets(src, ends, size)
    links, links_path = confirmed(sets, pairs, percent)
    drop_path(spark, sets_path)
    members = live.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    several = live.groupBy("doc_id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("doc_id")
    same_id = live.select("doc_id", "class").join(several, "doc_id", "left_semi").join(members, "class").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    groups = connected_components(links.unionAll(same_id))
    open_, open_path = _open_members(shared, groups, bits)
    if not open_.isEmpty():
        sets, sets_path = full_sets(src, open_.select(F.col("rep").alias("doc_id")).distinct(), size)
        known, known_path = _reachable(open_, sets, percent)
        more, more_path = stored(_across_groups(known, fits, percent, sketch), "pairs")
        found, found_path = confirmed(sets, more, percent)
        groups = connected_components(groups.unionAll(found))
        for path in (sets_path, known_path, more_path, found_path):
            drop_path(spark, path)
    group_of = members.join(groups.select(F.col("u").alias("rep"), F.col("v").alias("group_id")), "rep", "left")
    group_of = group_of.filter("copies > 1 or group_id is not null").select("class", F.coalesce("group_id", "rep").alias("component"))
    out = sketches.select("doc_id", "n", "class").join(group_of, "class", "left")
    component = F.when(F.col("n") > 0, F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))).otherwise(F.col("doc_id"))
    for path in (shared_path, pairs_path, reps_path, links_path, open_path):
        drop_path(spark, path)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _by_bucket(rows: DataFrame, buckets: DataFrame, how: str) -> DataFrame:
    """rows (key, rep, ...) joined with few buckets, one row for each key. A bucket's rows are dealt to SALTS places, at each
    of which its row is, so a large bucket is not one task's."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    spread = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["key", "salt"], how).drop("salt")


def _open_members(shared: DataFrame, groups: DataFrame, bits: DataFrame) -> tuple[DataFrame, str]:
    """Members of those buckets of three or more whose members lie in different groups, without each bucket's smallest."""
    placed = shared.filter("size > 2").join(groups.select(F.col("u").alias("rep"), F.col("v").alias("grp")), "rep", "left")
    placed = placed.select("key", "rep", "n", F.col("head.rep").alias("head"), F.coalesce("grp", "rep").alias("grp"))
    mixed = placed.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo <> hi").select("key")
    return stored(_by_bucket(placed, mixed, "left_semi").filter("rep <> head").join(bits, "rep"), "open")


def _reachable(open_: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """Open members that can be similar enough to any other, with m (their shingles that others have too) and keys (their
    buckets), stored.

    A shingle that no other open member has is in no intersection. With n shingles, of which m are in other sets too, a pair
    can reach the threshold only if (100 + percent) * min(m) >= percent * sum(n): this bound leaves few pairs of a group of
    loose copies, in which each has changes of its own.
    """
    each = sets.select("doc_id", F.explode("shingles").alias("shingle"))
    own = each.groupBy("shingle").agg(F.count("*").alias("times"), F.min("doc_id").alias("rep")).filter("times = 1")
    own = own.groupBy("rep").agg(F.count("*").alias("unshared"))
    known = open_.join(own, "rep", "left").withColumn("m", F.col("n") - F.coalesce("unshared", F.lit(0))).drop("unshared")
    known = known.filter((100 + percent) * F.col("m") >= percent * (F.col("n") + F.ceil(F.col("n") * percent / 100)))
    keys = known.groupBy("rep").agg(F.collect_set("key").alias("keys"))  # as many as there are bands at most
    return stored(known.join(keys, "rep"), "reachable")


def _across_groups(known: DataFrame, fits, percent: int, sketch: bool) -> DataFrame:  # noqa: ANN001
    """Pairs of open members that share a bucket, lie in different groups, and can be similar enough."""
    # a bucket of several blocks: the rows of each meet those of it and of all later ones, each two blocks in a place of their own
    large = known.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK_ROWS)
    blocks = F.ceil(F.coalesce("size", F.lit(1)) / BLOCK_ROWS).cast("int")
    dealt = _by_bucket(known, large, "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    a = dealt.withColumn("other", F.explode(F.sequence("own", F.col("blocks") - 1))).alias("a")
    b = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), "own"))).alias("b")
    place = (F.col("a.key") == F.col("b.key")) & (F.col("a.own") == F.col("b.other")) & (F.col("a.other") == F.col("b.own"))
    reach = (100 + percent) * F.least("a.m", "b.m") >= percent * (F.col("a.n") + F.col("b.n"))
    new = ((F.col("a.own") < F.col("b.own")) | (F.col("a.rep") > F.col("b.rep"))) & (F.col("a.grp") != F.col("b.grp"))
    once = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.key")  # of the buckets that a pair shares, in one
    met = a.join(b, place & new & reach & fits(F.col("a.n"), F.col("b.n")) & _alike("a", "b", percent, sketch) & once)
    return met.select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))
