"""Exact deduplication by content sort, in DataFrame functions only.

Normalised texts (white space deleted) are put in content order: sampled
splitters, which share out bytes rather than rows, deal the rows into ranges,
each range is one partition and is sorted externally, and each row is compared
in full with the one before it. The range key is (first characters, digest,
id): equal texts stay adjacent, and a large group of copies is cut into several
ranges by its ids. A run can be cut only at a splitter, so a range has at most
two pieces of cut runs, at its ends; pieces with the same text, compared in
full, are put together, and their totals come back by a broadcast of at most
two rows of numbers for each range.

Defined results: a null text is empty, and empty texts are equal to each
other; a null id sorts before all others; repeated rows are rows of their own;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_only

#: Characters deleted before comparison: space, TAB, LF, VT, FF, CR.
BLANKS = " \t\n\u000b\f\r"
PREFIX = 16
#: What a row takes besides its text.
ROW_BYTES = 200
#: Rows sampled for each range, and at most in all; but always LEAST_SAMPLES for each range.
SAMPLES_PER_RANGE, SAMPLES, LEAST_SAMPLES = 60, 200_000, 10


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _keyed(src: DataFrame, along: Sequence[str] = ()) -> DataFrame:
    """Rows (doc_id, text) with what they are compared by."""
    norm = normalised(F.col("text"))
    row_id = F.coalesce("doc_id", F.lit(-(2**63)))
    found = src.select("doc_id", row_id.alias("row_id"), norm.alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).alias("points"), *along)
    return found.withColumns({"prefix": F.substring("norm", 1, PREFIX), "digest": F.sha2(F.col("norm").cast("binary"), 256)})


def _splitters(src: DataFrame, ranges: int) -> list[tuple]:
    """At most ranges - 1 splitters out of a random sample whose mean size is bounded, with about the same number of bytes
    between them. Only splitters are taken from the sample; all rows are dealt."""
    wanted = max(LEAST_SAMPLES * ranges, min(SAMPLES_PER_RANGE * ranges, SAMPLES))
    share = min(1.0, 1.2 * wanted / max(src.select("doc_id").count(), 1))
    sample = _keyed(src if share >= 1 else src.sample(share, seed=7))
    got = sorted(tuple(r) for r in sample.select("prefix", "digest", "row_id", (F.octet_length("norm") + ROW_BYTES).alias("bytes")).collect())
    left, size = sum(r[3] for r in got), 0
    cuts: list[tuple] = []
    for *key, n in got:
        # a range ends before the row that brings it further from an even share of what is left
        if size and size + n / 2 > left / (ranges - len(cuts)) and len(cuts) < ranges - 1 and (not cuts or cuts[-1] < tuple(key)):
            cuts.append(tuple(key))
            left, size = left - size, 0
        size += n
    return cuts


def _table(cuts: list[tuple]) -> Column:
    """The splitters as one literal."""
    return F.from_json(F.lit(json.dumps([{"p": p, "d": d, "i": i} for p, d, i in cuts])), "array<struct<p:string,d:string,i:bigint>>")


def _range_of(cuts: list[tuple], key: list[Column]) -> Column:
    """How many splitters are not above the key, by binary search."""
    if not cuts:
        return F.lit(0)
    table, n, steps = _table(cuts), len(cuts), [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def advance(acc: Column, step: Column) -> Column:
        to = acc + step
        c = F.try_element_at(table, F.least(to, F.lit(n)))
        not_above = (c["p"] < key[0]) | ((c["p"] == key[0]) & ((c["d"] < key[1]) | ((c["d"] == key[1]) & (c["i"] <= key[2]))))
        return F.when((to <= n) & not_above, to).otherwise(acc)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), advance)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256. With keep, the text and the columns of docs
    that it names are there too; of each group kept is true in exactly one row.

    Of equal texts the one with the most code points in its original text stays,
    then the smallest id.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = columns_only(docs, **{id_col: "bigint", text_col: "string"}).toDF("doc_id", "text")
    cuts = _splitters(src, ranges)
    along = ["text", "row"] if keep else []  # what goes along with a row
    if keep:
        src = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"))
    keyed = _keyed(src, along)
    dealt = keyed.withColumn("range", _range_of(cuts, [F.col("prefix"), F.col("digest"), F.col("row_id")]))
    if keep:  # one of the two texts is dealt, and the other made from it
        dealt = dealt.drop("norm").repartitionById(ranges, F.col("range")).withColumn("norm", normalised(F.col("text")))
    else:
        dealt = dealt.repartitionById(ranges, F.col("range"))
    order = W.partitionBy("range").orderBy("prefix", "digest", "norm", F.desc("points"), "row_id")
    at_cut = F.lit(False)
    if cuts:
        digest_of = lambda nth: F.coalesce(F.try_element_at(_table(cuts), nth)["d"] == F.col("digest"), F.lit(False))
        at_cut = F.when(F.col("range") > 0, digest_of(F.greatest("range", F.lit(1)))).otherwise(False) | digest_of(F.col("range") + 1)
    # neighbours: equal in full, or a new run begins; from here on only the texts of runs that may be cut go along
    fresh = F.coalesce(F.col("norm") != F.lag("norm").over(order), F.lit(True))
    placed = dealt.select("range", "doc_id", "row_id", "points", "digest", F.row_number().over(order).alias("seq"), fresh.alias("fresh"), F.when(fresh & at_cut, F.col("norm")).alias("edge"), *along)
    runs = placed.withColumn("run", F.sum(F.col("fresh").cast("int")).over(W.partitionBy("range").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))
    within = W.partitionBy("range", "run").orderBy("seq")
    runs = runs.select(
        "range", "run", "doc_id", "digest", "edge",
        F.first("doc_id").over(within).alias("best_id"), F.first("row_id").over(within).alias("best_row"), F.first("points").over(within).alias("best_points"),
        F.count(F.lit(1)).over(W.partitionBy("range", "run")).alias("n"),
        F.row_number().over(within).alias("nth"), *along,
    )
    more = ["text", "row.*"] if keep else []
    if not cuts:
        return _result(runs.select("doc_id", "digest", F.col("best_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("nth") == 1).alias("kept"), *along), more)
    same = W.partitionBy("digest", "edge")
    # with this column the pieces ask for the same columns as the join below, so both read one shuffle
    found = (F.xxhash64("row") if keep else F.lit(1)).alias("found")
    best = F.struct((-F.col("best_points")).alias("p"), F.col("best_row").alias("r"), F.col("range").alias("at"), F.col("best_id").alias("i"))
    pieces = runs.filter(F.col("edge").isNotNull()).select(F.col("range").alias("at"), F.col("run").alias("piece"), F.sum("n").over(same).alias("all_n"), F.min(best).over(same).alias("best"), found)
    joined = runs.join(F.broadcast(pieces), (F.col("range") == F.col("at")) & (F.col("run") == F.col("piece")), "left")
    cut = F.col("found").isNotNull()
    own = (F.col("nth") == 1) & F.when(cut, F.col("best.at") == F.col("range")).otherwise(True)
    return _result(joined.select("doc_id", "digest", F.when(cut, F.col("best.i")).otherwise(F.col("best_id")).alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"), own.alias("kept"), *along), more)


def _result(df: DataFrame, more: Sequence[str]) -> DataFrame:
    return df.select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), "kept", F.col("digest").alias("text_sha256"), *more)
