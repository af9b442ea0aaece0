"""op2's ranges: a large group of copies and long texts are spread, cut runs are put together, and one partition holds one range."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_contracts import frame

from maskwright.llm import exact_dedup as ed


def rows_with_a_hot_group() -> list[tuple[int, str]]:
    rnd = random.Random(3)
    words = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(n))
    hot = words(40)
    rows = [(i, hot + " " * (i % 3)) for i in range(400)] + [(1000 + i, words(rnd.randint(1, 60))) for i in range(700)] + [(5000 + i, words(4000)) for i in range(4)]
    rows += [(6000 + i, "x" + words(2)) for i in range(20)] * 2 + [(7000 + i, None) for i in range(30)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("ranges", [1, 2, 13, 64])
def test_groups_over_many_ranges(spark, ranges):
    rows = rows_with_a_hot_group()
    got = ed.exact_dedup(frame(spark, [(i, t, None, None, None, "", 0) for i, t in rows]), ranges=ranges).collect()
    groups: dict[str, list[tuple[int, int]]] = {}
    for i, t in rows:
        groups.setdefault((t or "").replace(" ", ""), []).append((-len(t or ""), i))
    want = []
    for norm, members in groups.items():
        first = min(members)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        kept = 0
        for m in sorted(members):
            want.append((m[1], first[1], len(members), m == first and not kept, sha))
            kept += m == first
    assert sorted(map(tuple, got)) == sorted(want)


def test_ranges_hold_about_the_same(spark):
    """Splitters share out bytes, however large a group of copies, and equal numbers of ranges and partitions meet one to one."""
    rows = [r for r in rows_with_a_hot_group() if len(r[1] or "") < 1000]
    src = frame(spark, [(i, t, None, None, None, "", 0) for i, t in rows]).select("doc_id", "text")
    cuts = ed._splitters(src, 12)
    assert len(cuts) == 11 and cuts == sorted(set(cuts))
    keyed = ed._keyed(src).withColumn("range", ed._range_of(cuts, [F.col("prefix"), F.col("digest"), F.col("row_id")]))
    size = F.sum(F.octet_length("norm") + ed.ROW_BYTES)
    by_range = {r[0]: r[1] for r in keyed.groupBy("range").agg(size).collect()}
    assert sorted(by_range) == list(range(12)) and max(by_range.values()) < 1.5 * sum(by_range.values()) / 12
    dealt = keyed.repartitionById(12, F.col("range")).withColumn("place", F.spark_partition_id())
    assert dealt.filter("place <> range").count() == 0
    plan = ed.exact_dedup(src, ranges=12)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_range_of_each_key_by_plain_search(spark):
    rnd = random.Random(5)
    keys = sorted({(rnd.choice(["", "a", "b", "é", '"\\', "\n"]), rnd.choice("xyz"), rnd.randint(-3, 3)) for _ in range(80)})
    cuts = sorted(rnd.sample(keys, 17))
    df = spark.createDataFrame(keys, "p string, d string, i bigint")
    got = {(r.p, r.d, r.i): r.n for r in df.withColumn("n", ed._range_of(cuts, [F.col("p"), F.col("d"), F.col("i")])).collect()}
    order = lambda k: (k[0].encode(), k[1].encode(), k[2])
    assert got == {k: sum(order(c) <= order(k) for c in cuts) for k in keys}
