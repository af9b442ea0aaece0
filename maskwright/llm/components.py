"""Connected components of a table of links, without gathering links anywhere.

Each round first runs union-find inside every partition, which leaves a forest
of at most one link for each node there, and then a large-star and a
small-star step over the whole table (Kiveris et al., 2014). Rounds are stored
in the shared folder. A node with very many links is no bottleneck: minima are
pre-aggregated, and links meet them in a join whose partitions can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, stored

LINKS = "u bigint, v bigint"


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find with path halving over the links of a partition: (node, smallest node reached)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.setdefault(x, x)) != x:
            root[x] = p = root[p]
            x = p
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            a, c = find(u), find(v)
            if a != c:
                root[max(a, c)] = min(a, c)
    got = np.array([(x, find(x)) for x in root], np.int64).reshape(-1, 2)
    got = got[got[:, 0] != got[:, 1]]
    for at in range(0, len(got), 100_000):
        part = got[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["u", "v"])


def _smallest(links: DataFrame) -> DataFrame:
    """For each u, the smallest of u and its neighbours."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(links: DataFrame) -> DataFrame:
    """(u, v): every node that has a link and isn't the smallest of its component, and that smallest node.

    Null ends are left out; links of a node to itself and repeated links change nothing; no links, no rows.
    """
    spark = links.sparkSession
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    now, path = stored(links.mapInArrow(local_forest, LINKS), "links")
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        small = large.join(_smallest(large), "u")
        small = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        after, after_path = stored(small.filter("u > v").distinct(), "links")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_path(spark, path)
        now, path = after, after_path
        if tuple(seen) == mark or not seen[0]:
            return now
        mark = tuple(seen)
