"""The shared folder: results written once and read again, which survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: This process's folders, by root. What operators leave there is read by lazy results, so it goes at the end.
_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Folders still there when the driver's JVM
    ends are deleted with it, or earlier by release()."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
        root = tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    if root not in _FOLDERS:
        _FOLDERS[root] = f"{root.rstrip('/')}/maskwright/{uuid.uuid4().hex}"
        p = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS[root])
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{_FOLDERS[root]}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table", codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete all that this process's operators have left in the shared folder. Results that weren't written are lost."""
    for root in list(_FOLDERS):
        drop_path(spark, _FOLDERS.pop(root))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a bigint column `name`, the number of each row in an order, from 1. Rows are sorted in ranges; what comes to the
    driver is one count for each range."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the low 33 bits of this number count a partition's rows
    placed, _ = stored(dealt.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    sizes = dict(placed.groupBy(part.alias("part")).count().collect())
    before, run = [], 0
    for k in sorted(sizes):
        before += [F.lit(k), F.lit(run).cast("bigint")]
        run += sizes[k]
    if not run:
        return placed.select(*df.columns, F.lit(None).cast("bigint").alias(name))
    start = F.element_at(F.create_map(*before), part)
    return placed.select(*df.columns, (start + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))
