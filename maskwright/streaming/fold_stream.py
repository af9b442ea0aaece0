"""Folding lines as they arrive.

Each micro-batch is folded and its hits are stored under its number, so a batch
that is run again replaces what it wrote. Tokens need first encounters over
all batches, so they are numbered when the hits are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.dictionary import Entry, name_parts
from ..operators.fold import FOLDED, fold


def start(lines: DataFrame, path: str, checkpoint: str, entries: Sequence[Entry] = (), once: bool = False) -> StreamingQuery:
    """Fold a stream of lines (doc_ord, line_no, line, is_ocr) into path."""
    names = name_parts(entries)

    def batch(df: DataFrame, number: int) -> None:
        fold(df, entries, names).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def folded(spark: SparkSession, path: str) -> DataFrame:
    """All that was folded so far."""
    return spark.read.schema(FOLDED).parquet(path).select("doc_ord", "line_no", "line", "is_ocr", "pieces", "hits")
