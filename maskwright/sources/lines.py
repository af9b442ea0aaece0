"""Lines of documents: exploding, page stitching, routing by text layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patterns import MIN_TEXT_CHARS, OCR_NOTE, PAGE_SEP
from ..functions.text import split_lines


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ocr_col: str | None = None) -> DataFrame:
    """doc_ord, line_no (from 0), line, is_ocr of every line of every text. Documents are ordered by their ids."""
    ocr = F.col(ocr_col) if ocr_col else F.lit(False)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_ord"), ocr.alias("is_ocr"), F.posexplode(split_lines(F.col(text_col))).alias("line_no", "line")).select(
        "doc_ord", "line_no", "line", "is_ocr"
    )


def stitch_pages(pages: DataFrame) -> DataFrame:
    """Rows of page lines (doc_ord, page_no, page_line, line) -> doc_ord, line_no, page_no, page_line, line: in order, with a
    separator (page_line null) before every page of a document of several."""
    several = F.max("page_no").over(W.partitionBy("doc_ord")) != F.min("page_no").over(W.partitionBy("doc_ord"))
    marks = pages.groupBy("doc_ord", "page_no").agg(F.lit(1).alias("one")).withColumn("several", several).filter("several")
    before, after = PAGE_SEP.split("{n}")
    marks = marks.select("doc_ord", "page_no", F.lit(None).cast("bigint").alias("page_line"), F.concat(F.lit(before), F.col("page_no").cast("string"), F.lit(after)).alias("line"))
    both = pages.select("doc_ord", "page_no", F.col("page_line").cast("bigint").alias("page_line"), "line").unionByName(marks)
    nth = F.row_number().over(W.partitionBy("doc_ord").orderBy("page_no", F.col("page_line").asc_nulls_first())) - 1
    return both.select("doc_ord", nth.alias("line_no"), "page_no", "page_line", "line")


def join_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """doc_ord and the lines' text, joined in order. A document's text has to fit in a row, as it did before."""
    return lines.groupBy("doc_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def text_layer(lines: DataFrame) -> DataFrame:
    """doc_ord, n_chars (of lines without the blanks at their ends), has_text."""
    n = F.sum(F.length(F.regexp_replace("line", r"(?U)^\s+|\s+$", "")))
    return lines.groupBy("doc_ord").agg(n.cast("bigint").alias("n_chars")).withColumn("has_text", F.col("n_chars") >= MIN_TEXT_CHARS)


def route(drawn: DataFrame, recognised: DataFrame) -> DataFrame:
    """Lines of the text layer where a document has one, else those of OCR if they are enough; what neither has is left out.
    Both: doc_ord, line_no, line."""
    layer, read = text_layer(drawn).filter("has_text").select("doc_ord"), text_layer(recognised).filter("has_text").select("doc_ord")
    own = drawn.join(layer, "doc_ord", "left_semi").withColumn("is_ocr", F.lit(False))
    other = recognised.join(read, "doc_ord", "left_semi").join(layer, "doc_ord", "left_anti").withColumn("is_ocr", F.lit(True))
    return own.unionByName(other)


def is_ocr_extract(text: F.Column) -> F.Column:
    """Whether the first line of an extract says that it comes from OCR."""
    return F.coalesce(F.get(split_lines(text), F.lit(0)).contains(OCR_NOTE), F.lit(False))


def missing_values(values: DataFrame, texts: DataFrame) -> DataFrame:
    """How many field values (doc_ord, value) a document's text (doc_ord, text) lacks, white space aside: doc_ord, n_missing."""
    from ..functions.text import squeezed

    pairs = values.join(texts, "doc_ord")
    lacking = ~squeezed(F.col("text")).contains(squeezed(F.col("value")))
    return pairs.groupBy("doc_ord").agg(F.sum(lacking.cast("bigint")).alias("n_missing"))


def with_fields(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """Page lines (doc_ord, page_no, page_line, line) with the values of form fields (doc_ord, page_no, value) as further lines of
    their pages, in the order of the values."""
    from pyspark.sql import Window as W

    last = pages.groupBy("doc_ord", "page_no").agg(F.max("page_line").alias("last"))
    nth = F.row_number().over(W.partitionBy("doc_ord", "page_no").orderBy("value"))
    own = fields.filter("value is not null").join(last, ["doc_ord", "page_no"], "left").select(
        "doc_ord", "page_no", (F.coalesce("last", F.lit(-1)) + nth).cast("bigint").alias("page_line"), F.col("value").alias("line")
    )
    return pages.select("doc_ord", "page_no", F.col("page_line").cast("bigint").alias("page_line"), "line").unionByName(own)
