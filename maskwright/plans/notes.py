"""What a run has to tell about its documents: (doc_ord, code, detail). Details hold numbers and categories, never values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import audit_counts
from ..operators.dictionary import Entry
from ..sources.lines import text_layer
from . import report, run

NOTE = "doc_ord bigint, code string, detail string"


def note(rows: DataFrame, code: str, detail: Column, doc: Column | None = None) -> DataFrame:
    return rows.select((F.col("doc_ord") if doc is None else doc).cast("bigint").alias("doc_ord"), F.lit(code).alias("code"), detail.cast("string").alias("detail"))


def of_run(rows: DataFrame, code: str, detail: Column) -> DataFrame:
    return note(rows, code, detail, F.lit(None))


def list_notes(rows: DataFrame, entries: Sequence[Entry], findings: DataFrame) -> DataFrame:
    """Unknown prefixes (by line), an empty dictionary, entries that were never matched (by category)."""
    spark = rows.sparkSession
    unknown = rows.filter("active and not known").groupBy().agg(F.array_join(F.array_sort(F.collect_list("line_no")), ", ").alias("at")).filter("at <> ''")
    empty = spark.createDataFrame([] if entries else [("no entries",)], "detail string")
    unused = report.unused_entries(entries, findings).groupBy("category").agg(F.count("*").alias("n")) if entries else None
    out = [of_run(unknown, "UNKNOWN LIST PREFIX", F.concat(F.lit("line(s) "), "at")), of_run(empty, "NO LIST ENTRIES", F.col("detail"))]
    if unused is not None:
        out.append(of_run(unused, "LIST ENTRY NEVER MATCHED", F.concat("category", F.lit(": "), F.col("n").cast("string"))))
    return reduce(DataFrame.unionByName, out)


def text_notes(drawn: DataFrame, recognised: DataFrame) -> DataFrame:
    """Documents that were read by OCR, and those that would need it and have too little text either way."""
    layer, read = text_layer(drawn), text_layer(recognised).select("doc_ord", F.col("has_text").alias("read"))
    poor = layer.filter("not has_text").join(read, "doc_ord", "left")
    code = F.when(F.coalesce("read", F.lit(False)), "OCR APPLIED").otherwise("NEEDS OCR")
    return poor.select("doc_ord", code.alias("code"), F.concat(F.col("n_chars").cast("string"), F.lit(" characters in the text layer")).alias("detail"))


def page_notes(page_texts: DataFrame, rotated: DataFrame | None = None, fields: DataFrame | None = None, missing: DataFrame | None = None) -> DataFrame:
    """Certificates dropped, rotations removed (rotated: doc_ord, page_no), fields merged (fields: doc_ord, value) and values that
    the text lacks (missing: doc_ord, n_missing)."""
    last = page_texts.groupBy("doc_ord").agg(F.max("page_no").alias("last"))
    cut = run.certificate_pages(page_texts).join(run.esigned(page_texts).filter("esigned"), "doc_ord", "left_semi").join(last, "doc_ord")
    out = [note(cut, "CERTIFICATE DROPPED", F.format_string("pages %d-%d", "first_page", "last"))]
    if rotated is not None:
        out.append(note(rotated.groupBy("doc_ord").agg(F.countDistinct("page_no").alias("n")), "ROTATION REMOVED", F.format_string("%d page(s)", "n")))
    if fields is not None:
        out.append(note(fields.groupBy("doc_ord").agg(F.count("*").alias("n")), "FLATTENED", F.format_string("%d field(s)", "n")))
    if missing is not None:
        out.append(note(missing.filter("n_missing > 0"), "FLATTEN INCOMPLETE", F.format_string("%d value(s) missing", "n_missing")))
    return reduce(DataFrame.unionByName, out)


def signature_notes(regions: DataFrame) -> DataFrame:
    """Stamps without an ID line, whose area is a default one."""
    return note(regions.filter("no_id"), "SIGNATURE", F.format_string("page %d: label without an ID line", "page_no"))


def audit_notes(audited: DataFrame) -> DataFrame:
    """Outputs that fail the run's own audit."""
    failing = audited.filter("severity = 'FAIL'").groupBy("doc_ord").agg(F.countDistinct("line_no").alias("n"))
    return note(failing, "SELF-CHECK FAILED", F.format_string("%d line(s)", "n"))


def single_file(docs: DataFrame) -> DataFrame:
    """A run over one document only: what it knows of the others' values is nothing."""
    one = docs.select("doc_ord").distinct().limit(2).groupBy().agg(F.count("*").alias("n")).filter("n = 1")
    return of_run(one, "SINGLE-FILE RUN", F.lit("values are swept through one document"))


def passed(audited: DataFrame) -> bool:
    """Whether an audit has no failing line: what a command's exit status says."""
    return audit_counts(audited).filter("severity = 'FAIL'").isEmpty()


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NOTE)
