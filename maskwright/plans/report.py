"""The preview report as relations, and as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dictionary import Entry


def totals(findings: DataFrame) -> DataFrame:
    """n_docs, n_pattern, n_list, n_all: planned replacements; whatever isn't from the dictionary counts as found by pattern."""
    listed = F.col("reason").startswith("[LIST")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0)).alias
    return findings.agg(F.countDistinct("doc_ord").alias("n_docs"), part(~listed)("n_pattern"), part(listed)("n_list"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"))


def by_reason(findings: DataFrame) -> DataFrame:
    """Totals of each document and reason, of each document (reason null), and of all (both null)."""
    return findings.rollup("doc_ord", "reason").agg(F.sum("n").alias("n"), F.countDistinct("token").alias("tokens"))


def report_lines(findings: DataFrame) -> DataFrame:
    """doc_ord, nth, text: a line for each finding, in the order in which a reader sees them."""
    from pyspark.sql import Window as W

    text = F.format_string("  %-18s %-42s -> %s  (%dx)", "reason", "original", "token", "n")
    return findings.select("doc_ord", F.row_number().over(W.partitionBy("doc_ord").orderBy("reason", "original", "token")).alias("nth"), text.alias("text"))


def unused_entries(entries: Sequence[Entry], findings: DataFrame) -> DataFrame:
    """category, value of entries that no finding comes from; a value that two categories list is used in both."""
    spark = findings.sparkSession
    own = spark.createDataFrame(sorted({(e.category, e.canonical) for e in entries}), "category string, value string")
    used = findings.filter(F.col("reason").startswith("[LIST")).select(F.col("original").alias("value")).distinct()
    return own.join(used, "value", "left_anti").select("category", "value")


def report_text(findings: DataFrame, names: dict[int, str] | None = None, most: int = 10_000) -> str:
    """The report of a run that is small enough to read: at most `most` findings, and a note on how many more there are."""
    rows = report_lines(findings).orderBy("doc_ord", "nth").limit(most).collect()
    out, doc = ["REDACTION PREVIEW"], None
    for r in rows:
        if r.doc_ord != doc:
            doc = r.doc_ord
            out += ["", f"== {(names or {}).get(doc, doc)} =="]
        out.append(r.text)
    t = totals(findings).first()
    left = findings.count() - len(rows)
    out += [f"({left} more findings)"] * (left > 0)
    return "\n".join([*out, "", "== SUMMARY ==", f"  {t.n_docs} file(s), {t.n_all} planned redaction(s) ({t.n_pattern} pattern, {t.n_list} list)"])
