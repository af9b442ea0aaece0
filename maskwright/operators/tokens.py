"""Token numbers: every identity gets the number of its first encounter.

First encounter is in order of (document, signature regions first, line, phase,
rule, place in the line). The smallest such key of each identity comes from one
aggregation; numbers are dense ranks. As a kind may have very many identities,
they aren't ranked in one window: documents are cut into ranges, identities
first met in a range are ranked in it, and the counts of the ranges before are
added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import token_value

RANGE_DOCS = 1_000_000


def explode_hits(folded: DataFrame) -> DataFrame:
    """A row for each hit: doc_ord, line_no, is_ocr, nth (its number in the line), the hit's fields, norm."""
    df = folded.filter(F.size("hits") > 0).select("doc_ord", "line_no", "is_ocr", F.posexplode("hits").alias("nth", "h")).select("doc_ord", "line_no", "is_ocr", "nth", "h.*")
    return df.withColumn("norm", token_value(F.col("kind"), F.col("value")))


def full_ssns(spark: SparkSession, listed: Sequence[str] = (), found: DataFrame | None = None) -> DataFrame:
    """last4, full: those last four digits that belong to one known full number. found: hits of kind SSN."""
    known = spark.createDataFrame([(s,) for s in listed if len(s) == 9], "full string")
    if found is not None:
        known = known.unionByName(found.filter("kind = 'SSN' and length(norm) = 9").select(F.col("norm").alias("full")))
    by = known.distinct().groupBy(F.substring("full", 6, 4).alias("last4")).agg(F.count("*").alias("n"), F.min("full").alias("full"))
    return by.filter("n = 1").select("last4", "full")


def with_ssn_alias(hits: DataFrame, ssns: DataFrame) -> DataFrame:
    """A masked number or bare tail is the full number it must belong to."""
    tail = F.when((F.col("kind") == "SSN") & (F.length("norm") == 4), F.col("norm"))
    joined = hits.withColumn("last4", tail).join(ssns, "last4", "left")
    return joined.withColumn("norm", F.coalesce("full", "norm")).drop("last4", "full")


def token_table(hits: DataFrame, range_docs: int = RANGE_DOCS) -> DataFrame:
    """kind, norm, n (hits), token of every identity."""
    region = F.when(F.col("phase") == 0, 0).otherwise(1)
    order = F.struct("doc_ord", region.alias("late"), "line_no", "phase", "ord", F.coalesce("start", F.lit(-1)).alias("start"), "nth")
    each = hits.groupBy("kind", "norm").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    each = each.withColumn("range", F.floor(F.col("first.doc_ord") / range_docs)).withColumn("last4", F.when(F.col("kind") == "ACCT", F.substring("norm", -4, 4)))
    group = ["kind", "last4"]
    placed = each.withColumn("place", F.row_number().over(W.partitionBy(*group, "range").orderBy("first")))
    sizes = each.groupBy(*group, "range").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy(*group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("kind").alias("k"), F.col("last4").alias("l"), F.col("range").alias("r"), before.alias("before"))
    same = (F.col("kind") == F.col("k")) & F.col("last4").eqNullSafe(F.col("l")) & (F.col("range") == F.col("r"))
    number = (F.col("place") + F.col("before")).cast("bigint")
    acct = F.concat(F.when(number == 1, "[ACCT-...").otherwise(F.concat(F.lit("[ACCT-"), number.cast("string"), F.lit("-..."))), F.col("last4"), F.lit("]"))
    plain = F.concat(F.lit("["), F.col("kind"), F.lit("-"), number.cast("string"), F.lit("]"))
    numbered = placed.join(sizes, same).withColumn("token", F.when(F.col("kind") == "ACCT", acct).otherwise(plain))
    return numbered.select("kind", "norm", "n", number.alias("number"), "token")


def with_tokens(hits: DataFrame, tokens: DataFrame) -> DataFrame:
    return hits.join(tokens.select("kind", "norm", "token"), ["kind", "norm"])


def render(folded: DataFrame, named: DataFrame) -> DataFrame:
    """Lines with their tokens: doc_ord, line_no, is_ocr, line, redacted. named: hits with tokens."""
    lists = named.groupBy("doc_ord", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("nth", "token"))).alias("tokens"))
    text = F.array_join(F.transform("pieces", lambda p: F.coalesce(p["lit"], F.element_at("tokens", p["hit"]))), "")
    changed = folded.filter(F.size("hits") > 0).join(lists, ["doc_ord", "line_no"]).select("doc_ord", "line_no", "is_ocr", "line", text.alias("redacted"))
    same = folded.filter(F.size("hits") == 0).select("doc_ord", "line_no", "is_ocr", "line", F.col("line").alias("redacted"))
    return changed.unionByName(same)


def inert_text() -> Column:
    """A folded line with digit-free placeholders."""
    mark = F.transform("pieces", lambda p: F.coalesce(p["lit"], F.concat(F.lit("["), F.element_at(F.transform("hits", lambda h: h["kind"]), p["hit"] + 1), F.lit("-Z]"))))
    return F.when(F.size("hits") == 0, F.col("line")).otherwise(F.array_join(mark, ""))


def inert(folded: DataFrame) -> DataFrame:
    """Lines with digit-free placeholders, which an audit reads: doc_ord, line_no, line, is_ocr."""
    return folded.select("doc_ord", "line_no", inert_text().alias("line"), "is_ocr")


def findings(named: DataFrame) -> DataFrame:
    """doc_ord, reason, original, token, n."""
    return named.groupBy("doc_ord", "reason", "original", "token").agg(F.count("*").alias("n"))
