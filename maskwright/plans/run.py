"""A redaction run over a corpus: candidates, two passes, findings, audit, and what is kept.

Pass one finds values by pattern; pass two replaces each of them wherever else
it stands, and numbers the tokens anew. Of the folded lines those that something
may touch, a small part of most corpora, are stored once in the shared folder;
hits, tokens, rendered lines and the audit are read from them. As they hold raw
text, the folder is emptied when the driver ends, or by store.release().
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import CERT_TITLE, DOCUSIGN_ID, ESIGN_HEADER, SIG_LABEL, SIG_LABEL_STRICT, SIG_MENTION, for_java
from ..operators import audit as auditing
from ..operators import fold as folding
from ..operators import mining
from ..operators import sweep as sweeping
from ..operators import tokens as numbering
from ..operators.dictionary import Entry, longest_first, make_entries, name_parts
from ..sources.store import stored


@dataclass(frozen=True)
class RunConfig:
    """What can be chosen for a run.

    sweep: replace found values everywhere. signatures: treat signature areas and stamps. ocr: use text from OCR.
    keep_certificate: keep the pages of an e-signed document's certificate. mine: look for candidate entries, and use them in
    the same run. preview: write nothing. store: a folder for the folded lines (else one below the shared folder).

    What else can be chosen is which functions are called: sources.files.lists_for (the lists, with or without a master list),
    sources.lines.with_fields (form fields), layout.span_boxes (boxes for redacted pages), report.report_text, run.inspect
    and audit.audit_extracts.
    """

    sweep: bool = True
    signatures: bool = True
    ocr: bool = True
    keep_certificate: bool = False
    mine: bool = False
    preview: bool = False
    store: str | None = None


@dataclass(frozen=True)
class Run:
    lines: DataFrame  # doc_ord, line_no, is_ocr, line, redacted
    hits: DataFrame  # one row for each replacement, with its token
    tokens: DataFrame  # kind, norm, n, number, token
    findings: DataFrame  # doc_ord, reason, original, token, n
    audit: DataFrame  # doc_ord, line_no, severity, reason
    sweeps: DataFrame | None
    entries: tuple[Entry, ...] = ()
    candidates: DataFrame | None = None


def listed_ssns(entries: Sequence[Entry]) -> tuple[str, ...]:
    digits = {re.sub(r"\D", "", e.canonical) for e in entries if e.category == "ssn"}
    return tuple(sorted(d for d in digits if len(d) == 9))


def with_candidates(lines: DataFrame, entries: Sequence[Entry], seen: DataFrame | None = None) -> tuple[list[Entry], DataFrame]:
    """The entries with the candidates that lines give, and those, stored. Candidates are as many as a person reads through."""
    found, _ = stored(mining.suggest(lines, entries, seen), "candidates")
    rows = found.orderBy("doc_ord", "line_no", "place").select("category", "value").collect()
    return longest_first([*entries, *make_entries((r.category, r.value) for r in rows)]), found


def redact(lines: DataFrame, entries: Sequence[Entry] = (), presets: DataFrame | None = None, regions: DataFrame | None = None, config: RunConfig | None = None, seen: DataFrame | None = None) -> Run:
    """lines: doc_ord, line_no, line, is_ocr. presets: doc_ord, line_no, start, end, key of text in signature regions;
    regions: doc_ord, page_no, n, key of all regions, which are numbered before any line; seen: norm of listed values that are
    no candidates again, active or commented out."""
    config = config or RunConfig()
    spark = lines.sparkSession
    src = lines.select("doc_ord", "line_no", "line", "is_ocr")
    if not config.ocr:
        src = src.filter("not coalesce(is_ocr, false)")
    candidates = None
    if config.mine:
        entries, candidates = with_candidates(src, entries, seen)
    names, ssns = name_parts(entries), listed_ssns(entries)
    if presets is not None and config.signatures:
        rows = presets.groupBy("doc_ord", "line_no").agg(F.array_sort(F.collect_list(F.struct("start", "end", "key"))).alias("presets"))
        src = src.join(rows, ["doc_ord", "line_no"], "left")
    sweeps, known, values = None, None, None
    asked, rest, shipped = folding.parted(src, entries, names)
    if config.sweep:
        asked, _ = stored(asked, "asked")
        first, _ = stored(numbering.explode_hits(folding.fold_asked(asked, shipped)), "pass1")
        sweeps = sweeping.sweep_values(first, ssns)
        known = first.filter(F.col("reason").startswith("[PATTERN:"))
        values = sweeping.as_values(sweeps)
        if values is None:
            asked = sweeping.with_sweeps(asked, sweeps)
        else:
            shipped = replace(shipped, sweeps=values.sweeps, sweep_keys=values.sweep_keys)
    touched = folding.fold_asked(asked, shipped)
    if config.store:
        touched.write.mode("overwrite").parquet(config.store)
        touched = spark.read.schema(touched.schema).parquet(config.store)
    else:
        touched, _ = stored(touched, "folded")
    folded = touched.unionByName(folding.untouched(rest))
    hits = numbering.with_ssn_alias(numbering.explode_hits(touched), numbering.full_ssns(spark, ssns, known))
    blocks = region_hits(regions) if regions is not None and config.signatures else None
    tokens = numbering.token_table(hits.unionByName(blocks) if blocks is not None else hits)
    named = numbering.with_tokens(hits, tokens)
    counted = named
    if blocks is not None:
        bare = blocks.join(hits.filter("phase = 0").select("doc_ord", "norm").distinct(), ["doc_ord", "norm"], "left_anti")
        counted = named.unionByName(numbering.with_tokens(bare, tokens), allowMissingColumns=True)
    left = numbering.inert(folded)
    if sweeps is not None and values is None:
        left = sweeping.with_sweeps(left, sweeps)
    audited = auditing.audit(left, entries, names, config.signatures, values)
    return Run(numbering.render(folded, named), named, tokens, numbering.findings(counted), audited, sweeps, tuple(entries), candidates)


def preview(lines: DataFrame, entries: Sequence[Entry] = (), config: RunConfig | None = None) -> DataFrame:
    """The findings that a run would make; nothing is written for keeps."""
    return redact(lines, entries, config=replace(config or RunConfig(), preview=True)).findings


def finish(done: Run, path: str, config: RunConfig | None = None, names: DataFrame | None = None) -> DataFrame | None:
    """Write the extracts that pass the run's audit under path, and give value-free counts of the audit; with preview, nothing is
    written and nothing given. names: doc_ord, name."""
    from ..sources.files import extracts, write_extracts

    if (config or RunConfig()).preview:
        return None
    write_extracts(extracts(done.lines, names), done.audit, path)
    return auditing.audit_counts(done.audit)


def region_hits(regions: DataFrame) -> DataFrame:
    """Signature regions as hits that come before all lines of their documents."""
    from ..functions.text import token_value

    key = F.coalesce("key", F.concat(F.col("doc_ord").cast("string"), F.lit(" page "), F.col("page_no").cast("string"), F.lit(" #"), F.col("n").cast("string")))
    text = F.concat(F.lit("(signature block, page "), F.col("page_no").cast("string"), F.lit(")"))
    none = F.lit(None).cast("int")
    df = regions.select(
        "doc_ord", (F.col("page_no") - 1_000_000).cast("int").alias("line_no"), F.lit(False).alias("is_ocr"), F.col("n").cast("int").alias("nth"), F.lit(0).alias("phase"), F.col("n").cast("int").alias("ord"),
        F.lit("[SIGNATURE]").alias("reason"), F.lit("SIGNATURE").alias("kind"), text.alias("original"), key.alias("value"), none.alias("start"), none.alias("end"),
    )
    return df.withColumn("norm", token_value(F.col("kind"), F.col("value")))


# ------------------------------------------------------------ e-signed documents


def esigned(page_texts: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """doc_ord, esigned: whether a page's text (doc_ord, page_no, text) shows an e-signature service, or there are signature fields."""
    shows = F.col("text").rlike(for_java(ESIGN_HEADER, True)) | F.col("text").rlike(for_java(SIG_LABEL_STRICT, True)) | F.col("text").rlike(for_java(DOCUSIGN_ID))
    df = page_texts.groupBy("doc_ord").agg(F.bool_or(shows).alias("esigned"))
    if fields is None:
        return df
    return df.join(fields.select("doc_ord", F.lit(True).alias("field")).distinct(), "doc_ord", "left").select("doc_ord", (F.col("esigned") | F.coalesce("field", F.lit(False))).alias("esigned"))


def certificate_pages(page_texts: DataFrame) -> DataFrame:
    """doc_ord, first_page: the first page, but for a document's first, that is a certificate of completion."""
    titled = page_texts.filter((F.col("page_no") > 1) & F.col("text").rlike(for_java(CERT_TITLE, True)))
    return titled.groupBy("doc_ord").agg(F.min("page_no").alias("first_page"))


def without_certificate(pages: DataFrame, page_texts: DataFrame, config: RunConfig | None = None) -> DataFrame:
    """Rows of pages (doc_ord, page_no, ...) without an e-signed document's certificate and all pages after it, unless it is to
    be kept."""
    if config is not None and config.keep_certificate:
        return pages
    cut = certificate_pages(page_texts).join(esigned(page_texts).filter("esigned"), "doc_ord", "left_semi")
    return pages.join(cut, "doc_ord", "left").filter("first_page is null or page_no < first_page").drop("first_page")


def inspect(lines: DataFrame, marks: DataFrame, pages: DataFrame) -> DataFrame:
    """A page's structure in counts and sizes, without its text. lines: doc_ord, page_no, line; marks: doc_ord, page_no,
    kind, x0..; pages: doc_ord, page_no, width, height."""
    from ..operators.layout import MAX_GRAPHIC

    found = lambda pattern, any_case: F.sum(F.regexp_count("line", F.lit(for_java(pattern, any_case))))
    text = lines.groupBy("doc_ord", "page_no").agg(
        F.sum(F.length(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))).alias("n_chars"), found(SIG_LABEL_STRICT, True).alias("strict_labels"), found(SIG_LABEL, True).alias("labels"),
        found(DOCUSIGN_ID, False).alias("signer_ids"), F.sum(F.col("line").rlike(for_java(SIG_MENTION, True)).cast("bigint")).alias("mentions"),
    )
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    image = F.col("kind").contains("image")
    small = image & (w <= MAX_GRAPHIC[0] * F.col("width")) & (h <= MAX_GRAPHIC[1])
    size = F.concat_ws("x", F.round(w).cast("int").cast("string"), F.round(h).cast("int").cast("string"))
    drawn = marks.join(pages, ["doc_ord", "page_no"]).groupBy("doc_ord", "page_no").agg(
        F.sum(image.cast("bigint")).alias("images"), F.sum(F.col("kind").contains("path").cast("bigint")).alias("drawings"), F.array_sort(F.collect_set(F.when(small, size))).alias("small_images")
    )
    return pages.select("doc_ord", "page_no").join(text, ["doc_ord", "page_no"], "left").join(drawn, ["doc_ord", "page_no"], "left")
