"""The leak audit: what redaction rules still find, without ever telling the text.

A line is asked for each rule on its own, as it stands, so no rule hides behind
another. Rules, labels and runs of capitals are tested in DataFrame functions.
Only lines that show something, or that may hold a listed or swept value, go to
Python, where entries are matched and form vocabulary is told from names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import CAPS_BLOB, CAPS_RUN, NAME_LABEL, NAME_LEFT, RULES, SHADOW_KINDS, SIG_LABEL_STRICT, STAMP_LEFT, TOKEN, Rule, compiled, for_java
from ..functions.text import shadow, touchable
from ..functions.words import telling
from .dictionary import Entry, NameParts
from .fold import Values, may_hold, with_listed
from .keys import SHIPPED

RESULT = "doc_ord bigint, line_no int, reasons array<string>, name_left boolean"
NONE = "array<string>"
#: CAPS_RUN and CAPS_BLOB begin so.
RUN_START = r"[A-Z][A-Z&'.\-]"


def _broken(line: Column, r: Rule, ocr: bool) -> Column:
    """Whether a rule finds something on a line."""
    told = line.rlike(for_java(r.pattern, r.any_case, ocr))
    if ocr and r.kind in SHADOW_KINDS:
        told = told | shadow(line).rlike(for_java(r.pattern, r.any_case))
    if r.gate:
        told = line.rlike(for_java(r.gate, True, ocr)) & told
    return told & ~line.rlike(for_java(r.unless, True, ocr)) if r.unless else told


def rule_reasons(line: Column, ocr: Column, signatures: bool = True) -> Column:
    """The reasons for which the pattern rules fail a line, sorted."""

    def of(loose: bool) -> Column:
        own = {(r.reason, r.pattern, r.any_case, r.gate, r.unless): r for r in RULES if loose or not r.ocr_only}
        told = F.array_compact(F.array(*(F.when(_broken(line, r, loose), r.reason) for r in own.values())))
        out = F.when(touchable(line), told).otherwise(F.array().cast(NONE))
        stamp = F.when(line.contains(":") & line.rlike(for_java(SIG_LABEL_STRICT, True, loose)), F.array(F.lit(STAMP_LEFT))).otherwise(F.array().cast(NONE))
        return F.concat(out, stamp) if signatures else out

    return F.array_sort(F.array_distinct(F.when(ocr, of(True)).otherwise(of(False))))


def capitals(line: Column, ocr: Column) -> Column:
    """The words of runs of capitals on a line with a name's label; none on others. Tokens aren't words. Labels are looked for
    only where a run may begin."""
    bare = F.regexp_replace(line, for_java(TOKEN), " ")
    every = lambda pattern: F.regexp_extract_all(bare, F.lit(for_java(pattern)), F.lit(0))
    runs = F.when(ocr, F.concat(every(CAPS_RUN), every(CAPS_BLOB))).otherwise(every(CAPS_RUN))
    labelled = F.when(ocr, bare.rlike(for_java(NAME_LABEL, True, True))).otherwise(bare.rlike(for_java(NAME_LABEL, True)))
    return F.when(line.rlike(RUN_START) & labelled, F.flatten(F.transform(runs, lambda r: F.split(r, r"(?U)\s+")))).otherwise(F.array().cast(NONE))


def audit(lines: DataFrame, entries: Sequence[Entry] = (), names: Sequence[NameParts] = (), signatures: bool = True, values: Values | None = None) -> DataFrame:
    """doc_ord, line_no, severity, reason of what lines (doc_ord, line_no, line, is_ocr, and if there are any sweeps) show.
    line_no counts from 1 here, as people count lines. Lines that begin with # are an extract's header. values: entries, names
    and swept values that go to every task."""
    values = values or Values()
    extra = ["sweeps"] * ("sweeps" in lines.columns)
    shaped = lines.withColumns({"doc_ord": F.col("doc_ord").cast("bigint"), "line_no": F.col("line_no").cast("int"), "is_ocr": F.coalesce("is_ocr", F.lit(False))}).select("doc_ord", "line_no", "line", "is_ocr", *extra)
    text = shaped.filter(F.col("line").isNotNull() & ~F.startswith(F.col("line"), F.lit("#")))
    if len(entries) + len(names) <= SHIPPED:
        values = Values([*values.entries, *entries], [*values.names, *names], values.sweeps, values.sweep_keys)
    else:
        text, extra = with_listed(text, entries, names), [*extra, "listed", "split"]
    line, ocr = F.col("line"), F.col("is_ocr")
    held = may_hold(line, ocr, values)
    for c in extra:
        held = held | (F.coalesce(F.size(c), F.lit(0)) > 0)
    # asked first, as it tells most lines: a rule's, a run of capitals' or a label's characters
    shows = touchable(line) | line.rlike(RUN_START)
    if signatures:
        shows = shows | line.contains(":")
    tested = text.filter(shows | held).withColumn("x", F.struct(rule_reasons(line, ocr, signatures).alias("found"), capitals(line, ocr).alias("caps")))
    ask = (F.size("x.found") > 0) | (F.size("x.caps") > 0) | held
    if values.sweeps:  # swept values come from patterns
        ask = ask | touchable(line)
    shipped = lines.sparkSession.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        known.file()
        for b in batches:
            rows = b.to_pydict()
            why, left = [], []
            for i, (text, ocr) in enumerate(zip(rows["line"], rows["is_ocr"], strict=True)):
                own = lambda c: rows[c][i] or () if c in rows else ()  # noqa: B023, E731
                listed, parts, swept = known.on(text, ocr)
                out = set(rows["found"][i])
                out |= {f"[LIST:{e.category}]" for _, e in listed if compiled(e.pattern, e.any_case, ocr).search(text)}
                out |= {f"[LIST:{e['category']}]" for e in own("listed") if compiled(e["pattern"], e["any_case"], ocr).search(text)}
                if any(p.both_in(text, ocr) for p in [*parts, *(NameParts(p["canonical"], (p["first"], p["last"])) for p in own("split"))]):
                    out.add("[LIST:name]")
                out |= {f"[SWEEP:{kind}]" for kind, _, pattern in [*swept, *(tuple(s.values()) for s in own("sweeps"))] if compiled(pattern, True, ocr).search(text)}
                why.append(sorted(out))
                left.append(bool(telling(rows["caps"][i])))
            yield pa.RecordBatch.from_arrays([b.column("doc_ord"), b.column("line_no"), pa.array(why, pa.list_(pa.string())), pa.array(left, pa.bool_())], ["doc_ord", "line_no", "reasons", "name_left"])

    told = tested.filter(ask).select("doc_ord", "line_no", "line", "is_ocr", "x.found", "x.caps", *extra).mapInArrow(run, RESULT)
    fails = F.transform("reasons", lambda r: F.struct(F.lit("FAIL").alias("severity"), r.alias("reason")))
    warns = F.when(F.col("name_left"), F.array(F.struct(F.lit("WARN").alias("severity"), F.lit(NAME_LEFT).alias("reason")))).otherwise(F.array().cast("array<struct<severity:string,reason:string>>"))
    return told.select("doc_ord", (F.col("line_no") + 1).alias("line_no"), F.explode(F.concat(fails, warns)).alias("x")).select("doc_ord", "line_no", "x.severity", "x.reason")


def failing_documents(audited: DataFrame) -> DataFrame:
    return audited.filter("severity = 'FAIL'").select("doc_ord").distinct()


def audit_counts(audited: DataFrame) -> DataFrame:
    """severity, reason, n_lines, n_docs of an audit's result; nothing of the text."""
    return audited.groupBy("severity", "reason").agg(F.count("*").alias("n_lines"), F.countDistinct("doc_ord").alias("n_docs"))


def audit_extracts(extracts: DataFrame, entries: Sequence[Entry] = (), names: Sequence[NameParts] = (), signatures: bool = True) -> DataFrame:
    """The audit of written extracts (doc_ord, text), without a sweep. Whether one comes from OCR is read from its header, and
    text that was read back from elsewhere than an extract (is_ocr true, if there is that column) is held to the OCR rules."""
    from ..sources.lines import explode_lines, is_ocr_extract

    ocr = is_ocr_extract(F.col("text"))
    if "is_ocr" in extracts.columns:
        ocr = ocr | F.coalesce("is_ocr", F.lit(False))
    sniffed = extracts.select("doc_ord", "text", ocr.alias("ocr"))
    return audit(explode_lines(sniffed, "doc_ord", "text", "ocr"), entries, names, signatures)
