"""A query for each operator, over the driver's tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_value, shadow, token_value, touchable
from ..operators import audit, dictionary, layout, mining, sweep, tokens
from ..operators.fold import fold, fold_parts, native_text
from ..sources.lines import explode_lines, join_lines, missing_values, read_table, route, stitch_pages, text_layer, with_fields
from ..sources.store import numbered, stored
from . import notes, report, run, statements

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _family(name: str) -> Query:
    def run_family(spark: SparkSession, sf_dir: str) -> DataFrame:
        folded = fold(statements.lines(read_table(spark, sf_dir, "customer"), "c_custkey", name))
        found = folded.select("doc_ord", F.array_join(F.transform("hits", lambda h: h["original"]), "|").alias("found"), F.size("hits").cast("bigint").alias("n_hits"))
        return tokens.inert(folded).join(found, "doc_ord").select(F.col("doc_ord").alias("k"), F.col("line").alias("text"), "found", "n_hits")

    return run_family


for _name in statements.FAMILIES:
    QUERIES[f"redact_{_name}"] = _family(_name)
    SQL[f"redact_{_name}"] = statements.oracle(_name)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(read_table(spark, sf_dir, "documents"))


_LINES = r"""
lines as (
  select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as line_no
  from (select doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) as l from documents where text <> ''))
"""
_W = r"[\p{L}\p{N}_"
_EMAIL = rf"{_W}.+-]+@{_W}-]+\.{_W}.-]+"
_PHONE = r"(\(?\d{3}\)?[-. ]\s?\d{3}[-. ]\d{4})(?:\D|$)"


@query(f"with {_LINES} select doc_id, cast(line_no as bigint) as line_no, line from lines")
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select(F.col("doc_ord").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no"), "line")


@query(f"with {_LINES} select doc_id, cast(sum(length(trim(line))) as bigint) as n_chars, sum(length(trim(line))) >= 20 as has_text from lines group by doc_id")
def text_layer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_layer(document_lines(spark, sf_dir)).withColumnRenamed("doc_ord", "doc_id")


def _corpus_hits(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Hits of these kinds. Texts and lines that can't have any are left out before they are cut and folded."""
    holds = (lambda text: text.contains("@")) if kinds == ("EMAIL",) else touchable
    docs = read_table(spark, sf_dir, "documents").filter(holds(F.col("text")))
    return tokens.explode_hits(fold(explode_lines(docs).filter(holds(F.col("line"))))).filter(F.col("kind").isin(*kinds))


def _hits(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = _corpus_hits(spark, sf_dir, kind)
    return found.select(F.col("doc_ord").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no"), F.col("original").alias("found"))


@query(f"with {_LINES} select doc_id, cast(line_no as bigint) as line_no, unnest(regexp_extract_all(line, '{_EMAIL}')) as found from lines where line like '%@%'")
def detect_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "EMAIL")


@query(f"with {_LINES} select doc_id, cast(line_no as bigint) as line_no, unnest(regexp_extract_all(line, '{_PHONE}', 1)) as found from lines")
def detect_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "PHONE")


_ACCT = rf"""with {_LINES},
left_over as (select doc_id, line_no, regexp_replace(regexp_replace(line, '{_EMAIL}', '[EMAIL-Z]', 'g'), '\(?\d{{3}}\)?[-. ]\s?\d{{3}}[-. ]\d{{4}}', '[PHONE-Z]', 'g') as line from lines),
spots as (select doc_id, line_no, line, unnest(generate_series(1, length(line))) as i from left_over where regexp_matches(line, '\d{{8}}'))
select doc_id, cast(line_no as bigint) as line_no, regexp_extract(substr(line, i), '^\d{{8,}}') as found
from spots
where regexp_matches(substr(line, i), '^\d{{8,}}') and not regexp_matches(substr(line, 1, i - 1), '(\d|\d\.|[^\w]\.|^\.)$')
  and not regexp_matches(regexp_replace(substr(line, i), '^\d+', ''), '^\s?%')"""


@query(_ACCT)
def detect_acct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "ACCT")


@query(f"""with {_LINES}, f as (
  select doc_id, '[PATTERN:EMAIL]' as reason, unnest(regexp_extract_all(line, '{_EMAIL}')) as original from lines where line like '%@%'
  union all select doc_id, '[PATTERN:PHONE]', unnest(regexp_extract_all(line, '{_PHONE}', 1)) from lines)
select doc_id, reason, original, count(*) as n from f group by all""")
def findings_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, _ = stored(_corpus_hits(spark, sf_dir, "EMAIL", "PHONE"), "hits")
    named = tokens.with_tokens(hits, tokens.token_table(hits))
    return tokens.findings(named).select(F.col("doc_ord").alias("doc_id"), "reason", "original", "n")


@query(f"""with {_LINES}, f as (
  select doc_id, line_no, regexp_extract_all(line, '{_EMAIL}') as l from lines where line like '%@%'),
e as (select upper(unnest(l)) as norm, doc_id, line_no, generate_subscripts(l, 1) as p from f),
one as (select norm, min((doc_id * 1000000 + line_no) * 1000 + p) as spot, count(*) as n from e group by norm)
select norm, n, '[EMAIL-' || cast(row_number() over (order by spot) as varchar) || ']' as token from one""")
def token_first_encounter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, _ = stored(_corpus_hits(spark, sf_dir, "EMAIL"), "hits")
    return tokens.token_table(hits, range_docs=100).select("norm", "n", "token")


# ---------------------------------------------------------------- token numbers


def _repeated(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select(F.col("k").alias("doc_ord"), F.lit(0).alias("line_no"), F.expr(line).alias("line"), F.lit(False).alias("is_ocr"))


def _named(lines: DataFrame, range_docs: int = 100) -> DataFrame:
    folded = fold(lines)
    hits = tokens.explode_hits(folded)
    return tokens.render(folded, tokens.with_tokens(hits, tokens.token_table(hits, range_docs)))


@query("""with l as (select c_custkey as k, (c_custkey * 37) % 97 as who from customer),
f as (select who, min(k) as first from l group by who), r as (select who, row_number() over (order by first) as n from f)
select k, 'SSN [SSN-' || cast(n as varchar) || '] ON FILE' as text from l join r using (who)""")
def token_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = "lpad(cast((k * 37) % 97 as string), 2, '0')"
    line = f"'SSN 123-' || case when k % 2 = 0 then {who} || '-' else {who} || '-' end || '4567 ON FILE'"
    return _named(_repeated(spark, sf_dir, line)).select(F.col("doc_ord").alias("k"), F.col("redacted").alias("text"))


@query("""with l as (select c_custkey as k, (c_custkey * 37) % 97 as who from customer),
f as (select who, min(k) as first from l group by who), r as (select who, who % 5 as tail, row_number() over (partition by who % 5 order by first) as n from f)
select k, 'REF ' || case when n = 1 then '[ACCT-...' else '[ACCT-' || cast(n as varchar) || '-...' end || '900' || cast(tail as varchar) || ']' as text from l join r using (who)""")
def acct_last4_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "'REF 11' || lpad(cast((k * 37) % 97 as string), 4, '0') || '900' || cast(((k * 37) % 97) % 5 as string)"
    return _named(_repeated(spark, sf_dir, line)).select(F.col("doc_ord").alias("k"), F.col("redacted").alias("text"))


_SSN_OF = "'12' || cast((k * 7) % 10 as {t}) || '-45-' || lpad(cast(1000 + (k * 7) % 60 as {t}), 4, '0')"


@query("""with l as (select c_custkey as k, (c_custkey * 7) % 60 as tail from customer),
full_ as (select distinct tail, '12' || cast((k * 7) % 10 as varchar) || '45' || cast(1000 + tail as varchar) as d from l where k % 2 = 0),
one as (select tail, min(d) as d from full_ group by tail having count(*) = 1)
select k, coalesce(case when k % 2 = 1 then one.d end, case when k % 2 = 0 then '12' || cast((k * 7) % 10 as varchar) || '45' || cast(1000 + tail as varchar) end, cast(1000 + tail as varchar)) as norm
from l left join one using (tail)""")
def ssn_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _SSN_OF.format(t="string")
    line = f"case when k % 2 = 0 then 'SSN ' || {full} else 'SSN XXX-XX-' || lpad(cast(1000 + (k * 7) % 60 as string), 4, '0') end"
    hits = tokens.explode_hits(fold(_repeated(spark, sf_dir, line)))
    return tokens.with_ssn_alias(hits, tokens.full_ssns(spark, (), hits)).select(F.col("doc_ord").alias("k"), "norm")


# ------------------------------------------------------------------- two passes


@query("""with l as (select c_custkey as k from customer), v as (select k, 'Z' || lpad(cast(k % 50 as varchar), 2, '0') || '-345' || lpad(cast(k % 50 as varchar), 3, '0') as v from l)
select k, case when k % 3 = 0 then 'Account No. [ACCT-Z]' when k % 50 in (select k % 50 from l where k % 3 = 0) then 'Statement for [ACCT-Z] continued' else 'Statement for ' || v || ' continued' end as text,
  case when k % 3 = 0 then '[PATTERN:ACCT]' when k % 50 in (select k % 50 from l where k % 3 = 0) then '[SWEEP:ACCT]' else '' end as reasons from v""")
def sweep_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = "'Z' || lpad(cast(k % 50 as string), 2, '0') || '-345' || lpad(cast(k % 50 as string), 3, '0')"
    lines = _repeated(spark, sf_dir, f"case when k % 3 = 0 then 'Account No. ' || {v} else 'Statement for ' || {v} || ' continued' end")
    swept = sweep.sweep_values(tokens.explode_hits(fold(lines)))
    folded = fold(sweep.with_sweeps(lines, swept))
    reasons = folded.select("doc_ord", F.array_join(F.transform("hits", lambda h: h["reason"]), ",").alias("reasons"))
    return tokens.inert(folded).join(reasons, "doc_ord").select(F.col("doc_ord").alias("k"), F.col("line").alias("text"), "reasons")


@query("""with l as (select c_custkey as k from customer)
select k, case when k % 2 = 0 then 'EMPLOYEE SSN [SSN-Z]' when k - 1 in (select k from l where k % 2 = 0) then 'COPY B FOR [SSN-Z] AND 90000-' || lpad(cast((k - 1) % 10000 as varchar), 4, '0')
  else 'COPY B FOR -' || lpad(cast((k - 1) % 10000 as varchar), 4, '0') || ' AND 90000-' || lpad(cast((k - 1) % 10000 as varchar), 4, '0') end as text from l""")
def ssn_tail_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = "lpad(cast((k - k % 2) % 10000 as string), 4, '0')"
    lines = _repeated(spark, sf_dir, f"case when k % 2 = 0 then 'EMPLOYEE SSN 987-65-' || {tail} else 'COPY B FOR -' || {tail} || ' AND 90000-' || {tail} end")
    out = run.redact(lines)
    return out.lines.select(F.col("doc_ord").alias("k"), F.regexp_replace("redacted", r"\[SSN-\d+\]", "[SSN-Z]").alias("text"))


@query("""select count(*) as n_docs, count(*) * 2 as n_pattern, count(*) as n_list, count(*) * 3 as n_all from customer""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _repeated(spark, sf_dir, f"'JOHN SAMPLE SSN ' || {statements._SSN} || ' call (555) 123-' || {statements.digits(4, 5)}")
    out = run.redact(lines, dictionary.make_entries([("name", "JOHN SAMPLE")]), config=run.RunConfig(sweep=False))
    return report.totals(out.findings)


@query("""select k as doc_ord, reason, n from (select c_custkey as k, unnest(['[LIST:name]', '[PATTERN:EIN]', null]) as reason, unnest([1, 2, 3]) as n from customer)
union all select null, r, c from (select '[LIST:name]' as r, count(*) as c from customer union all select '[PATTERN:EIN]', 2 * count(*) from customer union all select null, 3 * count(*) from customer) where r is null""")
def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _repeated(spark, sf_dir, "'JOHN SAMPLE EIN 12-3456789 EIN 98-7654321'")
    out = run.redact(lines, dictionary.make_entries([("name", "JOHN SAMPLE")]), config=run.RunConfig(sweep=False))
    return report.by_reason(out.findings).select("doc_ord", "reason", "n")


# -------------------------------------------------------------------- dictionary

_LISTED = [("name", "JOHN Q SAMPLE"), ("employer", "EXAMPLE WIDGETS INC"), ("addr", "1234 EXAMPLE STREET, SAMPLETOWN, CA 90000"), ("dob", "2 Jan 1980"), ("dob", "01/02/1980"), ("phone", "555-123-4567"), ("ssn", "987-65-4321"), ("acct", "AB 77")]


@query("""select c_custkey as k, case c_custkey % 8 when 0 then 'SAMPLE, JOHN Q' when 1 then 'JOHN SAMPLE' when 2 then 'Example  Widgets Inc' when 3 then '1234 EXAMPLE ST SAMPLETOWN CA 90000'
  when 4 then 'January 2, 1980' when 5 then '(555) 123.4567' when 6 then '987 65 4321' else 'ab 77' end as original_text,
  case c_custkey % 8 when 0 then 'NAME' when 1 then 'NAME' when 2 then 'EMPLOYER' when 3 then 'ADDR' when 4 then 'DOB' when 5 then 'PHONE' when 6 then 'SSN' else 'ACCT' end as kind,
  'of [' || case c_custkey % 8 when 0 then 'NAME' when 1 then 'NAME' when 2 then 'EMPLOYER' when 3 then 'ADDR' when 4 then 'DOB' when 5 then 'PHONE' when 6 then 'SSN' else 'ACCT' end || '-Z] here' as text from customer""")
def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = """case k % 8 when 0 then 'SAMPLE, JOHN Q' when 1 then 'JOHN SAMPLE' when 2 then 'Example  Widgets Inc' when 3 then '1234 EXAMPLE ST SAMPLETOWN CA 90000'
      when 4 then 'January 2, 1980' when 5 then '(555) 123.4567' when 6 then '987 65 4321' else 'ab 77' end"""
    lines = _repeated(spark, sf_dir, f"'of ' || {said} || ' here'")
    entries = dictionary.make_entries(_LISTED)
    folded = fold(lines, entries, dictionary.name_parts(entries))
    first = F.get("hits", F.lit(0))
    return folded.select(F.col("doc_ord").alias("k"), F.substring("line", first["start"] + 1, first["end"] - first["start"]).alias("original_text"), first["kind"].alias("kind")).join(
        tokens.inert(folded).select(F.col("doc_ord").alias("k"), F.col("line").alias("text")), "k"
    )


@query("""select c_custkey as k, v as variant from (select c_custkey, unnest(['ANNA' || cast(c_custkey as varchar) || ' B TEST', 'ANNA' || cast(c_custkey as varchar) || ' TEST',
  'TEST, ANNA' || cast(c_custkey as varchar) || ' B', 'TEST, ANNA' || cast(c_custkey as varchar)]) as v from customer)""")
def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("ANNA"), F.col("c_custkey").cast("string"), F.lit(" B TEST"))
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(dictionary.name_variants_column(name)).alias("variant"))


@query("""select k, unnest(case when k % 2 = 0 then [s || ', SAMPLETOWN, CA 90000', s, 'SAMPLETOWN, CA 90000'] else [s || ' SAMPLETOWN CA 90000', s, 'SAMPLETOWN CA 90000'] end) as variant
  from (select c_custkey as k, cast(c_custkey as varchar) || ' EXAMPLE STREET' as s from customer)""")
def addr_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = "cast(k as string) || ' EXAMPLE STREET'"
    value = F.expr(f"case when k % 2 = 0 then {s} || ', SAMPLETOWN, CA 90000' else {s} || ' SAMPLETOWN CA 90000' end")
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select("k", F.explode(dictionary.address_variants_column(value)).alias("variant"))


@query("""select c_custkey as k, case c_custkey % 3 when 0 then '[NAME-Z] & [NAME-Z]' when 1 then 'JOHN went out' else '[NAME-Z] / field / [NAME-Z]' end as text from customer""")
def split_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _repeated(spark, sf_dir, "case k % 3 when 0 then 'JOHN & JANE SAMPLE' when 1 then 'JOHN went out' else 'SAMPLE / field / JOHN' end")
    lines = lines.withColumn("line", F.when(F.col("doc_ord") % 3 == 0, F.lit("JOHN & MARY SAMPLE")).otherwise(F.col("line")))
    entries = dictionary.make_entries([("name", "JOHN SAMPLE"), ("name", "MARY Q SAMPLE")])
    return tokens.inert(fold(lines, entries, dictionary.name_parts(entries))).select(F.col("doc_ord").alias("k"), F.col("line").alias("text"))


@query("select 'employer' as category, 'NEVER SEEN LLC' as value union all select 'acct', 'QQ 1'")
def unused_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = dictionary.make_entries([("employer", "NEVER SEEN LLC"), ("acct", "QQ 1"), ("name", "JOHN SAMPLE")])
    out = run.redact(_repeated(spark, sf_dir, "'JOHN SAMPLE was here'"), entries, config=run.RunConfig(sweep=False))
    return report.unused_entries(entries, out.findings)


@query("""select c_custkey as line_no, c_custkey % 2 = 0 as active, case c_custkey % 4 when 0 then 'addr' when 1 then 'name' when 2 then 'name' else 'employer' end as category,
  'VALUE ' || cast(c_custkey as varchar) as value, c_custkey % 4 <> 1 as known from customer""")
def list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "case when k % 2 = 0 then '' else '## ' end || case k % 4 when 0 then 'Address : ' when 1 then 'estate: ' when 2 then '' else 'EMPLOYER:' end || 'VALUE ' || cast(k as string)"
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select(F.col("k").alias("line_no"), F.expr(line).alias("line"))
    return dictionary.list_rows(rows)


# ---------------------------------------------------------------- audit, mining


@query("""select k as doc_ord, cast(1 as bigint) as line_no, 'FAIL' as severity, unnest(case k % 4 when 0 then ['[PATTERN:SSN]'] when 1 then ['[PATTERN:EIN]', '[PATTERN:EMAIL]'] when 2 then [] else ['[SIGNATURE] stamp label remains'] end) as reason
  from (select c_custkey as k from customer)""")
def audit_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "case k % 4 when 0 then 'SSN 123-45-6789' when 1 then 'a@b.example and 12-3456789' when 2 then 'SSN [SSN-1] 1,000.00' else 'DocuSigned by: x' end"
    found = audit.audit(_repeated(spark, sf_dir, line))
    return found.select("doc_ord", F.col("line_no").cast("bigint").alias("line_no"), "severity", "reason")


@query("select c_custkey as doc_ord from customer where c_custkey % 3 = 0")
def audit_name_warn(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "case k % 3 when 0 then 'RECIPIENT NAME: JANE Q SAMPLE' when 1 then 'RECIPIENT NAME: [NAME-1]' else 'TAXPAYER STREET ADDRESS' end"
    return audit.audit(_repeated(spark, sf_dir, line)).filter("severity = 'WARN'").select("doc_ord")


@query("""select case when who % 2 = 0 then 'name' else 'employer' end as category, case when who % 2 = 0 then 'JANE ' || x || ' SAMPLE' else 'FIRST ' || x || ' BANK' end as value, first as doc_ord
from (select who, min(k) as first, chr(65 + cast(who // 20 as int)) || chr(65 + cast(who % 20 as int)) || 'Q' as x from (select c_custkey as k, c_custkey % 60 as who from customer) group by who)""")
def suggest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = "chr(65 + cast(floor((k % 60) / 20) as int)) || chr(65 + cast((k % 60) % 20 as int)) || 'Q'"
    lines = _repeated(spark, sf_dir, f"case when k % 60 % 2 = 0 then 'TAXPAYER NAME: JANE ' || {x} || ' SAMPLE' else 'PAYER: FIRST ' || {x} || ' BANK' end")
    return mining.suggest(lines).select("category", "value", "doc_ord")


@query("""select 'name' as category, 'JANE OTHER' as value""")
def suggest_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _repeated(spark, sf_dir, "case k % 3 when 0 then 'RECIPIENT: JOHN SAMPLE' when 1 then 'RECIPIENT: JANE OTHER' else 'RECIPIENT: OLD NAME' end")
    seen = spark.createDataFrame([("OLD  name",)], "value string").select(norm_value(F.col("value")).alias("norm"))
    return mining.suggest(lines, dictionary.make_entries([("name", "JOHN SAMPLE")]), seen).select("category", "value")


@query("select k, k % 4 <> 3 as clean from (select c_custkey as k from customer)")
def promote_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import extracts, promote

    lines = _repeated(spark, sf_dir, "'REF 12345678' || case when k % 4 = 3 then ' DocuSigned by: me' else '' end")
    out = run.redact(lines)
    good = promote(extracts(out.lines), out.audit).select("doc_ord", F.lit(True).alias("clean"))
    return lines.join(good, "doc_ord", "left").select(F.col("doc_ord").alias("k"), F.coalesce("clean", F.lit(False)).alias("clean"))


@query(f"with {_LINES} select doc_id, cast(line_no as bigint) as line_no, true as same from lines")
def native_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold and its native twin leave the same text on every line."""
    touched, rest = fold_parts(document_lines(spark, sf_dir))
    both = touched.select("doc_ord", "line_no", "line", tokens.inert_text().alias("left")).unionByName(rest.select("doc_ord", "line_no", "line", F.col("line").alias("left")))
    return both.select(F.col("doc_ord").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no"), (F.col("left") == native_text(F.col("line"))).alias("same"))


@query("""select c_custkey as k, 'O1' || cast(c_custkey % 10 as varchar) || '1 O' as a, 'SSN ' || cast(c_custkey % 10 as varchar) || '01x' as b from customer""")
def shadow_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.expr("cast(c_custkey % 10 as string)")
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), shadow(F.concat(F.lit("Ol"), d, F.lit("I O"))).alias("a"), shadow(F.concat(F.lit("SSN "), d, F.lit("O1x"))).alias("b")
    )


@query("""select c_custkey as k, '12' || lpad(cast(c_custkey % 100 as varchar), 2, '0') || '678' as acct, 'A B ' || cast(c_custkey as varchar) as name from customer""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    acct = F.concat(F.lit("Z12-"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("-678"))
    return read_table(spark, sf_dir, "customer").select(k.alias("k"), token_value(F.lit("ACCT"), acct).alias("acct"), token_value(F.lit("NAME"), F.concat(F.lit(" a\t b  "), k.cast("string"))).alias("name"))


# ------------------------------------------------------------------------ pages


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of one to four pages, of line items as lines."""
    items = read_table(spark, sf_dir, "lineitem")
    page = ((F.col("l_linenumber") + 1) / 2).cast("int")
    return items.select(F.col("l_orderkey").alias("doc_ord"), page.alias("page_no"), (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey")).alias("page_line"), F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("line"))


@query("""with l as (select l_orderkey as d, cast(floor((l_linenumber + 1) / 2) as int) as p, l_linenumber * 1000000000::bigint + l_partkey as i, 'item ' || cast(l_partkey as varchar) as line from lineitem),
m as (select distinct d, p from l where d in (select d from l group by d having count(distinct p) > 1)),
a as (select d, p, i, line from l union all select d, p, null, '===== PAGE ' || cast(p as varchar) || ' =====' from m)
select d as doc_ord, row_number() over (partition by d order by p, i nulls first) - 1 as line_no, line from a""")
def page_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitch_pages(_pages(spark, sf_dir)).select("doc_ord", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("""with l as (select l_orderkey as d, l_linenumber * 1000000000::bigint + l_partkey as i, 'item ' || cast(l_partkey as varchar) as line from lineitem)
select d as doc_ord, string_agg(line, chr(10) order by i) as text from l group by d""")
def text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_lines(_pages(spark, sf_dir).withColumn("line_no", F.col("page_line")))


@query("""with l as (select o_orderkey as d, o_orderkey % 3 as r from orders)
select d as doc_ord, r = 1 as is_ocr from l where r < 2""")
def ocr_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_ord"), F.lit(0).alias("line_no"))
    long, short = F.lit("x" * 25), F.lit("   x   ")
    drawn = orders.withColumn("line", F.when(F.col("doc_ord") % 3 == 0, long).otherwise(short))
    read = orders.withColumn("line", F.when(F.col("doc_ord") % 3 == 1, long).otherwise(short))
    return route(drawn, read).select("doc_ord", "is_ocr")


@query("select o_orderkey as doc_ord, cast(case when o_orderkey % 2 = 0 then 1 else 0 end as bigint) as n_missing from orders")
def flatten_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_ord"))
    texts = orders.select("doc_ord", F.concat(F.lit("a b\nvalue "), F.col("doc_ord").cast("string")).alias("text"))
    values = orders.select("doc_ord", F.when(F.col("doc_ord") % 2 == 0, "absent").otherwise(F.concat(F.lit("v a l u e"), F.col("doc_ord").cast("string"))).alias("value"))
    return missing_values(values, texts)


@query("""with l as (select l_orderkey as d, l_linenumber as p, (l_orderkey + l_linenumber) % 5 = 0 and l_linenumber > 1 as c, l_orderkey % 2 = 0 as e from lineitem),
f as (select d, min(p) filter (where c) as first, bool_or(e) as e from l group by d)
select l.d as doc_ord, l.p as page_no from l join f using (d) where not f.e or f.first is null or l.p < f.first""")
def certificate_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_ord"), F.col("l_linenumber").alias("page_no"))
    title = F.when((F.col("doc_ord") + F.col("page_no")) % 5 == 0, "Certificate of  Completion").otherwise("page")
    texts = items.withColumn("text", F.concat(title, F.when(F.col("doc_ord") % 2 == 0, " DocuSigned by: x").otherwise("")))
    return run.without_certificate(items, texts)


# ----------------------------------------------------------------------- layout


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of three lines of single characters for each supplier, six points wide, lines fourteen apart, slightly uneven."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_ord"))
    cells = s.select("doc_ord", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row")).select("doc_ord", "row", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("col"))
    x0, y1 = 72.0 + 6 * F.col("col") + F.when(F.col("col") > 4, 6).otherwise(0), 100.0 + 14 * F.col("row") + 0.1 * (F.col("col") % 3)
    return cells.select(
        "doc_ord", F.lit(1).alias("page_no"), F.chr((65 + (F.col("doc_ord") + F.col("row") + F.col("col")) % 26).cast("int")).alias("ch"), x0.alias("x0"), (y1 - 10).alias("y0"), (x0 + 6).alias("x1"), y1.alias("y1"),
        F.lit(10.0).alias("size"), F.lit(True).alias("upright"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("matrix"),
    )


@query("""with c as (select s_suppkey as d, r, c from supplier, unnest(generate_series(0, 2)) a(r), unnest(generate_series(0, 9)) b(c))
select d as doc_ord, cast(r as bigint) as page_line, string_agg(chr(cast(65 + (d + r + c) % 26 as int)) || case when c = 4 then ' ' else '' end, '' order by c) as line from c group by d, r""")
def line_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_text(layout.form_lines(_glyphs(spark, sf_dir))).select("doc_ord", F.col("page_line").cast("bigint").alias("page_line"), "line")


@query("""select s_suppkey as doc_ord, cast(r as bigint) as page_line, 'L' || cast(r as varchar) || '  R' || cast(s_suppkey % 7 as varchar) as line from supplier, unnest(generate_series(0, 3)) a(r)""")
def ocr_row_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_ord")).select("doc_ord", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r"))
    y = 50.0 + 20 * F.col("r")
    rect = lambda x, dy: F.array(*(F.array((x + a).cast("double"), (y + dy + b).cast("double")) for a, b in ((0, 0), (30, 0), (30, 10), (0, 10))))
    left = s.select("doc_ord", F.lit(1).alias("page_no"), rect(F.lit(10), 0).alias("box"), F.concat(F.lit("L"), F.col("r").cast("string")).alias("text"))
    right = s.select("doc_ord", F.lit(1).alias("page_no"), rect(F.lit(200), 4).alias("box"), F.concat(F.lit("R"), (F.col("doc_ord") % 7).cast("string")).alias("text"))
    return layout.ocr_lines(left.unionByName(right)).select("doc_ord", F.col("page_line").cast("bigint").alias("page_line"), "line")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.line_text(layout.form_lines(_glyphs(spark, sf_dir)))
    return lines.withColumn("line_no", F.col("page_line"))


@query("""select s_suppkey as doc_ord, cast(1 as bigint) as line_no, 84.0 as x0, 104.0 as y0, 102.0 as x1, 114.2 as y1 from supplier""")
def span_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _placed(spark, sf_dir)
    spans = lines.filter("line_no = 1").select("doc_ord", "line_no", F.lit(2).alias("start"), F.lit(6).alias("end"), F.lit("[X-1]").alias("token"))
    found = layout.span_boxes(spans, lines)
    return found.select("doc_ord", F.col("line_no").cast("bigint").alias("line_no"), *(F.round(k, 3).alias(k) for k in layout.BOX))


@query("""select s_suppkey as doc_ord, cast(0 as bigint) as line_no, cast(2 as bigint) as start, cast(9 as bigint) as "end" from supplier""")
def region_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _placed(spark, sf_dir)
    regions = lines.select("doc_ord", "page_no").distinct().select("doc_ord", "page_no", F.lit(0).alias("n"), F.lit(84.0).alias("x0"), F.lit(80.0).alias("y0"), F.lit(126.0).alias("x1"), F.lit(101.0).alias("y1"))
    return layout.region_presets(lines, regions).select("doc_ord", *(F.col(c).cast("bigint").alias(c) for c in ("line_no", "start", "end")))


def _stamps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_ord"), F.lit(1).alias("page_no"))

    def line(n: int, text: str, x: float, y: float) -> DataFrame:
        boxes = F.transform(F.sequence(F.lit(0), F.length("line") - 1), lambda i: F.struct(*((x0).cast("double").alias(k) for k, x0 in zip(layout.BOX, (x + 6 * i, F.lit(y), x + 6 * i + 6, F.lit(y + 10)), strict=True))))
        return s.withColumn("page_line", F.lit(n)).withColumn("line", F.lit(text)).withColumn("boxes", boxes)

    lines = line(0, "DocuSigned by:", 100, 200).unionByName(line(1, "A1B2C3D4E5F64A7...", 110, 260)).unionByName(line(2, "DocuSigned by:", 400, 500))
    marks = s.select("doc_ord", "page_no", F.lit("fill-image").alias("kind"), F.lit(120.0).alias("x0"), F.lit(215.0).alias("y0"), F.lit(250.0).alias("x1"), F.lit(255.0).alias("y1"))
    return lines, marks, s.select("doc_ord", "page_no", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))


@query("""select s_suppkey as doc_ord, cast(n as bigint) as n, case n when 0 then 98.0 else 398.0 end as x0, case n when 0 then 198.0 else 498.0 end as y0, case n when 0 then 252.0 else 582.0 end as x1,
  case n when 0 then 272.0 else 572.0 end as y1, case n when 0 then 'A1B2C3D4E5F64A7...' end as signer, n = 1 as no_id from supplier, unnest([0, 1]) t(n)""")
def signature_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.signature_regions(*_stamps(spark, sf_dir)).select("doc_ord", F.col("n").cast("bigint").alias("n"), *layout.BOX, "signer", "no_id")


@query("""select s_suppkey as doc_ord, 2::bigint as strict_labels, 2::bigint as labels, 1::bigint as signer_ids, 2::bigint as mentions, 46::bigint as n_chars, 1::bigint as images, 0::bigint as drawings, '130x40' as small_images from supplier""")
def inspect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run.inspect(*_stamps(spark, sf_dir))
    n = [F.col(c).cast("bigint").alias(c) for c in ("strict_labels", "labels", "signer_ids", "mentions", "n_chars", "images", "drawings")]
    return found.select("doc_ord", *n, F.array_join("small_images", ",").alias("small_images"))


@query("""select s_suppkey as doc_ord, 106.0 as x0, 211.0 as y0, 254.0 as x1, 259.0 as y1 from supplier""")
def image_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, marks, pages = _stamps(spark, sf_dir)
    frame = marks.withColumns({"kind": F.lit("stroke-path"), "x0": F.lit(116.0), "y0": F.lit(211.0), "x1": F.lit(254.0), "y1": F.lit(259.0)})
    print_ = marks.withColumns({"kind": F.lit("fill-text"), "x0": F.lit(106.0), "y0": F.lit(220.0), "x1": F.lit(112.0), "y1": F.lit(228.0)})
    far = marks.withColumns({"kind": F.lit("fill-text"), "x0": F.lit(306.0), "y0": F.lit(220.0), "x1": F.lit(312.0), "y1": F.lit(228.0)})
    return layout.image_stamps(marks.unionByName(frame).unionByName(print_).unionByName(far), pages).select("doc_ord", *layout.BOX)


@query("select s_suppkey as doc_ord from supplier where s_suppkey % 2 = 0")
def graphics_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_ord"), F.lit(1).alias("page_no"))
    regions = s.select("*", F.lit(0).alias("n"), F.lit(10.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(100.0).alias("x1"), F.lit(50.0).alias("y1"))
    own = regions.drop("n").withColumn("kind", F.lit("fill-path"))
    left = regions.drop("n").filter("doc_ord % 2 = 0").withColumns({"x0": F.lit(20.0), "x1": F.lit(60.0), "kind": F.lit("fill-image")})
    return layout.graphics_left(own.unionByName(left), regions).select("doc_ord")


@query("select s_suppkey as doc_ord, 84.0 as x0, round(90 + 1.2, 3) as y0, 108.0 as x1, 99.0 as y1 from supplier")
def thin_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_ord"), F.lit(1).alias("page_no"))
    boxes = s.select("*", F.lit(0).alias("n"), F.lit(85.0).alias("x0"), F.lit(99.0).alias("y0"), F.lit(107.0).alias("x1"), F.lit(100.0).alias("y1"))
    cells = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    glyphs = cells.select("doc_ord", "page_no", F.lit("x").alias("ch"), (72.0 + 6 * F.col("i")).alias("x0"), F.lit(90.0).alias("y0"), (78.0 + 6 * F.col("i")).alias("x1"), F.lit(100.0).alias("y1"))
    return layout.thin_box_repair(boxes, glyphs).select("doc_ord", *(F.round(k, 3).alias(k) for k in layout.BOX))


@query("select s_suppkey as doc_ord from supplier where s_suppkey % 3 = 0")
def residual_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_ord"), F.lit(1).alias("page_no"))
    boxes = s.select("*", F.lit(10.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(50.0).alias("x1"), F.lit(20.0).alias("y1"))
    y = F.when(F.col("doc_ord") % 3 == 0, 16.0).otherwise(30.0)
    glyphs = s.select("*", F.lit("a").alias("ch"), F.lit(20.0).alias("x0"), y.alias("y0"), F.lit(26.0).alias("x1"), (y + 8).alias("y1"))
    return layout.boxes_with_glyphs(boxes, glyphs).select("doc_ord")


@query("""select s_suppkey as doc_ord, case s_suppkey % 4 when 0 then 10.0 when 1 then 760.0 when 2 then 572.0 else 20.0 end as x0, case s_suppkey % 4 when 0 then 20.0 when 1 then 10.0 when 2 then 760.0 else 572.0 end as y0 from supplier""")
def unrotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("doc_ord"), F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(40.0).alias("x1"), F.lit(32.0).alias("y1"),
        (F.col("s_suppkey") % 4 * 90).alias("rotation"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"),
    )
    return layout.unrotated(boxes).select("doc_ord", "x0", "y0")


@query("""select l_returnflag as flag, list_sort(list(l_quantity))[cast(floor(count(*) / 2) as bigint) + 1] as middle from lineitem group by l_returnflag""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(layout.upper_median("l_quantity").alias("middle"))


@query("""select p_partkey as k, least(300.0 / 72, 3300.0 / greatest(p_size * 100.0, 612.0, 1.0)) as scale from part""")
def ocr_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), layout.ocr_scale(F.col("p_size") * 100.0, F.lit(612.0)).alias("scale"))


# ------------------------------------------------------------- what was not asked yet


@query("""with k as (select c_custkey as k from customer),
one as (select 'name' as category, 'VALUE ' || (k % 40) as v, 0 as source, min(k) as line_no from k where k % 2 = 0 group by k % 40 union all
  select case when k % 3 = 0 then 'acct' else 'name' end, 'value  ' || (k % 40), 1, min(k) from k where k % 2 = 1 or k % 5 = 0 group by k % 40, k % 3 = 0),
r as (select *, upper(regexp_replace(v, ' +', ' ', 'g')) as norm, row_number() over (partition by category, upper(regexp_replace(v, ' +', ' ', 'g')) order by source, line_no) as n from one)
select category, v as value, source, line_no from r where n = 1""")
def list_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line_no"))
    own = k.filter("line_no % 2 = 0").withColumn("line", F.expr("'name: VALUE ' || cast(line_no % 40 as string)"))
    other = k.filter("line_no % 2 = 1 or line_no % 5 = 0").withColumn("line", F.expr("case when line_no % 3 = 0 then 'acct: ' else 'name: ' end || 'value  ' || cast(line_no % 40 as string)"))
    return dictionary.merged_lists(*map(dictionary.list_rows, (own, other)))


@query("select distinct upper('value ' || (c_custkey % 30)) as norm from customer")
def list_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "case when k % 2 = 0 then '### ' else '' end || 'name:  value   ' || cast(k % 30 as string)"
    return dictionary.seen_values(dictionary.list_rows(_repeated(spark, sf_dir, line).select(F.col("doc_ord").alias("line_no"), "line")))


@query("select c_custkey as line_no from customer where c_custkey % 4 = 1")
def list_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "case k % 4 when 0 then 'name: A B' when 1 then 'trust: A B' when 2 then '# trust: A B' else 'A B' end"
    return dictionary.unknown_prefixes(dictionary.list_rows(_repeated(spark, sf_dir, line).select(F.col("doc_ord").alias("line_no"), "line")))


@query("""select k as doc_ord, cast(4 as bigint) as line_no, '[PATTERN:DOB]' as reason from (select c_custkey as k from customer) where k % 2 = 0
union all select k, 3, '[LIST:name]' from (select c_custkey as k from customer) where k % 3 = 0""")
def audit_of_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without its spaces fails by the rules for OCR only, which an extract's header calls for; header lines never fail."""
    text = "'# 123-45-6789 ' || case when k % 2 = 0 then 'OCR-DERIVED' else '' end || '\\n\\n' || case when k % 3 = 0 then 'for JOHN SAMPLE' else 'for nobody' end || '\\nDATEOFBIRTH:1/2/1980'"
    made = _repeated(spark, sf_dir, text).select("doc_ord", F.col("line").alias("text"))
    found = audit.audit_extracts(made, dictionary.make_entries([("name", "JOHN SAMPLE")]))
    return found.filter("severity = 'FAIL'").select("doc_ord", F.col("line_no").cast("bigint").alias("line_no"), "reason")


@query("""select 'FAIL' as severity, '[PATTERN:EIN]' as reason, count(*) as n_lines, count(*) as n_docs from customer where c_custkey % 3 = 0
union all select 'WARN', 'possible unredacted name', count(*), count(*) from customer where c_custkey % 3 = 1""")
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "case k % 3 when 0 then 'EIN 12-3456789' when 1 then 'PAYER NAME: JANE SAMPLE' else 'PAYER NAME: [NAME-1]' end"
    return audit.audit_counts(audit.audit(_repeated(spark, sf_dir, line)))


@query("""select c_custkey as doc_ord, c_custkey % 4 in (0, 3) as told from customer""")
def glued_form_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On lines from OCR, form words run together aren't names; a name run together is."""
    line = "case k % 4 when 0 then 'RECIPIENT NAME JANESAMPLE' when 1 then 'RECIPIENT NAME PAYERSADDRESS' when 2 then 'RECIPIENT NAME: FILINGSTATUS' else 'EMPLOYEE: JOHNQPUBLIC' end"
    lines = _repeated(spark, sf_dir, line).withColumn("is_ocr", F.lit(True))
    told = audit.audit(lines).filter("severity = 'WARN'").select("doc_ord", F.lit(True).alias("told"))
    return lines.join(told, "doc_ord", "left").select("doc_ord", F.coalesce("told", F.lit(False)).alias("told"))


@query("""select c_custkey as k, case c_custkey % 6 when 0 then 'DATE 03/15/1980' when 1 then 'NUMBER A1234567' when 2 then 'CODE [ACCT-Z]' when 3 then 'FORM 1099 for SAMPLETOWN, CA 90000 filers' when 4 then 'SCHEDULE CA 90000' else 'ABCDEF12-0A0A-1B2C-3D4E-ABCDEFABCDEF' end as text from customer""")
def gates_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose rule asks for a context, or is barred by form words, stay without it (nine digits are an account then)."""
    line = "case k % 6 when 0 then 'DATE 03/15/1980' when 1 then 'NUMBER A1234567' when 2 then 'CODE 121099999' when 3 then 'FORM 1099 for SAMPLETOWN, CA 90000 filers' when 4 then 'SCHEDULE CA 90000' else 'ABCDEF12-0A0A-1B2C-3D4E-ABCDEFABCDEF' end"
    return tokens.inert(fold(_repeated(spark, sf_dir, line))).select(F.col("doc_ord").alias("k"), F.col("line").alias("text"))


@query("""select c_custkey as k, case when c_custkey % 2 = 0 then '[ACCT-Z] [ADDR-Z]' else 'Account No. [ACCT-Z] [ADDR-Z]' end as text, case when c_custkey % 2 = 0 then 'city_line_again' else 'city_edge_again' end as rule from customer""")
def city_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A city that is alone on its line, or at its edge without a form word, only once an account number is gone."""
    from ..functions.patterns import RULES

    line = "case when k % 2 = 0 then '12345678 SAMPLETOWN CA 90000' else 'Account No. BOX-12345 SAMPLETOWN CA 90000' end"
    folded = fold(_repeated(spark, sf_dir, line).withColumn("is_ocr", F.col("doc_ord") % 2 == 1))
    names = F.array(*(F.lit(r.name) for r in RULES))
    rule = F.element_at(F.transform(F.filter("hits", lambda h: h["kind"] == "ADDR"), lambda h: F.get(names, h["ord"])), 1)
    return tokens.inert(folded).join(folded.select("doc_ord", rule.alias("rule")), "doc_ord").select(F.col("doc_ord").alias("k"), F.col("line").alias("text"), "rule")


@query("""select c_custkey as k, '[SIGNATURE-' || row_number() over (order by c_custkey) || '] and [SSN-' || row_number() over (order by c_custkey) || ']' as text from customer""")
def preset_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of signature regions through a whole run; the regions are numbered before any line."""
    k = "lpad(cast(k as string), 9, '0')"
    lines = _repeated(spark, sf_dir, f"'Jane S. and ' || substring({k}, 1, 3) || '-' || substring({k}, 4, 2) || '-' || substring({k}, 6, 4)")
    presets = lines.select("doc_ord", "line_no", F.lit(0).alias("start"), F.lit(7).alias("end"), F.concat(F.lit("signer "), F.col("doc_ord").cast("string")).alias("key"))
    regions = lines.select("doc_ord", F.lit(1).alias("page_no"), F.lit(0).alias("n"), F.concat(F.lit("signer "), F.col("doc_ord").cast("string")).alias("key"))
    out = run.redact(lines, presets=presets, regions=regions, config=run.RunConfig(sweep=False))
    return out.lines.select(F.col("doc_ord").alias("k"), F.col("redacted").alias("text"))


@query("""select c_custkey as k, case when c_custkey % 2 = 0 then 'RECIPIENT NAME: [NAME-1]' else 'paid by [NAME-1] in cash' end as text from customer""")
def mined_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that a run finds are used in the same run."""
    lines = _repeated(spark, sf_dir, "case when k % 2 = 0 then 'RECIPIENT NAME: JANE SAMPLE' else 'paid by Jane  Sample in cash' end")
    out = run.redact(lines, config=run.RunConfig(mine=True))
    return out.lines.select(F.col("doc_ord").alias("k"), F.col("redacted").alias("text"))


@query("""select o_orderkey as k, row_number() over (order by o_totalprice, o_orderkey) as nth from orders""")
def numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered in an order over the whole table, range by range."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    return numbered(orders, ["o_totalprice", "k"], "nth").select("k", "nth")


@query("""with l as (select l_orderkey as d, l_linenumber as p, l_partkey as v from lineitem), m as (select d, p, count(*) as n from l group by d, p)
select d as doc_ord, p as page_no, (0)::bigint as page_line, 'text' as line from m union all
select d, p, row_number() over (partition by d, p order by 'v' || lpad(v::varchar, 9, '0')), 'v' || lpad(v::varchar, 9, '0') from l""")
def field_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_ord"), F.col("l_linenumber").alias("page_no"), F.concat(F.lit("v"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("value"))
    pages = items.select("doc_ord", "page_no").distinct().select("doc_ord", "page_no", F.lit(0).alias("page_line"), F.lit("text").alias("line"))
    return with_fields(pages, items)


@query("select l_orderkey as doc_ord, l_returnflag as kind, count(*) as n from lineitem group by all")
def field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.type_counts(read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_ord"), F.col("l_returnflag").alias("kind")))


@query("""with g as (select l_orderkey as d, l_quantity / 2.0 as y from lineitem), s as (select *, lag(y) over (partition by d order by y) as b from g)
select d as doc_ord, count(*) filter (where b is null or y - b > 1.0) as n_drawn from s group by d""")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_ord"), F.lit(1).alias("page_no"), F.lit("x").alias("ch"), (F.col("l_quantity") / 2.0).alias("base"))
    blank = items.withColumns({"ch": F.lit(" "), "base": F.lit(900.0)})
    return layout.drawn_lines(items.unionByName(blank)).select("doc_ord", "n_drawn")


def _uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a page of a line for each item; its three boxes' tops are apart by the item's number and half of it."""
    items = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_ord"), F.lit(1).alias("page_no"), F.col("l_linenumber").alias("n"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("page_line"))
    box = lambda i, dy: F.struct(F.lit(10.0 * i).alias("x0"), dy.cast("double").alias("y0"), F.lit(10.0 * i + 8).alias("x1"), (dy + 10.0).cast("double").alias("y1"))
    none = F.lit(None).cast(layout.RECT)
    boxes = F.array(box(0, F.lit(100.0)), box(1, 100.0 + F.col("n") / 2), none, box(3, 100.0 + F.col("n")))
    return items.select("doc_ord", "page_no", "page_line", "n", F.lit("ab c").alias("line"), boxes.alias("boxes"))


@query("""select l_orderkey as doc_ord, count(*) as n_lines, list_sort(list(l_linenumber::double))[cast(floor(count(*) / 2) as bigint) + 1] as middle, max(l_linenumber)::double as most from lineitem group by l_orderkey""")
def spread_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_spread(_uneven(spark, sf_dir)).select("doc_ord", "n_lines", "middle", "most")


@query("""select l_orderkey as doc_ord, 3 * count(*) as n_asked, count(*) + count(*) filter (where l_linenumber <= 4) + count(*) filter (where l_linenumber <= 2) as n_confirmed from lineitem group by l_orderkey""")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs stand ten points high at 98 and 102: the first character of a line always lies on one, others as far as they are near."""
    lines = _uneven(spark, sf_dir)
    glyphs = lines.select("doc_ord", "page_no").distinct().select("doc_ord", "page_no", F.explode(F.array(*map(F.lit, (0.0, 10.0, 30.0)))).alias("x0"))
    glyphs = glyphs.select("doc_ord", "page_no", F.lit("x").alias("ch"), "x0", F.lit(98.0).alias("y0"), (F.col("x0") + 8).alias("x1"), F.lit(107.0).alias("y1"))
    return layout.positions_confirmed(lines, glyphs).select("doc_ord", "n_asked", "n_confirmed")


@query("""select s_suppkey as doc_ord, cast(r as bigint) as line_no, 72.0 as x0, 138.0::double as x1, 'kept ' || r as text from supplier, unnest(generate_series(0, 2)) a(r)""")
def text_under_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _placed(spark, sf_dir).select("doc_ord", "line_no", "page_no", "page_line", "boxes")
    separators = lines.filter("line_no = 0").withColumns({"line_no": F.lit(9), "page_line": F.lit(None).cast("int")})
    redacted = lines.unionByName(separators).select("doc_ord", "line_no", F.concat(F.lit("kept "), F.col("line_no").cast("string")).alias("redacted"))
    found = layout.text_layer_rows(redacted, lines.unionByName(separators))
    return found.select("doc_ord", F.col("line_no").cast("bigint").alias("line_no"), F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"), "text")


@query("""select s_suppkey as doc_ord, cast(n as bigint) as n, case n when 0 then 0.0 else 100.0 end as x0, case n when 0 then 30.0 else 110.0 end as x1, case n when 0 then 'B' end as signer, n = 1 as no_id from supplier, unnest([0, 1]) t(n)""")
def regions_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third box joins the first region through the second, and brings its signer; the fourth stands alone."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_ord"), F.lit(1).alias("page_no"))
    rows = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(float(a)).alias("x0"), F.lit(0.0).alias("y0"), F.lit(float(b)).alias("x1"), F.lit(10.0).alias("y1"), F.lit(w).cast("string").alias("signer"), F.lit(no).alias("no_id")) for i, (a, b, w, no) in enumerate([(0, 10, None, False), (5, 20, "B", False), (15, 30, "C", False), (100, 110, None, True)])))
    boxes = s.select("doc_ord", "page_no", F.explode(rows).alias("r")).select("doc_ord", "page_no", "r.*")
    return layout.merged_regions(boxes).select("doc_ord", F.col("n").cast("bigint").alias("n"), "x0", "x1", "signer", "no_id")


@query("""select s_suppkey as doc_ord, cast(page_line as bigint) as page_line, line from supplier, (values (0, 'AB'), (1, 'ZY')) t(page_line, line)""")
def sideways_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sideways characters are a last line of their own; one flagged so but turned by noise alone stands in its line."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_ord"), F.lit(1).alias("page_no"))
    cell = lambda ch, x, y, up, m: F.struct(F.lit(ch).alias("ch"), F.lit(x).alias("x0"), F.lit(y - 10).alias("y0"), F.lit(x + 6).alias("x1"), F.lit(y).alias("y1"), F.lit(10.0).alias("size"), F.lit(up).alias("upright"), F.array(*map(F.lit, m)).alias("matrix"))
    cells = [cell("A", 10.0, 100.0, True, (1.0, 0.0, 0.0, 1.0)), cell("B", 16.0, 100.2, False, (1.0, 0.005, -0.005, 1.0)), cell("Z", 11.0, 50.0, False, (0.0, 1.0, -1.0, 0.0)), cell("Y", 17.0, 90.0, False, (0.0, 1.0, -1.0, 0.0))]
    glyphs = s.select("doc_ord", "page_no", F.explode(F.array(*cells)).alias("c")).select("doc_ord", "page_no", "c.*")
    return layout.line_text(layout.form_lines(glyphs)).select("doc_ord", F.col("page_line").cast("bigint").alias("page_line"), "line")


@query("""select null::bigint as doc_ord, 'UNKNOWN LIST PREFIX' as code, 'line(s) 2, 5' as detail union all select null, 'LIST ENTRY NEVER MATCHED', 'acct: 1'
union all select o, case when o % 3 = 1 then 'OCR APPLIED' else 'NEEDS OCR' end, '1 characters in the text layer' from (select o_orderkey as o from orders) where o % 3 > 0
union all select o, 'CERTIFICATE DROPPED', 'pages 2-3' from (select o_orderkey as o from orders) where o % 5 = 0
union all select o, 'ROTATION REMOVED', '2 page(s)' from (select o_orderkey as o from orders) where o % 5 = 1
union all select o, 'FLATTENED', '1 field(s)' from (select o_orderkey as o from orders) where o % 5 = 2
union all select o, 'FLATTEN INCOMPLETE', '4 value(s) missing' from (select o_orderkey as o from orders) where o % 5 = 3
union all select o, 'SIGNATURE', 'page 2: label without an ID line' from (select o_orderkey as o from orders) where o % 5 = 4
union all select o, 'SELF-CHECK FAILED', '1 line(s)' from (select o_orderkey as o from orders) where o % 7 = 0""")
def run_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_ord"))
    page = o.withColumn("line_no", F.lit(0))
    long, short = F.lit("x" * 25), F.lit("  x ")
    drawn = page.withColumn("line", F.when(F.col("doc_ord") % 3 == 0, long).otherwise(short))
    read = page.withColumn("line", F.when(F.col("doc_ord") % 3 == 1, long).otherwise(short))
    pages = o.withColumn("page_no", F.explode(F.sequence(F.lit(1), F.lit(3))))
    cert = F.when((F.col("doc_ord") % 5 == 0) & (F.col("page_no") == 2), "Certificate of Completion DocuSigned by: x").otherwise("text")
    texts = pages.withColumn("text", cert)
    rows = dictionary.list_rows(spark.createDataFrame([(1, "name: JOHN SAMPLE"), (2, "trust: A B"), (3, "# trust: C"), (4, "acct: QQ 1"), (5, "estate: D")], "line_no int, line string"))
    entries = dictionary.make_entries([("name", "JOHN SAMPLE"), ("acct", "QQ 1")])
    findings = spark.createDataFrame([(1, "[LIST:name]", "JOHN SAMPLE", "[NAME-1]", 1)], "doc_ord bigint, reason string, original string, token string, n bigint")
    audited = o.filter("doc_ord % 7 = 0").select("doc_ord", F.lit(1).alias("line_no"), F.lit("FAIL").alias("severity"), F.lit("[PATTERN:SSN]").alias("reason"))
    regions = o.filter("doc_ord % 5 = 4").select("doc_ord", F.lit(2).alias("page_no"), F.lit(True).alias("no_id"))
    missing = o.filter("doc_ord % 5 > 1").select("doc_ord", F.when(F.col("doc_ord") % 5 == 3, 4).otherwise(0).alias("n_missing"))
    told = [
        notes.list_notes(rows, entries, findings), notes.text_notes(drawn, read), notes.signature_notes(regions), notes.audit_notes(audited), notes.single_file(o),
        notes.page_notes(texts, pages.filter("doc_ord % 5 = 1 and page_no < 3"), o.filter("doc_ord % 5 = 2").select("doc_ord", F.lit("v").alias("value")), missing),
    ]
    out = told[0]
    for t in told[1:]:
        out = out.unionByName(t)
    return out


# ---------------------------------------------------------------- over the corpus

#: What the rules find in documents: e-mail addresses, phone numbers and account numbers, with their places and tokens.
_FOUND = rf"""{_LINES},
spots as (select doc_id, line_no, line, unnest(generate_series(1, length(line))) as i from lines where regexp_matches(line, '\d|@')),
e as (select doc_id, line_no, i, 'EMAIL' as kind, regexp_extract(substr(line, i), '^{_EMAIL}') as v from spots
  where regexp_matches(substr(line, i), '^{_EMAIL}') and not regexp_matches(substr(line, 1, i - 1), '{_W}.+-]$')),
p as (select doc_id, line_no, i, 'PHONE' as kind, regexp_extract(substr(line, i), '^{_PHONE}', 1) as v from spots where regexp_matches(substr(line, i), '^{_PHONE}')),
q as (select * from p where not exists (select 1 from p as b where b.doc_id = p.doc_id and b.line_no = p.line_no and b.i < p.i and b.i + length(b.v) > p.i)),
a as (select doc_id, line_no, i, 'ACCT' as kind, regexp_extract(substr(line, i), '^\d{{8,}}') as v from spots
  where regexp_matches(substr(line, i), '^\d{{8,}}') and not regexp_matches(substr(line, 1, i - 1), '(\d|\d\.|[^\w]\.|^\.)$') and not regexp_matches(regexp_replace(substr(line, i), '^\d+', ''), '^\s?%')),
h as (select *, case kind when 'ACCT' then v else upper(trim(regexp_replace(v, '\s+', ' ', 'g'))) end as norm, case kind when 'ACCT' then right(v, 4) else '' end as tail
  from (select * from e union all select * from q union all select * from a)),
n as (select kind, norm, tail, row_number() over (partition by kind, tail order by min((doc_id * 1000000 + line_no) * 100000 + i)) as k from h group by kind, norm, tail),
t as (select h.*, case when kind <> 'ACCT' then '[' || kind || '-' || k || ']' when k = 1 then '[ACCT-...' || tail || ']' else '[ACCT-' || k || '-...' || tail || ']' end as token from h join n using (kind, norm, tail))"""


@query(f"""with {_FOUND},
parts as (select t.*, line, lag(t.i + length(v), 1, 1) over w as since, row_number() over (partition by doc_id, line_no order by t.i desc) as back from t join lines using (doc_id, line_no) window w as (partition by doc_id, line_no order by t.i))
select doc_id as doc_ord, cast(line_no as bigint) as line_no, string_agg(substr(line, since, i - since) || token || case when back = 1 then substr(line, i + length(v)) else '' end, '' order by i) as redacted from parts group by doc_id, line_no""")
def redact_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over documents: redacted lines, for those that change."""
    out = run.redact(document_lines(spark, sf_dir))
    return out.lines.filter("line <> redacted").select("doc_ord", F.col("line_no").cast("bigint").alias("line_no"), "redacted")


@query(f"with {_FOUND} select distinct doc_id as doc_ord, cast(line_no + 1 as bigint) as line_no, '[PATTERN:' || kind || ']' as reason from h where doc_id % 3 = 0")
def audit_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a run's output into which a leak was put: a third of the documents stand there as they were."""
    out = run.redact(document_lines(spark, sf_dir))
    leak = F.col("doc_ord") % 3 == 0
    left = out.lines.withColumn("line", F.when(leak, F.col("line")).otherwise(F.col("redacted"))).select("doc_ord", "line_no", "line", "is_ocr")
    return audit.audit(left).filter("severity = 'FAIL'").select("doc_ord", F.col("line_no").cast("bigint").alias("line_no"), "reason")


@query("select cast(null as bigint) as doc_ord, cast(null as varchar) as reason where false")
def own_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run's own audit fails over documents: nothing."""
    return run.redact(document_lines(spark, sf_dir)).audit.filter("severity = 'FAIL'").select("doc_ord", "reason")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
