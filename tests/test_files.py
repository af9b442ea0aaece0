"""Lists, extracts and folders: what is read, what is written, and what a failing audit holds back."""

from __future__ import annotations

from maskwright.operators import dictionary, mining
from maskwright.plans import notes, run
from maskwright.sources import files, store

LINES = "doc_ord bigint, line_no int, line string, is_ocr boolean"


def test_lists_and_where_they_are(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert files.list_path(spark, str(deep)).endswith("/a/b/redaction_list.txt")
    (tmp_path / "redaction_list.txt").write_text("# note\n\nname: JOHN SAMPLE\nacct: 99887766\n")
    assert files.list_path(spark, str(deep)).endswith(f"{tmp_path.name}/redaction_list.txt")
    master = tmp_path / "master.txt"
    master.write_text("name: john  sample\naddr: 9 OAK ST\n")
    lists = files.lists_for(spark, str(deep), str(master))
    assert len(lists) == 2
    assert {(e.category, e.canonical) for e in dictionary.load_entries(*lists)} == {("name", "JOHN SAMPLE"), ("acct", "99887766"), ("addr", "9 OAK ST")}
    assert len(files.lists_for(spark, str(deep), str(tmp_path / "none.txt"))) == 1


def test_candidates_are_appended_once(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, "PAYER: FIRST EXAMPLE BANK", False)], LINES)
    path = f"{tmp_path}/list"
    files.append_entries(mining.suggest(lines).select("category", "value"), path, "a folder")
    told = files.read_list(spark, path)
    text = "\n".join(r["line"] for r in told.orderBy("line_no").collect())
    assert text.startswith("# redaction_list.txt") and text.endswith("employer: FIRST EXAMPLE BANK") and "# added 2" in text
    seen = dictionary.seen_values(dictionary.list_rows(told))
    again = mining.suggest(lines, (), seen).select("category", "value")
    files.append_entries(again, path, "a folder")
    assert files.read_list(spark, path).count() == told.count()
    assert [e.canonical for e in dictionary.load_entries(told)] == ["FIRST EXAMPLE BANK"]


def test_outputs_that_fail_are_held_back(spark, tmp_path):
    rows = [(1, 0, "SSN 123-45-6789", False), (2, 0, "DocuSigned by: me", False), (3, 0, "DATEOFBIRTH:1/2/1980", True)]
    out = run.redact(spark.createDataFrame(rows, LINES))
    told = run.finish(out, f"{tmp_path}/out")
    assert [(r["severity"], r["reason"], r["n_docs"]) for r in told.collect()] == [("FAIL", "[SIGNATURE] stamp label remains", 1)]
    assert not notes.passed(out.audit)
    assert [(r["doc_ord"], r["code"], r["detail"]) for r in notes.audit_notes(out.audit).collect()] == [(2, "SELF-CHECK FAILED", "1 line(s)")]
    made = {p.name: "".join(f.read_text() for f in p.glob("*.txt")) for p in (tmp_path / "out").glob("doc_ord=*")}
    assert sorted(made) == ["doc_ord=1", "doc_ord=3"]
    assert "[SSN-1]" in made["doc_ord=1"] and "OCR-DERIVED" in made["doc_ord=3"] and "1980" not in made["doc_ord=3"]
    assert run.finish(out, f"{tmp_path}/none", run.RunConfig(preview=True)) is None and not (tmp_path / "none").exists()


def test_numbers_run_over_all_ranges(spark):
    df = spark.range(5000).selectExpr("id", "pmod(id * 7919, 5003) as x")
    got = {r["x"]: r["n"] for r in store.numbered(df, ["x"], "n").collect()}
    assert [got[x] for x in sorted(got)] == list(range(1, 5001))
    assert store.numbered(df.filter("id < 0"), ["x"], "n").count() == 0


def test_empty_and_null_tables(spark):
    empty = spark.createDataFrame([], LINES)
    out = run.redact(empty, config=run.RunConfig(mine=True))
    assert out.lines.count() == out.audit.count() == out.findings.count() == 0
    odd = spark.createDataFrame([(1, 0, None, None), (1, 1, "", None), (None, 0, "SSN 123-45-6789", None), (2, 0, "x" * 100_000, False)], LINES)
    left = {(r["doc_ord"], r["line_no"]): r["redacted"] for r in run.redact(odd).lines.collect()}
    assert left[1, 1] == "" and left[2, 0] == "x" * 100_000 and (1, 0) not in left
