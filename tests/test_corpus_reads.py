"""Queries over the documents: how often texts are read and folded, and keys beyond five digits."""

from __future__ import annotations

import pytest
from compare import oracle, rows_of

from maskwright.functions.text import split_lines, touchable
from maskwright.operators import sweep
from maskwright.plans import queries as plans
from maskwright.plans import run


def plan_of(df) -> str:  # noqa: ANN001
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("name", "test"), [("detect_email", "Contains(text"), ("detect_phone", "text#")])
def test_texts_without_a_value_are_not_cut_into_lines(spark, sf_dir, name, test):
    below = plan_of(plans.queries()[name](spark, sf_dir)).partition("Generate posexplode")[2]
    assert test in below and ("RLIKE" in below or "Contains(text" in below)


@pytest.mark.parametrize("name", ["findings_by_doc", "token_first_encounter"])
def test_documents_are_folded_once(spark, sf_dir, name):
    assert "MapInArrow" not in plan_of(plans.queries()[name](spark, sf_dir))


def test_the_twin_needs_no_join(spark, sf_dir):
    assert "Join" not in plan_of(plans.queries()["native_twin"](spark, sf_dir))


def test_a_run_and_its_audit_read_the_lines_twice(spark):
    reads = spark.sparkContext.accumulator(0)

    def row(i: int) -> tuple:
        reads.add(1)
        return i, 0, "SSN 123-45-6789" if i == 3 else "MAIL a@b.example" if i == 4 else "nothing here", False

    lines = spark.createDataFrame(spark.sparkContext.parallelize(range(40), 2).map(row), "doc_ord bigint, line_no int, line string, is_ocr boolean")
    assert run.redact(lines).audit.collect() == []
    assert reads.value == 80


def test_lines_and_texts_that_rules_may_touch(spark):
    texts = ["a\r\nb\rc", "a\r\n\r\n", "\n", "x\x85y ", "", None, "\r\n", "a\rb\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", split_lines(rows_col()).alias("l")).collect()
    assert [r["l"] for r in sorted(rows)] == [["a", "b", "c"], ["a", ""], [""], ["x", "y"], [], None, [""], ["a", "b"]]
    told = ["a1", "a@b", "ABCDEFABCDEF...", "abcdefab-abcd", "٣", "\U0001d7ce"]
    bare = ["plain text", "...", "ABCDEFAB", "well-known"]
    rows = spark.createDataFrame([(t,) for t in told + bare], "t string").filter(touchable(rows_col())).collect()
    assert {r["t"] for r in rows} == set(told)


def rows_col():  # noqa: ANN201
    from pyspark.sql import functions as F

    return F.col("t")


def test_preset_run_on_keys_of_six_digits_and_more(spark, tmp_path):
    keys = [0, 9, 10_000, 99_999, 100_000, 100_001, 899_999, 12_345_678]
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").coalesce(1).write.parquet(f"{tmp_path}/spark")
    next((tmp_path / "spark").glob("*.parquet")).rename(tmp_path / "customer.parquet")
    _, want = oracle(str(tmp_path), plans.oracle_sql()["preset_run"])
    assert rows_of(plans.queries()["preset_run"](spark, str(tmp_path))) == want


def test_addresses_of_one_host_are_not_filed_under_its_name(spark):
    rows = [("EMAIL", f"u{i}@mailhost.example.com") for i in range(50)]
    values = sweep.as_values(sweep.sweep_list(spark, rows))
    values.file()
    assert values.on("write to u7@mailhost.example.com", False)[2] == [s for s in values.sweeps if s[1] == "u7@mailhost.example.com"]
