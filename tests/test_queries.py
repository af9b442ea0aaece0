"""Every query of the library without the llm subpackage, against its SQL."""

from __future__ import annotations

import pytest
from compare import oracle, rows_of

from maskwright.plans import queries as plans

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    df = plans.queries()[name](spark, sf_dir)
    names, want = oracle(sf_dir, SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def test_corpus_run_leaves_no_pattern_value(spark, sf_dir):
    lines = plans.queries()["redact_corpus"](spark, sf_dir).collect()
    assert lines and all("[" in r["redacted"] for r in lines)


def test_entry_imports_and_has_the_flagship(spark):
    import __spark_entry__

    assert "redact_corpus" in __spark_entry__.queries()
    assert __spark_entry__.entry(spark).columns == ["doc_ord", "line_no", "redacted"]
