"""A contaminated row takes no clean row of the same id, or of none, with it."""

from __future__ import annotations

from test_contracts import A, frame

from maskwright.llm.stages import without_benchmark


def test_each_row_has_its_own_verdict(spark):
    items = spark.createDataFrame([(1, A), (2, A)], "item_id bigint, text string")
    clean = "nothing of the sort stands here"
    rows = [(i, t, "en", "s", 0, "", 0) for i in (5, None) for t in (A, clean, clean)] + [(7, A, "en", "s", 0, "", 0), (8, clean, "en", "s", 0, "", 0)]
    got = [(r["doc_id"], r["text"]) for r in without_benchmark(frame(spark, rows), items).collect()]
    assert sorted(got, key=str) == sorted([(5, clean)] * 2 + [(None, clean)] * 2 + [(8, clean)], key=str)
