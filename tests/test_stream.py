"""The fold over a stream gives what the fold over a table gives, also when it is started again."""

from __future__ import annotations

from maskwright.operators import dictionary, tokens
from maskwright.operators.fold import fold
from maskwright.streaming import fold_stream

LINES = "doc_ord bigint, line_no int, line string, is_ocr boolean"


def test_stream_of_lines(spark, tmp_path):
    entries = dictionary.make_entries([("name", "JOHN SAMPLE")])
    source, out, marks = (f"{tmp_path}/{x}" for x in ("source", "out", "marks"))
    first = [(1, 0, "SSN 123-45-6789 of JOHN SAMPLE", False), (1, 1, "nothing", False)]
    second = [(2, 0, "call (555) 123-4567", False), (2, 1, "SSN 123 45 6789", False)]
    for rows in (first, second):
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LINES).parquet(source)
        fold_stream.start(stream, out, marks, entries, once=True).awaitTermination()
    got = fold_stream.folded(spark, out)
    want = fold(spark.createDataFrame(first + second, LINES), entries, dictionary.name_parts(entries))
    told = lambda df: sorted(map(str, df.select("doc_ord", "line_no", "line", "pieces", "hits").collect()))
    assert told(got) == told(want)
    hits = tokens.explode_hits(got)
    named = {(r["doc_ord"], r["kind"]): r["token"] for r in tokens.with_tokens(hits, tokens.token_table(hits)).collect()}
    assert named[1, "SSN"] == named[2, "SSN"] == "[SSN-1]"
