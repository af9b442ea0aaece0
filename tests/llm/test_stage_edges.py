"""The pipeline's stages: planted cases, and what each does with nulls, empty and long texts, repeats and empty tables."""

from __future__ import annotations

import pytest
from test_contracts import A, frame

import corpus_pipeline
from maskwright.llm import queries as llm
from maskwright.llm.stages import DOCUMENTS

PASSAGE = "which of the seven rivers of the old kingdom flows past the mill with the broken wheel"
CLEAN = "an entirely other story about a boat and the people who mended it in the spring"
FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, nth int, sha string, lang_pred int"


def docs_of(spark, rows):  # noqa: ANN001, ANN201
    """Documents with columns whose names the stages use themselves."""
    return spark.createDataFrame([(i, t, "en" if t else None, "hot", len(t or ""), "k", 1, "s", 0) for i, t in rows], FIELDS)


@pytest.fixture
def items_dir(spark, tmp_path):  # noqa: ANN001, ANN201
    spark.createDataFrame([("q1", PASSAGE), ("q2", None), (None, CLEAN), ("q3", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_a_passage_of_one_item_is_enough(spark, items_dir):
    rows = [(1, f"before it {PASSAGE} after it"), (2, CLEAN), (3, " ".join(PASSAGE.split()[2:11])), (4, " ".join(PASSAGE.split()[:7])), (5, PASSAGE.upper()), (None, PASSAGE), (2, CLEAN), (6, None), (7, "")]
    left = corpus_pipeline.decontamination(spark, docs_of(spark, rows), items_dir)
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [2, 2, 4, 6, 7]


EDGES = [(1, None), (2, ""), (3, "  \n\t"), (4, "42 !?"), (5, A), (5, A), (None, A), (None, None), (6, "word " * 40_000), (7, "é" * 3000), (8, CLEAN), (9, f"{A} {CLEAN}")]


def test_language_stage(spark, items_dir):
    got = corpus_pipeline.language_id(spark, docs_of(spark, EDGES), items_dir)
    assert got.columns == list(DOCUMENTS)
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 5, 5, 6, 7, 8, 9]  # texts with a letter
    unlabelled = docs_of(spark, EDGES).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert sorted((r["doc_id"] or 0) for r in corpus_pipeline.language_id(spark, unlabelled, items_dir).collect()) == [0, 5, 5, 6, 7, 8, 9]


def test_exact_stage(spark, items_dir):
    got = corpus_pipeline.exact_dedup(spark, docs_of(spark, EDGES), items_dir)
    assert got.columns == list(DOCUMENTS)
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]
    # one of the four without a character, the longest original; one of the three copies, the smallest id
    assert sorted(rows, key=str) == sorted([(3, "  \n\t"), (4, "42 !?"), (None, A), (6, "word " * 40_000), (7, "é" * 3000), (8, CLEAN), (9, f"{A} {CLEAN}")], key=str)


def test_near_stage(spark, items_dir):
    near = f"{A} {A[::-1]}"
    rows = [*EDGES, (20, f"{near} x"), (21, f"{near} y"), (22, f"{near} z")]
    got = corpus_pipeline.near_dedup(spark, docs_of(spark, rows), items_dir)
    assert got.columns == list(DOCUMENTS)
    ids = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in got.collect())
    assert ids == [-1, -1, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 20]


def test_pieces_stage(spark, items_dir):
    got = {(r["doc_id"], r["n_chars"]): r["ids"] for r in corpus_pipeline.sentencepiece(spark, docs_of(spark, EDGES), items_dir).collect()}
    assert got[1, 0] == [] and got[2, 0] == [] and len(got[6, 200_000]) >= 40_000 and got[5, len(A)] == got[None, len(A)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, items_dir, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, docs_of(spark, []).filter("false"), items_dir).count() == 0


def test_pipeline_on_a_table_with_every_case(spark, items_dir):
    rows = [*EDGES, (30, f"{CLEAN} and {PASSAGE}"), (31, f"{CLEAN}  "), (32, "and one more that nobody has written before")]
    docs_of(spark, rows).write.parquet(f"{items_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, items_dir)
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got.collect()) == [-1, 6, 7, 9, 31, 32]
    assert frame(spark).columns  # the other tests' table is another


def test_columns_with_clashing_names_change_nothing(spark):
    clash = {c: "x" for c in ("range", "rep", "grp", "covered", "segment", "class", "keys", "w", "base", "candidates", "marks", "part", "seq", "file", "block", "digest", "norm", "key", "u", "v", "n")}
    plain = frame(spark).select("doc_id", "text", "lang")
    extra = plain.selectExpr("*", *(f"'{v}' as `{k}`" for k, v in clash.items()))
    from maskwright.llm.exact_dedup import exact_dedup
    from maskwright.llm.license_scan import license_scan
    from maskwright.llm.near_dedup import near_duplicates
    from maskwright.llm.secret_scan import secret_scan
    from maskwright.llm.substring_dedup import substring_dedup
    from maskwright.llm.token_counts import token_counts

    for run in (exact_dedup, license_scan, near_duplicates, secret_scan, substring_dedup, lambda d: token_counts(d, llm.BYTE_BPE).drop("file", "nth")):
        told = lambda df: sorted(map(str, run(df).collect()))  # noqa: B023, E731
        assert told(extra) == told(plain)
