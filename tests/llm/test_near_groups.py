"""op10 against all pairs: the driver's documents, pairs at the threshold, hot buckets, and without the sketch."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_contracts import frame, shingles

from maskwright.llm import near_dedup
from maskwright.llm.near_dedup import near_duplicates, shingle_sets


def groups_of(texts: list[str | None]) -> list[int]:
    """The smallest number in each text's component, by comparing every pair that shares a shingle."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))
    at: dict = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, s in enumerate(sets):
        common: dict[int, int] = {}
        for g in s:
            for j in at.get(g, ()):
                common[j] = common.get(j, 0) + 1
            at.setdefault(g, []).append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_recall_on_the_drivers_documents(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    order = np.argsort(table["doc_id"])
    ids, texts = [table["doc_id"][i] for i in order], [table["text"][i] for i in order]
    want = {i: ids[g] for i, g in zip(ids, groups_of(texts), strict=True)}
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == want
    assert sum(i != g for i, g in want.items()) > 50


def at_threshold(rnd: random.Random, n: int) -> tuple[str, str]:
    """Two texts of n shingles each, of which just enough are shared."""
    words = [f"w{rnd.randrange(10**9)}" for _ in range(n + 4)]
    both = -(-6 * n // 7)  # b / (2 n - b) >= 3 / 4
    return " ".join(words), " ".join(words[: both + 4] + [f"x{rnd.randrange(10**9)}" for _ in range(n - both)])


@pytest.mark.parametrize("sketch", [True, False])
def test_pairs_at_the_threshold_are_linked(spark, sketch):
    rnd = random.Random(11)
    pairs = [at_threshold(rnd, rnd.choice([7, 14, 70, 210])) for _ in range(150)]
    for a, b in pairs[:20]:
        x, y = shingles(a), shingles(b)
        assert 75 <= 100 * len(x & y) / len(x | y) < 85
    rows = [(2 * i + k, t, None, None, None, "", 0) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows), sketch=sketch).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(150)) >= 149


def test_hot_bucket_in_blocks(spark, monkeypatch):
    """Loose copies of one text, few of which are linked to the first: blocks of the bucket meet two by two."""
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    texts = []
    for _ in range(220):
        words = list(base)
        for at in rnd.sample(range(60), rnd.choice([1, 1, 2])):
            words[at] = f"c{rnd.randrange(40)}"
        texts.append(" ".join(words))
    want = groups_of(texts)
    rows = [(i, t, None, None, None, "", 0) for i, t in enumerate(texts)]
    for size in (7, 500):
        monkeypatch.setattr(near_dedup, "BLOCK_ROWS", size)
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows)).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) > 1


def test_signatures_estimate_similarity():
    """SuperMinHash: the share of equal positions is the similarity, with less spread than independent ranks have."""
    rnd = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        a, b, c = (rnd.integers(0, 2**63, 30).astype(np.uint64) for _ in range(3))
        x, y = np.unique(np.concatenate([a, b])), np.unique(np.concatenate([a, c]))
        sig = near_dedup.superminhash([x, y], 128)
        errors.append((sig[0] == sig[1]).mean() - 1 / 3)
    spread = np.std(errors)
    assert abs(np.mean(errors)) < 0.02 and spread < 0.9 * (1 / 3 * 2 / 3 / 128) ** 0.5
    one, none = near_dedup.superminhash([x[:1], x[:0]], 128)
    assert len(set(one.tolist())) == 128 and (none == np.iinfo(np.uint64).max).all()


def test_sets_of_short_and_repeated_texts():
    sets = shingle_sets(pa.array(["a b", "A  b", "a b c d e f", None, "", "a a a a a a a", "x"]))
    assert [len(s) for s in sets] == [1, 1, 2, 0, 0, 1, 1] and (sets[0] == sets[1]).all() and sets[0] != sets[6]
