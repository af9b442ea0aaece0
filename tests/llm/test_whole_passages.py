"""Repeated passages are removed whole: op4 against all runs of sentences, by brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from test_contracts import frame
from test_twins import prose, sentences

from maskwright.llm.substring_dedup import MIN_WORDS, RUN, substring_dedup


def removed(spark, rows: list[tuple]) -> list[tuple]:  # noqa: ANN001
    got = substring_dedup(frame(spark, [(i, t, None, None, None, "", 0) for i, t in rows]))
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["words_removed"], r["text"] or "") for r in got.collect())


def by_all_runs(rows: list[tuple]) -> list[tuple]:
    """Every run of at least RUN sentences and MIN_WORDS words, of whatever length; all but the first of equal ones go."""
    runs = defaultdict(set)
    for i, t in rows:
        s = sentences(t or "")
        for at in range(len(s) if i is not None else 0):
            for end in range(at + RUN, len(s) + 1):
                words = tuple(w for x in s[at:end] for w in x[2])
                if s[at][2] and len(words) >= MIN_WORDS:
                    runs[words].add((i, at, end))
    gone = defaultdict(set)
    for places in runs.values():
        for i, at, end in sorted(places)[1:]:
            gone[i] |= set(range(at, end))
    out = []
    for i, t in rows:
        s = sentences(t or "")
        left = [x for k, x in enumerate(s) if i is None or k not in gone[i]]
        out.append((i is None, i or 0, sum(len(x[2]) for x in s) - sum(len(x[2]) for x in left), "".join(t[x[0] : x[1]] for x in left) if t else ""))
    return sorted(out)


@pytest.mark.parametrize("seed", [5, 6])
def test_repeated_sentences_are_removed_as_by_all_runs(spark, seed):
    rows = prose(seed)
    want = by_all_runs(rows)
    assert removed(spark, rows) == want and sum(x[2] > 0 for x in want) > 10


def said(rnd: random.Random, *sizes: int) -> str:
    return "".join(" ".join("".join(rnd.choices("abcdefgh", k=9)) for _ in range(n)) + ". " for n in sizes)


def test_short_ends_of_repeated_runs_go_too(spark):
    rnd = random.Random(1)
    run = said(rnd, 20, 14, 10, 8)
    rows = [(i, said(rnd, 12) + run + said(rnd, 9)) for i in range(3)] + [(8, run), (9, "\n\n" + said(rnd, 8, 9, 7, 8))]
    assert [x[2] for x in removed(spark, rows)] == [0, 52, 52, 52, 0]


def test_passages_of_over_50_words_go_to_their_ends_without_sentences(spark):
    rnd = random.Random(2)
    common = ["the", "of", "and", "a", "to"]
    words = lambda n: " ".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choices("abcdefgh", k=9)) for _ in range(n))
    sizes = [51, 52, 60, 80] * 40
    rows = []
    for k, n in enumerate(sizes):
        passage = f"zz{k} {words(n - 2)} yy{k}"
        rows += [(2 * k, f"{words(rnd.randint(1, 40))} q{k} {passage} r{k} {words(30)}"), (2 * k + 1, f"{words(rnd.randint(1, 40))} s{k} {passage} t{k} {words(30)}")]
    assert [x[2] for x in removed(spark, rows)] == [m for n in sizes for m in (0, n)]


def test_passages_of_over_50_words_are_found_between_parts_of_sentences(spark):
    rnd = random.Random(3)
    rows, want = [], []
    for k, (a, mid, b) in enumerate([(15, (11, 10), 15), (15, (16, 5), 15), (14, (7, 7, 8), 15), (9, (20, 1), 15)]):
        head, whole, tail = said(rnd, a), said(rnd, *mid), said(rnd, b).rstrip(". ")
        rows += [(2 * k + j, f"{said(rnd, 12)}p{k}{j} {head}{whole}{tail} o{k}{j}. {said(rnd, 7)}") for j in range(2)]
        want += [0, sum(mid)]
    assert [x[2] for x in removed(spark, rows)] == want


def test_text_without_sentences_against_every_window_of_words(spark):
    rnd = random.Random(4)
    stock = " ".join(rnd.choices("abcdefgh", k=400)).split()
    rows = []
    for i in range(40):
        cuts = [(x := rnd.randrange(350), x + rnd.randint(5, 60)) for _ in range(6)]
        rows.append((i, " ".join(w for a, b in cuts for w in [*stock[a:b], f"u{i}"])))
    rows += [(50, "word " * 300), (51, None), (52, ""), (53, " ".join(stock[:19])), (54, " ".join(stock[:25]))]
    seen, want = set(), []
    for i, t in rows:
        w = (t or "").split()
        gone = set()
        for at in range(len(w) - MIN_WORDS + 1):
            run = tuple(w[at : at + MIN_WORDS])
            if run in seen:
                gone |= set(range(at, at + MIN_WORDS))
            seen.add(run)
        want.append((i, len(gone)))
    assert [(x[1], x[2]) for x in removed(spark, rows)] == want and sum(n > 0 for _, n in want) > 20
