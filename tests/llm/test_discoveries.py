"""op5's control of false discoveries, and its time on long texts."""

from __future__ import annotations

import random
import time

from test_contracts import frame

from maskwright.llm.secret_scan import ALPHABETS, BINS, LEAK, _threshold, secret_scan


def hist(ps: list[float]) -> list[int]:
    out = [0] * BINS
    for p in ps:
        out[min(BINS - 1, int(p * BINS))] += 1
    return out


def test_share_of_false_ones_on_mixes():
    """Random strings with uniform p, ordinary ones near 0 of which LEAK are spread like random ones."""
    rnd = random.Random(1)
    for n, m in ((2000, 100), (2000, 1000), (500, 200), (5000, 5000)):
        shares, taken = [], []
        for _ in range(30):
            true = [rnd.random() for _ in range(n)]
            false = [rnd.random() if rnd.random() < LEAK else rnd.random() ** 6 * 0.2 for _ in range(m)]
            t = _threshold(hist(true + false), hist([rnd.random() for _ in range(n + m)]), 0.05)
            if t is not None:
                got = sum(p >= t for p in true)
                bad = sum(p >= t for p in false)
                shares.append(bad / max(1, got + bad))
                taken.append(got / n)
        assert not shares or sum(shares) / len(shares) <= 0.06, (n, m)
        assert m > n // 2 or sum(taken) / max(1, len(taken)) > 0.75, (n, m)


def test_nothing_is_reported_where_nothing_is_random():
    rnd = random.Random(2)
    quiet = sum(_threshold(hist([rnd.random() ** 4 for _ in range(500)]), hist([rnd.random() for _ in range(500)]), 0.05) is None for _ in range(20))
    assert quiet >= 19
    assert _threshold([50] + [0] * (BINS - 1), hist([rnd.random() for _ in range(50)]), 0.05) is None


def test_p_that_are_not_uniform_are_judged_by_their_twins():
    rnd = random.Random(3)
    skewed = lambda: rnd.random() ** 0.5
    t = _threshold(hist([skewed() for _ in range(3000)] + [0.0] * 300), hist([skewed() for _ in range(3300)]), 0.05)
    assert t is not None and t <= 0.2


def test_copies_of_a_string_count_once(spark):
    """A string that stands in very many documents doesn't make its group look random."""
    rnd = random.Random(4)
    keys = ["".join(rnd.choices(ALPHABETS["base62"], k=40)) for _ in range(80)]
    rows = [f"value {k} here" for k in keys] + [f"value getTheCustomerOrderLineItem{i}ForTheSupplierName here" for i in range(10) for _ in range(60)]
    found = {r["doc_id"]: len(r["random"]) for r in secret_scan(frame(spark, [(i, t, None, None, None, "", 0) for i, t in enumerate(rows)])).collect()}
    assert sum(found[i] for i in range(80)) >= 60 and sum(found[i] for i in range(80, len(rows))) <= 60


def test_time_grows_with_the_text(spark):
    took = []
    for n in (300, 4000, 8000):
        said = "".join(f"token={i:012d}x AKIA{i:016d} {'0123456789abcdef' * 2} " for i in range(n))
        began = time.time()
        (row,) = secret_scan(frame(spark, [(1, said, None, None, None, "", 0)])).collect()
        took.append(time.time() - began)
        assert sum(x["kind"] == 0 for x in row["base"]) == n and sum(x["kind"] == 1 for x in row["base"]) == n
    assert took[2] < 3 * took[1] + 5
