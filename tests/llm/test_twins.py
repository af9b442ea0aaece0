"""Operators without SQL, whole results against plain Python."""

from __future__ import annotations

import random
import re
import string
import zlib
from collections import defaultdict
from math import erfc, isclose, sqrt

from pyspark.sql import functions as F
from test_contracts import WORD, frame, lower, texts

from maskwright.llm import queries as llm
from maskwright.llm.license_scan import BASE, RULES, license_scan
from maskwright.llm.secret_scan import ALPHABETS, _candidate, secret_scan
from maskwright.llm.sp_codec import decode, encode, round_trip
from maskwright.llm.substring_dedup import MIN_WORDS, RUN, substring_dedup


def sentences(t: str) -> list[tuple[int, int, list[str]]]:
    edges = [0] + [i + 1 for i, c in enumerate(t) if c == "\n" or (c in ".!?" and t[i + 1 : i + 2] and t[i + 1] in " \t\n\v\f\r")] + [len(t)]
    out: list[tuple[int, int, list[str]]] = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            words = WORD.findall(lower(t[a:b]))
            if words or not out:
                out.append((a, b, words))
            else:
                out[-1] = (out[-1][0], b, out[-1][2])
    return out


def prose(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    stock = [" ".join(rnd.choice(["Straße", "wort", "Tree", "lake", "3.5", "x_y", "漢字", "run"]) for _ in range(rnd.randint(1, 8))) + rnd.choice([".", "!", "?!", " ", "…"]) for _ in range(25)]
    rows = []
    for i in range(60):
        start = rnd.randrange(len(stock))
        picked = [stock[(start + k) % len(stock)] if rnd.random() < 0.9 else rnd.choice(stock) for k in range(rnd.randint(0, 14))]
        rows.append((i, rnd.choice(["", "\n\n", "… "]) + "".join(p + rnd.choice(["\n", ".\n\n", "! "]) for p in picked)))
    return [*rows, (70, None), (71, ""), (72, " \n "), (None, rows[3][1]), (3, rows[3][1])]


def test_substring_dedup_against_plain_python(spark):
    rows = prose(5)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_sentences"], r["n_removed"], r["words_removed"], r["removed"], r["text"] or "") for r in substring_dedup(frame(spark, [(i, t, None, None, None, "", 0) for i, t in rows])).collect())
    runs = defaultdict(set)
    for i, t in rows:
        s = sentences(t or "")
        for at in range(len(s) if i is not None else 0):
            assert len(s[at][2]) <= 20
            for end in range(at + RUN, len(s) + 1):
                words = tuple(w for x in s[at:end] for w in x[2])
                if s[at][2] and len(words) >= MIN_WORDS:  # every run, however long, that begins with words
                    runs[words].add((i, at, end))
    gone = defaultdict(set)
    for places in runs.values():
        for i, at, end in sorted(places)[1:]:
            gone[i] |= set(range(at, end))
    want = []
    for i, t in rows:
        s = sentences(t or "")
        out = sorted(gone[i]) if i is not None else []
        spans: list[list[int]] = []
        for k in out:
            if spans and spans[-1][1] == s[k][0]:
                spans[-1][1] = s[k][1]
            else:
                spans.append([s[k][0], s[k][1]])
        kept = "".join(t[x[0] : x[1]] for k, x in enumerate(s) if k not in out) if t else ""
        want.append((i is None, i or 0, len(s), len(out), sum(len(s[k][2]) for k in out), ",".join(f"{a}:{b}" for a, b in spans), kept))
    assert got == sorted(want)
    assert sum(bool(x[3]) for x in got) > 10


def test_long_passages_without_sentences_are_removed_but_for_their_ends(spark):
    rnd = random.Random(9)
    words = lambda n: " ".join("".join(rnd.choices(string.ascii_lowercase, k=6)) for _ in range(n))
    passage = words(200)
    rows = [(i, f"{words(60)} {passage} {words(60)}", None, None, None, "", 0) for i in range(3)]
    got = {r["doc_id"]: r["words_removed"] for r in substring_dedup(frame(spark, rows)).collect()}
    assert got[0] == 0 and got[1] == got[2] and 140 <= got[1] <= 200


def test_decoded_pieces_are_those_of_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=llm.PIECES)
    more = ["  two  spaces ", "a▁b ▁ c", "tab\tand\nline", "\U0001f600 🏳️‍🌈 é é", " ", "x\u0000y"]
    rows = [(i, t, None, None, None, "", 0) for i, t in enumerate([*texts(), *more])]
    docs = frame(spark, rows)
    back = {r["doc_id"]: r["text"] for r in decode(encode(docs, llm.PIECES), llm.PIECES).collect()}
    trip = {r["doc_id"]: r for r in round_trip(docs, llm.PIECES).collect()}
    for i, t, *_ in rows:
        ids = sp.encode(t or "")
        want = sp.decode(ids) if ids else ""
        assert back[i] == want, i
        assert (trip[i]["n_bytes"], trip[i]["decoded_crc32"], trip[i]["exact"]) == (len(want.encode()), zlib.crc32(want.encode()), want == (t or "")), i


def test_license_detections_against_plain_python(spark):
    said = [
        "Licensed under the Apache License, Version 2.0 (the License)", "GNU Lesser General Public License v2.1 or later", "CC BY-SA 4.0 International; cc by",
        "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL 2.0 or later. All rights reserved. Copyright (c) 2019", "the mit license and a bsd license, 3 clause bsd license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "creative commons attribution share alike 3.0 license", "mit license mit license mit license", "license", "", None,
    ]
    rnd = random.Random(3)
    bits = " ".join(s for s in said if s).split()
    said += [" ".join(rnd.choices(bits, k=80)) for _ in range(30)] + [" ".join(rnd.choices([s for s in said if s], k=12))]
    got = {r["doc_id"]: r for r in license_scan(frame(spark, [(i, t, None, None, None, "", 0) for i, t in enumerate(said)])).collect()}
    for i, t in enumerate(said):
        words = WORD.findall(lower(t or ""))
        line = f" {' '.join(words)} "
        base = [(label, k, k + len(p.split())) for p, label in BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert sorted((x["label"], x["a"], x["b"]) for x in got[i]["base"]) == sorted(base), t
        hits = []
        for nth, r in enumerate(RULES):
            if r.keyword in words:
                for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line):
                    a = line.count(" ", 0, m.start()) - 1
                    b = a + m[0].count(" ") + 1
                    hits.append((r.priority, a - b, nth, a, b, r.label))
        kept: list[tuple] = []
        for h in sorted(hits):
            if not any(k[3] <= h[3] and h[4] <= k[4] for k in kept):
                kept.append(h)
        assert [(x["label"], x["a"], x["b"]) for x in got[i]["found"]] == [(h[5], h[3], h[4]) for h in kept], t


def battery(s: str, enc: str) -> float:
    alphabet, n = ALPHABETS[enc], len(s)
    k, v = len(alphabet), [alphabet.index(c) + 1 for c in s]
    tail = lambda z: erfc(z / sqrt(2)) / 2
    chi = k / n * sum(s.count(c) ** 2 for c in alphabet) - n
    high = [x > (k + 1) / 2 for x in v]
    up = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mu = 2 * up * (n - up) / n + 1
    mean = sum(v) / n
    lag = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:], strict=False)) / max(sum((x - mean) ** 2 for x in v), 1e-9)
    zs = [(chi - (k - 1)) / sqrt(2 * (k - 1) * (1 - 1 / n)), abs((runs - mu) / sqrt(max((mu - 1) * (mu - 2) / (n - 1), 1e-9))), abs((lag + 1 / n) * sqrt(n))]
    return 1 - (1 - min(1.0, tail(zs[0]), 2 * tail(zs[1]), 2 * tail(zs[2]))) ** 3


def test_randomness_battery_against_plain_python(spark):
    rnd = random.Random(4)
    given = [(enc, "".join(rnd.choices(a, k=n))) for enc, a in ALPHABETS.items() for n in (24, 40, 90) for _ in range(3)]
    rows = spark.createDataFrame([(i, f"漢: {s} end") for i, (_, s) in enumerate(given)], "i int, t string").coalesce(1)
    got = dict(rows.select("i", _candidate(F.col("t"))).collect())
    for i, (enc, s) in enumerate(given):
        (found,) = got[i]
        names = list(ALPHABETS)
        assert (found["a"], found["b"]) == (3, 3 + len(s))
        assert isclose(found["p"], battery(s, names[found["grp"] // 10 - 1]), rel_tol=1e-4, abs_tol=1e-6), (enc, s)


def test_random_strings_are_found_and_names_are_not(spark):
    rnd = random.Random(8)
    keys = ["".join(rnd.choices(ALPHABETS["base62"], k=40)) for _ in range(60)]
    names = [f"getTheCustomerOrderLineItem{i}ForTheSupplierName" for i in range(60)]
    rows = [(i, f"value {x} here", None, None, None, "", 0) for i, x in enumerate(keys + names)]
    found = {r["doc_id"]: len(r["random"]) for r in secret_scan(frame(spark, rows)).collect()}
    assert sum(found[i] for i in range(60)) >= 48 and sum(found[i] for i in range(60, 120)) <= 6
