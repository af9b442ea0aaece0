"""op9's code lengths against a plain PPM that counts in dictionaries; ties and texts without a language."""

from __future__ import annotations

import math
import random
from itertools import pairwise

import numpy as np
from test_contracts import frame

from maskwright.llm.lang_ppm import ORDER, PAD, Ppm, identify, language_id


class Counted:
    """PPM by its definition, over all 256 bytes."""

    def __init__(self, texts: list[bytes]):
        self.seen: dict[bytes, dict[int, int]] = {}
        for t in texts:
            padded = bytes([PAD] * ORDER) + t
            for i in range(len(t)):
                for k in range(ORDER + 1):
                    after = self.seen.setdefault(padded[i + ORDER - k : i + ORDER], {})
                    after[t[i]] = after.get(t[i], 0) + 1

    def chances(self, context: bytes | None) -> dict[int, float]:
        if context is None:
            return dict.fromkeys(range(256), 1 / 256)
        shorter = self.chances(context[1:] if context else None)
        if context not in self.seen:
            return shorter
        n = self.seen[context]
        total, kinds = sum(n.values()), len(n)
        left = sum(p for s, p in shorter.items() if s not in n)
        return {s: n[s] / (total + kinds) if s in n else kinds / (total + kinds) * shorter[s] / left for s in range(256)}

    def bits(self, t: bytes) -> float:
        padded = bytes([PAD] * ORDER) + t
        return -sum(math.log2(self.chances(padded[i : i + ORDER])[t[i]]) for i in range(len(t)))


def test_code_lengths_are_those_of_the_definition():
    rnd = random.Random(2)
    samples = {
        "aa": [bytes(rnd.choices(b"abcde  \n", k=250)) for _ in range(4)],
        "bb": [bytes(rnd.choices("defgé ü".encode(), k=200)) for _ in range(4)] + [b""],
        "cc": [b"z", "漢字かな交じり文".encode()],
    }
    model = Ppm(samples)
    texts = [b"abc de abf zz", b"", b"\xff\xfe q", "漢字 z".encode(), bytes(rnd.choices(b"abcdefg ", k=80)), b"\n\n\n", bytes(range(256))]
    ends = np.cumsum([0] + [len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    want = [[Counted(samples[k]).bits(t) for k in model.langs] for t in texts]
    for most in (1 << 20, 7):  # in parts, too
        assert np.allclose(model.code_lengths(data, ends, most), want, rtol=1e-9, atol=1e-7)


def test_model_grows_with_its_samples_only():
    rnd = random.Random(3)
    langs = {f"l{i}": [bytes(rnd.choices(range(32, 256), k=400))] for i in range(60)}
    model = Ppm(langs)
    cells = sum(len(table[0]) + len(table[2]) for tables in model.tables for table in tables)
    assert cells <= 60 * (2 * 4 * 400 + 2 * 257)
    assert all(a < b for tables in model.tables for table in tables for a, b in pairwise(table[0].tolist()))


def test_ties_nulls_and_letterless_texts(spark):
    same = Ppm({"yy": [b"one text"], "xx": [b"one text"]})
    rows = [(1, "one text"), (2, None), (3, ""), (4, "123 !?"), (None, "one"), (5, "é"), (5, "é"), (6, "一")]
    docs = frame(spark, [(i, t, None, None, None, "", 0) for i, t in rows])
    got = sorted((r["doc_id"] or 0, r["lang_pred"], round(r["score"], 6)) for r in identify(docs, same).collect())
    assert got == [(0, "xx", 0.5), (1, "xx", 0.5), (2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (5, "xx", 0.5), (5, "xx", 0.5), (6, "xx", 0.5)]
    unlabelled = language_id(docs).collect()
    assert len(unlabelled) == len(rows) and {r["lang_pred"] for r in unlabelled} == {"und"}
