"""op3's detections without its prefilter: no keyword may hide a rule's match."""

from __future__ import annotations

import random
import re
from re import _constants as sre
from re import _parser

from test_contracts import frame, lower

from maskwright.llm.license_scan import RULES, license_scan


def match_of(rnd: random.Random, pattern) -> str:  # noqa: ANN001
    """A random text that the pattern matches."""
    out = ""
    for op, arg in pattern:
        if op is sre.LITERAL:
            out += chr(arg)
        elif op is sre.IN:
            kind, x = rnd.choice(arg)
            out += chr(x if kind is sre.LITERAL else rnd.randint(*x))
        elif op is sre.BRANCH:
            out += match_of(rnd, rnd.choice(arg[1]))
        elif op is sre.SUBPATTERN:
            out += match_of(rnd, arg[3])
        else:
            assert op in (sre.MAX_REPEAT, sre.MIN_REPEAT), op
            out += "".join(match_of(rnd, arg[2]) for _ in range(rnd.randint(arg[0], min(arg[1], arg[0] + 2))))
    return out


def test_each_match_holds_its_keyword():
    rnd = random.Random(1)
    words: dict[tuple, set] = {}
    for r in RULES:
        words.setdefault((r.label, r.pattern), set()).add(r.keyword)
    for (label, pattern), keywords in words.items():
        for _ in range(30):
            assert keywords & set(match_of(rnd, _parser.parse(pattern)).split()), (label, pattern)


def labels(spark, said: list[str]) -> list[set]:  # noqa: ANN001
    got = license_scan(frame(spark, [(i, t, None, None, None, "", 0) for i, t in enumerate(said)])).collect()
    return [{x["label"] for x in r["found"]} for r in sorted(got, key=lambda r: r["doc_id"])]


def test_short_forms_and_spdx_ids(spark):
    want = {
        "under GPLv2": "gpl", "GPLv3 or later": "gpl", "gpl3": "gpl", "GPL v2": "gpl", "gplv 2.0": "gpl", "LGPLv2.1": "lgpl", "LGPL2.1": "lgpl", "AGPLv3": "agpl", "MPLv2.0": "mpl",
        "EPL-2.0": "epl", "BSD3": "bsd", "SPDX-License-Identifier: Apache-2.0": "apache", "SPDX-License-Identifier: MS-PL": "ms-pl", "SPDX-License-Identifier: Python-2.0": "python",
        "SPDX-License-Identifier: PSF-2.0": "python", "SPDX-License-Identifier: BSD-3-Clause": "bsd", "SPDX-License-Identifier: 0BSD": "bsd", "SPDX-License-Identifier: LPPL-1.3c": "lppl",
        "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl", "SPDX-License-Identifier: MIT-0": "mit",
    }
    assert [(t, label, label in found) for (t, label), found in zip(want.items(), labels(spark, list(want)), strict=True)] == [(t, label, True) for t, label in want.items()]


def test_detections_equal_those_of_all_rules_without_the_gate(spark):
    rnd = random.Random(2)
    short = [f"{s}{v}{n}" for s in ("gpl", "LGPL", "agpl", "mpl", "asl", "bsd", "epl") for v in ("", "v", " v", "V ", " ") for n in ("1.0", "2", "2.1", "3", "3.0 only")]
    said = [" ".join([*rnd.choices(short, k=4), match_of(rnd, _parser.parse(rnd.choice(RULES).pattern)), rnd.choice(short)]) for _ in range(120)]
    got = labels(spark, said)
    for t, found in zip(said, got, strict=True):
        line = f" {' '.join(re.findall('[0-9a-z]+', lower(t)))} "
        hits = []
        for nth, r in enumerate(RULES):
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line):
                hits.append((r.priority, m.start() - m.end(), nth, m.start(), m.end(), r.label))
        kept: list[tuple] = []
        for h in sorted(hits):
            if not any(k[3] <= h[3] and h[4] <= k[4] for k in kept):
                kept.append(h)
        assert found == {h[5] for h in kept}, t
