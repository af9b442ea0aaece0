"""Which lines rules are asked for: what every match of a pattern has, by the pattern itself."""

from __future__ import annotations

import re

import pytest
from re import _constants as c
from re import _parser

from maskwright.functions.patterns import DIGITS, RULES, loosened
from maskwright.operators.fold import MARKS, fold_line


def demands(items, holds) -> int:  # noqa: ANN001
    """The most that any part gives which each match has; holds: of a single character's node, 1 or 0."""
    return max((part(op, arg, holds) for op, arg in items), default=0)


def part(op, arg, holds) -> int:  # noqa: ANN001
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        low, _, sub = arg
        each = demands(sub, holds)
        return 0 if low == 0 else low * each if len(sub) == 1 and sub[0][0] in (c.IN, c.LITERAL) else each
    if op == c.SUBPATTERN:
        return demands(arg[3], holds)
    if op == c.BRANCH:
        return min(demands(x, holds) for x in arg[1])
    if op == c.ASSERT:
        return demands(arg[1], holds)
    return holds(op, arg)


def digit(op, arg) -> int:  # noqa: ANN001
    return int(op == c.IN and arg == [(c.CATEGORY, c.CATEGORY_DIGIT)])


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.name)
@pytest.mark.parametrize("ocr", [False, True])
def test_every_match_has_the_digits_or_a_mark(rule, ocr):
    tree = _parser.parse(loosened(rule.pattern) if ocr else rule.pattern)
    run = DIGITS.get(rule.name, 1)
    assert demands(tree, digit) >= run
    if not run:
        literals = [m for m in MARKS if all(demands(tree, lambda op, arg: int(op == c.LITERAL and chr(arg) == x)) for x in m)]  # noqa: B023
        assert literals
    if rule.name in ("signer_id", "envelope"):
        hexes = lambda op, arg: int(op == c.IN and (c.RANGE, (65, 70)) in arg)
        assert demands(tree, hexes) >= 8


def test_gates_are_asked_on_the_untouched_line_and_bars_on_what_is_left():
    assert fold_line("SSN 123456789").text == "SSN [SSN-Z]"
    assert fold_line("code 123456789").text == "code [ACCT-Z]"
    assert fold_line("FORM for SAMPLETOWN, CA 90000").text == "FORM for SAMPLETOWN, CA 90000"
    assert not re.search(r"\d{8}", fold_line("REF 12345678 and 123-45-6789").text)
