"""Column functions over text: normal forms, line ends, the digit-lookalike shadow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import DIGIT_KINDS, LINE_ENDS, LOOKALIKE

_ENDS = "[" + LINE_ENDS + "]"


def split_lines(text: Column) -> Column:
    """Lines of a text: an end at the very end gives no further line, an empty text none; null stays null."""
    cut = lambda n: F.substring(text, F.lit(1), F.length(text) - n)
    whole = F.when(F.endswith(text, F.lit("\r\n")), cut(2)).when(F.substring(text, -1, 1).isin(*LINE_ENDS), cut(1)).otherwise(text)
    # a class alone is found in less than half the time
    split = F.when(F.contains(text, F.lit("\r\n")), F.split(whole, "\r\n|" + _ENDS, -1)).otherwise(F.split(whole, _ENDS, -1))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(split)


def touchable(text: Column) -> Column:
    """Whether a pattern rule, or a value that one has found, may stand in a text: each has a digit or an @, but for signer's
    numbers and envelopes, which have eight hex letters in a row, and dots or hyphens. A text has what any of its lines has."""
    return text.rlike(r"[\p{Nd}@]") | ((text.contains("...") | text.contains("-")) & text.rlike("[0-9A-Fa-f]{8}"))


def norm_value(value: Column) -> Column:
    """White space collapsed, upper case."""
    return F.upper(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))


def token_value(kind: Column, value: Column) -> Column:
    """What makes two values the same identity: digits alone for numbers, else norm_value."""
    return F.when(kind.isin(*DIGIT_KINDS), F.regexp_replace(value, r"(?U)\D", "")).otherwise(norm_value(value))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s", "")


def shadow(text: Column) -> Column:
    """Letters that look like digits, next to a digit of the text as it is, read as digits. The length stays."""
    chars = F.split(text, "")
    digit = lambda c: F.coalesce(c, F.lit("")).rlike(r"\p{Nd}")
    table = F.create_map(*(F.lit(x) for kv in LOOKALIKE.items() for x in kv))
    turn = lambda c, i: F.when(c.isin(*LOOKALIKE) & (digit(F.get(chars, i - 1)) | digit(F.get(chars, i + 1))), F.element_at(table, c)).otherwise(c)
    return F.when(text == "", text).otherwise(F.array_join(F.transform(chars, turn), ""))
