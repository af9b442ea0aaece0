"""Which of many values a line can hold, found without trying each.

A value that is bounded by non-word characters has each of its runs of word
characters as a whole run in any line that holds it; a number bounded by
non-digits has its runs of digits so. Text from OCR drops spaces, so there the
first letters and digits of a value, without anything between them, are looked
for among all runs of GRAM letters and digits of the line. Each value is filed
under a few such keys, and a line meets only the values under its own.

Keys: a word in lower case, `#` and a run of digits, `~` and a gram; in joins the
empty string stands for values that any line may hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4
#: Values up to so many go to every task; more meet the lines in a join.
SHIPPED = 20_000
#: Words that stand in very many lines, so a value isn't filed under them if it has others.
COMMON = frozenset("street avenue road drive lane court place north south east west suite apartment box page line form com net org the and inc llc of bank".split())


def folded_case(s: str) -> str:
    return s.upper().lower()


def bare(s: str) -> str:
    """Letters and digits alone."""
    return re.sub(r"[\W_]", "", folded_case(s))


def telling_word(s: str) -> str | None:
    """The word that a value is filed under: the longest that isn't a common one, of equal ones the first."""
    words = re.findall(r"\w+", folded_case(s))
    return max(words, key=lambda w: (w not in COMMON, len(w)), default=None)


def line_keys(line: str, ocr: bool) -> set[str]:
    found = set(re.findall(r"\w+", folded_case(line))) | {f"#{d}" for d in re.findall(r"\d+", line)}
    if ocr:
        run = bare(line)
        found |= {f"~{run[i : i + GRAM]}" for i in range(len(run) - GRAM + 1)}
    return found


class Filed:
    """Values by key, for the lines of a task. keys: for each value its keys, or None if any line may hold it."""

    def __init__(self, strict: Sequence[Iterable[str] | None], ocr: Sequence[Iterable[str] | None]):
        self.tables = []
        for side in (strict, ocr):
            table: dict[str, list[int]] = {}
            always = []
            for n, keys in enumerate(side):
                if keys is None:
                    always.append(n)
                for k in keys or ():
                    table.setdefault(k, []).append(n)
            self.tables.append((table, always))

    def of(self, line: str, ocr: bool) -> list[int]:
        """Numbers of the values that a line may hold, in order."""
        table, always = self.tables[ocr]
        if not table:
            return always
        return sorted({n for k in line_keys(line, ocr) & table.keys() for n in table[k]}.union(always))


# ------------------------------------------------------------------- as columns


def words_column(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.upper(line)), F.lit(r"(?U)\w+"), F.lit(0))


def bare_column(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.upper(text)), r"(?U)[\W_]", "")


def keys_column(line: Column, ocr: Column) -> Column:
    """line_keys of a line, and the empty key."""
    numbers = F.transform(F.regexp_extract_all(line, F.lit(r"(?U)\d+"), F.lit(0)), lambda d: F.concat(F.lit("#"), d))
    run = bare_column(line)
    grams = F.when(F.length(run) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(run) - GRAM + 1), lambda i: F.concat(F.lit("~"), F.substring(run, i, F.lit(GRAM)))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(F.lit("")), words_column(line), numbers, F.coalesce(F.when(ocr, grams), none)))


def telling_word_column(value: Column) -> Column:
    """telling_word of a value."""
    rank = F.transform(words_column(value), lambda w, i: F.struct((~w.isin(*COMMON)).alias("rare"), F.length(w).alias("n"), (-i).alias("at"), w.alias("w")))
    return F.array_max(rank)["w"]


def meet(lines: DataFrame, offers: DataFrame, order: list[str], name: str) -> DataFrame:
    """Lines (doc_ord, line_no, line, is_ocr, ...) with an array `name` of the offers (key, on_ocr, the columns of order) whose
    key they have, in that order. The offers are broadcast if they are few, which is counted first."""
    few = offers.limit(SHIPPED + 1).count() <= SHIPPED
    keyed = lines.select("doc_ord", "line_no", F.col("is_ocr").alias("on_ocr"), F.explode(keys_column(F.col("line"), F.col("is_ocr"))).alias("key"))
    met = keyed.join(F.broadcast(offers) if few else offers, ["key", "on_ocr"])
    lists = met.groupBy("doc_ord", "line_no").agg(F.array_sort(F.collect_set(F.struct(*order))).alias(name))
    return lines.join(lists, ["doc_ord", "line_no"], "left")
