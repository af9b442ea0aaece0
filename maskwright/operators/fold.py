"""The redaction fold: every rule sees what the rules before it have left.

A line goes through its phases in order: text of signature regions, dictionary
entries, split names (all first names, then all last names), pattern rules,
the same rules over the digit-lookalike shadow (OCR only), and swept values.
Replaced text stands in the line as a placeholder without digits ([SSN-Z]), so
no later rule can take a token's number for a value; numbers come later, when
all identities are known (tokens.py).

The fold needs offsets into the untouched line, which Spark's regex functions
don't give, so it runs over Arrow batches. `native_text` is its twin in Column
functions, for the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import CATEGORIES, DIGITS, LOOKALIKE, RULES, SHADOW_KINDS, Rule, compiled, for_java
from ..functions.text import touchable
from .dictionary import Entry, NameParts, entry_keys
from .keys import SHIPPED, Filed, meet, words_column

PRESET, LISTED, SPLIT, PATTERN, SHADOWED, SWEPT = range(6)
#: Keys of entries that are looked for in DataFrame functions before a line goes to Python; of more, every line does.
NATIVE_KEYS = 2000
#: Of which every match of a rule's pattern has one, if it has no digit.
MARKS = ("@", "...", "-")
HIT = "struct<phase:int,ord:int,reason:string,kind:string,original:string,value:string,start:int,end:int>"
PIECE = "struct<lit:string,hit:int>"
FOLDED = f"doc_ord bigint, line_no int, line string, is_ocr boolean, pieces array<{PIECE}>, hits array<{HIT}>"


def placeholder(kind: str) -> str:
    return f"[{kind}-Z]"


_BY_A_DIGIT = re.compile(rf"(?<=\d)[{''.join(LOOKALIKE)}]|[{''.join(LOOKALIKE)}](?=\d)")
_DIGIT_RUNS = re.compile(r"\d+")


def shadow_text(s: str) -> str:
    """functions.text.shadow of a line."""
    return _BY_A_DIGIT.sub(lambda m: LOOKALIKE[m.group()], s)


@dataclass
class Line:
    """A line under work: its text, where each character comes from (-1 - n: the placeholder of hit n), and the hits."""

    text: str
    origin: list[int] = field(default_factory=list)
    hits: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.untouched = self.text
        self.origin = list(range(len(self.text)))

    def replace(self, spans: Sequence[tuple[int, int]], kind: str, reason: str, phase: int, ord_: int, value: str | None = None, seen: str | None = None, place: bool = True) -> None:
        """Put placeholders for the spans. value: the identity, if it isn't the text replaced; seen: the text as the rule read it."""
        parts: list[str] = []
        origin: list[int] = []
        last = 0
        mark = placeholder(kind)
        for a, b in spans:
            known = [o for o in self.origin[a:b] if o >= 0] if place else []
            own = self.text[a:b] if value is None else value
            read = own if seen is None or value is not None else seen[a:b]
            parts += [self.text[last:a], mark]
            origin += self.origin[last:a] + [-1 - len(self.hits)] * len(mark)
            self.hits.append(
                {"phase": phase, "ord": ord_, "reason": reason, "kind": kind, "original": own, "value": read, "start": min(known) if known else None, "end": max(known) + 1 if known else None}
            )
            last = b
        if spans:
            self.text = "".join(parts) + self.text[last:]
            self.origin = origin + self.origin[last:]

    def pieces(self) -> list[dict]:
        out: list[dict] = []
        start = 0
        for i in range(1, len(self.text) + 1):
            a = self.origin[start]
            if i == len(self.text) or (self.origin[i] < 0) != (a < 0) or (a < 0 and self.origin[i] != a):
                out.append({"lit": self.text[start:i], "hit": None} if a >= 0 else {"lit": None, "hit": -1 - a})
                start = i
        return out


def spans_of(pattern: str, any_case: bool, ocr: bool, text: str) -> list[tuple[int, int]]:
    rx = compiled(pattern, any_case, ocr)
    group = "v" if "v" in rx.groupindex else 0
    return [m.span(group) for m in rx.finditer(text)]


def _steps(untouched: str, ocr: bool, entries: Sequence[tuple[int, Entry]], names: Sequence[NameParts], sweeps: Sequence[tuple[str, str, str]]) -> Iterator[tuple]:
    """What is replaced on a line, in order: (pattern, any_case, loosened, kind, reason, phase, ord, value, shadowed, rule). Rules
    that ask for more digits in a row than the line has anywhere are left out: a replacement makes no run longer."""
    for n, e in entries:
        yield e.pattern, e.any_case, ocr, CATEGORIES[e.category], f"[LIST:{e.category}]", LISTED, n, e.canonical, False, None
    present = [p for p in names if p.both_in(untouched, ocr)]
    for n, (p, side) in enumerate([(p, side) for side in (0, 1) for p in present]):
        yield p.patterns[side], True, ocr, "NAME", "[LIST:name]", SPLIT, n, p.canonical, False, None
    run = max(map(len, _DIGIT_RUNS.findall(untouched)), default=0)
    for n, r in enumerate(RULES):
        if (ocr or not r.ocr_only) and DIGITS.get(r.name, 1) <= run:
            yield r.pattern, r.any_case, ocr, r.kind, r.reason, PATTERN, n, None, False, r
    for n, r in enumerate(RULES) if ocr else ():
        if r.kind in SHADOW_KINDS:
            yield r.pattern, r.any_case, False, r.kind, f"[PATTERN:{r.kind}:OCR]", SHADOWED, n, None, True, replace(r, unless=None)
    for n, (kind, value, pattern) in enumerate(sweeps):
        yield pattern, True, ocr, kind, f"[SWEEP:{kind}]", SWEPT, n, value, False, None


def fold_line(
    text: str, ocr: bool = False, entries: Sequence[Entry | tuple[int, Entry]] = (), names: Sequence[NameParts] = (), sweeps: Sequence[tuple[str, str, str]] = (), presets: Sequence[tuple[int, int, str]] = (),
) -> Line:
    """Fold everything over one line. entries: all, or some with their numbers; sweeps: (kind, value, pattern); presets: (start,
    end, key of the signer)."""
    line = Line(text)
    for n, (a, b, key) in enumerate(sorted(presets, reverse=True)):
        line.replace([(a, b)], "SIGNATURE", "[SIGNATURE]", PRESET, len(presets) - 1 - n, value=key, place=False)
        line.hits[-1]["original"] = text[a:b].strip()
    numbered = [e if isinstance(e, tuple) else (n, e) for n, e in enumerate(entries)]
    gates: dict[str, bool] = {}

    def barred(r: Rule) -> bool:
        if r.gate and r.gate not in gates:
            gates[r.gate] = bool(compiled(r.gate, True, ocr).search(text))
        return bool(r.gate and not gates[r.gate] or r.unless and compiled(r.unless, True, ocr).search(line.text))

    for pattern, any_case, loose, kind, reason, phase, n, value, shadowed, rule in _steps(text, ocr, numbered, names, sweeps):
        if rule and any_case and rule.gate and barred(rule):  # its pattern takes longer than its gate
            continue
        read = shadow_text(line.text) if shadowed else line.text
        if shadowed and read == line.text:
            continue
        spans = spans_of(pattern, any_case, loose, read)
        if spans and not (rule and barred(rule)):
            line.replace(spans, kind, reason, phase, n, value=value, seen=read if shadowed else None)
    return line


@dataclass
class Values:
    """What a line may hold besides patterns: dictionary entries, split names and swept values, each filed by key. It goes to
    every task, so there are at most SHIPPED of each; more meet the lines in a join instead (listed, sweeps as columns)."""

    entries: list[Entry] = field(default_factory=list)
    names: list[NameParts] = field(default_factory=list)
    sweeps: list[tuple[str, str, str]] = field(default_factory=list)
    sweep_keys: list[list[list[str]]] = field(default_factory=list)

    def file(self) -> None:
        """Once in each Python worker."""
        if hasattr(self, "by_entry"):
            return
        self.by_entry = Filed([entry_keys(e, False) for e in self.entries], [entry_keys(e, True) for e in self.entries])
        self.by_name = Filed(*[[p.keys() for p in self.names]] * 2)
        self.by_sweep = Filed([k[0] for k in self.sweep_keys], [k[1] for k in self.sweep_keys])

    def on(self, line: str, ocr: bool) -> tuple[list[tuple[int, Entry]], list[NameParts], list[tuple[str, str, str]]]:
        return [(n, self.entries[n]) for n in self.by_entry.of(line, ocr)], [self.names[n] for n in self.by_name.of(line, ocr)], [self.sweeps[n] for n in self.by_sweep.of(line, ocr)]

    def words(self) -> set[str] | None:
        """The words and numbers of which a strict line that holds an entry or a name has one; None if every line must be asked."""
        keys = [k for k in (*(entry_keys(e, False) for e in self.entries), *(p.keys() for p in self.names))]
        return None if None in keys else {k for ks in keys for k in ks}


def may_hold(line: Column, ocr: Column, values: Values) -> Column:
    """Whether a line needs to be asked for entries or names."""
    if not values.entries and not values.names:
        return F.lit(False)
    words = values.words()
    if words is None or len(words) > NATIVE_KEYS:
        return F.lit(True)
    plain, numbers = [w for w in words if w[0] != "#"], [w[1:] for w in words if w[0] == "#"]
    told = F.lit(False)
    if plain:
        told = told | F.exists(words_column(line), lambda w: w.isin(*plain))
    if numbers:
        told = told | F.exists(F.regexp_extract_all(line, F.lit(r"(?U)\d+"), F.lit(0)), lambda d: d.isin(*numbers))
    return ocr | told


def with_listed(lines: DataFrame, entries: Sequence[Entry], names: Sequence[NameParts]) -> DataFrame:
    """Lines with the entries and names that they may hold, as columns listed and split: for dictionaries too large to go to
    every task."""
    spark = lines.sparkSession
    rows = [(k if k is not None else "", ocr, n, e.category, e.canonical, e.variant, e.pattern, e.any_case) for n, e in enumerate(entries) for ocr in (False, True) for k in entry_keys(e, ocr) or [None]]
    parts = [(k if k is not None else "", ocr, n, p.canonical, *p.patterns) for n, p in enumerate(names) for ocr in (False, True) for k in p.keys() or [None]]
    offers = spark.createDataFrame(rows, "key string, on_ocr boolean, ord int, category string, canonical string, variant string, pattern string, any_case boolean")
    splits = spark.createDataFrame(parts, "key string, on_ocr boolean, ord int, canonical string, first string, last string")
    out = meet(lines, offers, ["ord", "category", "canonical", "variant", "pattern", "any_case"], "listed")
    return meet(out, splits, ["ord", "canonical", "first", "last"], "split")


def fold(lines: DataFrame, entries: Sequence[Entry] = (), names: Sequence[NameParts] = (), values: Values | None = None) -> DataFrame:
    """Fold lines (doc_ord, line_no, line, is_ocr, and if there are any: sweeps, presets): gives FOLDED."""
    touched, rest = fold_parts(lines, entries, names, values)
    return touched.unionByName(rest)


def fold_parts(lines: DataFrame, entries: Sequence[Entry] = (), names: Sequence[NameParts] = (), values: Values | None = None) -> tuple[DataFrame, DataFrame]:
    """fold in two parts: the lines that something may touch, and the others, which don't go to Python at all. values: entries,
    names and swept values that go to every task."""
    asked, rest, values = parted(lines, entries, names, values)
    return fold_asked(asked, values), untouched(rest)


def parted(lines: DataFrame, entries: Sequence[Entry] = (), names: Sequence[NameParts] = (), values: Values | None = None) -> tuple[DataFrame, DataFrame, Values]:
    """Lines that something may touch, with what they may hold, the others, and what goes to every task. Swept values are of the
    patterns' kinds, so they stand on such lines only."""
    extra = [c for c in ("sweeps", "presets") if c in lines.columns]
    values = values or Values()
    shaped = lines.select(F.col("doc_ord").cast("bigint").alias("doc_ord"), F.col("line_no").cast("int").alias("line_no"), "line", F.coalesce("is_ocr", F.lit(False)).alias("is_ocr"), *extra)
    live = shaped.filter("line is not null")
    if len(entries) + len(names) <= SHIPPED:
        values = Values([*values.entries, *entries], [*values.names, *names], values.sweeps, values.sweep_keys)
    else:
        live, extra = with_listed(live, entries, names), [*extra, "listed", "split"]
    touched = touchable(F.col("line")) | may_hold(F.col("line"), F.col("is_ocr"), values)
    for c in extra:
        touched = touched | (F.coalesce(F.size(c), F.lit(0)) > 0)
    return live.filter(touched), live.filter(~touched).select("doc_ord", "line_no", "line", "is_ocr"), values


def fold_asked(asked: DataFrame, values: Values) -> DataFrame:
    """Fold the first of parted's lines."""
    shipped = asked.sparkSession.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        known.file()
        for b in batches:
            rows = b.to_pydict()
            done = []
            for i, (line, ocr) in enumerate(zip(rows["line"], rows["is_ocr"], strict=True)):
                own = lambda c: rows[c][i] or () if c in rows else ()  # noqa: B023, E731
                listed, parts, swept = known.on(line, ocr)
                listed = listed + [(e["ord"], Entry(*list(e.values())[1:])) for e in own("listed")]
                parts = parts + [NameParts(p["canonical"], (p["first"], p["last"])) for p in own("split")]
                done.append(fold_line(line, ocr, listed, parts, swept + [tuple(s.values()) for s in own("sweeps")], [tuple(p.values()) for p in own("presets")]))
            piece = pa.struct([("lit", pa.string()), ("hit", pa.int32())])
            hit = pa.struct([("phase", pa.int32()), ("ord", pa.int32()), *((c, pa.string()) for c in ("reason", "kind", "original", "value")), ("start", pa.int32()), ("end", pa.int32())])
            keep = [b.column(c) for c in ("doc_ord", "line_no", "line", "is_ocr")]
            cols = [*keep, pa.array([x.pieces() for x in done], pa.list_(piece)), pa.array([x.hits for x in done], pa.list_(hit))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_ord", "line_no", "line", "is_ocr", "pieces", "hits"])

    return asked.mapInArrow(run, FOLDED)


def untouched(rest: DataFrame) -> DataFrame:
    """Lines as if folded, without hits."""
    piece = F.struct(F.col("line").alias("lit"), F.lit(None).cast("int").alias("hit"))
    return rest.select("doc_ord", "line_no", "line", "is_ocr", F.array(piece).alias("pieces"), F.array().cast(f"array<{HIT}>").alias("hits"))


def native_text(line: Column, ocr: bool = False) -> Column:
    """The text that the pattern rules leave, with placeholders: the fold as a chain of regexp_replace, to check it by. A line
    without a digit and each of MARKS has no rule's match."""
    out = line
    for r in RULES:
        if r.ocr_only and not ocr:
            continue
        pattern, mark = for_java(r.pattern, r.any_case, ocr), placeholder(r.kind)
        if "(?<v>" in pattern:
            head, _, tail = pattern.partition("(?<v>")
            depth = end = 0
            for end, c in enumerate(tail):  # noqa: B007  the group's closing bracket
                if c == "(" and tail[end - 1 : end] != "\\":
                    depth += 1
                elif c == ")" and tail[end - 1 : end] != "\\":
                    depth -= 1
                    if depth < 0:
                        break
            prefix, rest = head[head.index(")") + 1 :], tail[end + 1 :]
            flags = head[: head.index(")") + 1]
            pattern, new = f"{flags}({prefix})({tail[:end]})({rest})", None
            new = F.lit("$1" + mark.replace("$", "\\$") + "$" + str(_groups(prefix) + _groups(tail[:end]) + 3))
        else:
            new = F.lit(mark)
        out = _step(out, line, r, F.lit(pattern), new, ocr)
    asked = line.rlike(r"\p{Nd}")
    for mark in MARKS:
        asked = asked | line.contains(mark)
    return F.when(asked, out).otherwise(line)


def _step(text: Column, line: Column, r: Rule, pattern: Column, new: Column, ocr: bool) -> Column:
    """One rule of the chain. The text is bound to a name: written out at each use, the chain would grow threefold with every rule."""

    def replaced(t: Column) -> Column:
        test = F.lit(True)
        if r.gate:
            test = test & line.rlike(for_java(r.gate, True, ocr))
        if r.unless:
            test = test & ~t.rlike(for_java(r.unless, True, ocr))
        return F.when(test, F.regexp_replace(t, pattern, new)).otherwise(t)

    return F.get(F.transform(F.array(text), replaced), F.lit(0))


def _groups(pattern: str) -> int:
    """Capturing groups in a pattern."""
    return sum(1 for i, c in enumerate(pattern) if c == "(" and pattern[i - 1 : i] != "\\" and pattern[i + 1 : i + 2] != "?")
