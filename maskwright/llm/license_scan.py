"""License scan: ordered signature rules, in DataFrame functions only.

A text is reduced to its lower-case words with one space between them, so a
rule is a regex over words. Rules are ordered: each has a priority, a label,
and a keyword, a word without which it can't match. A document is tested only
for the rules whose keyword is among its words. A short form (`GPLv3`) can begin
with several words (gpl, gplv, gpl3, gplv3), so it is a rule for each of them.
Detections are intervals of words; one that lies within the interval of a
detection of higher priority (or of the same priority and longer, or earlier) is
suppressed. The base phrases are found apart from that and are never suppressed.
All steps take time in proportion to a text's length, however many places it has.

Rules are written by hand (license_rules.py) but for names: each family's name,
with its versions, its SPDX ids and short forms, is expanded from a row of a table.

Defined results: a null text is empty; texts without words have no places,
null first and last words, empty labels and score 0; a null id is kept;
repeated rows are rows of their own; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, columns_only
from .license_rules import GENERAL, NOTICES, TEXTS, parsed
from .native import bind, running

#: Phrase and label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    priority: int  # smaller is stronger
    label: str
    keyword: str
    pattern: str
    confidence: float


#: Families: label, name as words, names of single words that stand for it, versions.
FAMILIES = [
    ("gpl", "gnu general public licen[cs]e", "gpl", "1 0|2 0|3 0|1|2|3"),
    ("lgpl", "gnu (?:lesser|library) general public licen[cs]e", "lgpl", "2 0|2 1|3 0|2|3"),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", "agpl", "1 0|3 0|1|3"),
    ("gfdl", "gnu free documentation licen[cs]e", "gfdl", "1 1|1 2|1 3"),
    ("apache", "apache(?: software)? licen[cs]e", "asl", "1 0|1 1|2 0|2"),
    ("mpl", "mozilla public licen[cs]e", "mpl", "1 0|1 1|2 0"),
    ("epl", "eclipse public licen[cs]e", "epl", "1 0|2 0"),
    ("cddl", "common development and distribution licen[cs]e", "cddl", "1 0|1 1"),
    ("cpl", "common public licen[cs]e", "cpl", "1 0"),
    ("eupl", "european union public licen[cs]e", "eupl", "1 0|1 1|1 2"),
    ("osl", "open software licen[cs]e", "osl", "1 0|2 0|2 1|3 0"),
    ("afl", "academic free licen[cs]e", "afl", "1 1|1 2|2 0|2 1|3 0"),
    ("artistic", "artistic licen[cs]e", "artistic", "1 0|2 0"),
    ("bsl", "boost software licen[cs]e", "bsl", "1 0"),
    ("ofl", "sil open font licen[cs]e", "ofl", "1 0|1 1"),
    ("odbl", "open (?:data commons open )?database licen[cs]e", "odbl", "1 0"),
    ("ms-pl", "microsoft public licen[cs]e", "mspl", "1 0"),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "msrl", "1 0"),
    ("zpl", "zope public licen[cs]e", "zpl", "1 1|2 0|2 1"),
    ("lppl", "latex project public licen[cs]e", "lppl", "1 0|1 2|1 3"),
    ("python", "python software foundation licen[cs]e", "psf", "2"),
    ("isc", "isc licen[cs]e", "isc", "1"),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib", "1"),
    ("mit", "mit licen[cs]e", "mit", "0|1"),
    ("bsd", "(?:(?:2|3|4|two|three|four) clause |new |modified |simplified )?bsd licen[cs]e", "bsd", "2|3|4"),
    ("upl", "universal permissive licen[cs]e", "upl", "1 0"),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "wtfpl", "1|2"),
    ("unlicense", "the unlicense", "unlicense", "1"),
    ("cecill", "cecill(?: free software)? licen[cs]e", "cecill", "1 0|2 0|2 1"),
    ("qpl", "q public licen[cs]e", "qpl", "1 0"),
]
#: What SPDX ids begin with, where it isn't the short name.
SPDX = {
    "apache": "apache", "ms-pl": "ms pl", "ms-rl": "ms rl", "python": "(?:python|psf)",
    "bsd": "(?:0bsd|bsd(?: [1-4] clause)?)", "lppl": "lppl(?: 1 3[ac])?",
}
#: Creative Commons: code, and its words.
CREATIVE = [
    ("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s?"),
    ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
]


def _short_forms(short: str, versions: str) -> list[tuple[str, str]]:
    """First word and pattern of `{short} ?v? ?(?:{versions})(?: or later| only)?`, for each word it can begin with."""
    tail = "(?: or later| only)?"
    out = [(short, f"{short} (?:v ?)?(?:{versions}){tail}"), (f"{short}v", f"{short}v (?:{versions}){tail}")]
    for glued in (short, f"{short}v"):
        majors: dict[str, list[str]] = {}
        for v in versions.split("|"):
            majors.setdefault(v.split(" ")[0], []).append(v[len(v.split(" ")[0]) :])
        out += [(f"{glued}{m}", f"{glued}{m}(?:{'|'.join(rest)}){tail}") for m, rest in majors.items()]
    return out


def rules() -> list[Rule]:
    """All rules in order: those written by hand, and the names, versions and short forms of families."""
    out = []
    for label, name, short, versions in FAMILIES:
        word = {"odbl": "database", "unlicense": "unlicense", "bsd": "bsd", "cecill": "cecill"}.get(label) or name.replace("(?:gnu )?", "").split(" ")[0]
        word = {"apache(?:": "apache", "zlib(?:": "zlib", "open": "software", "do": "fuck", "q": "public"}.get(word, word)
        ver = f"(?: (?:v|version|ver))? ?(?:{versions})"
        later = " (?:or (?:at your option )?(?:any )?later(?: version)?)"
        # a version can be joined to the name's last word, which is the keyword of this one
        for w in (word, "unlicense1") if label == "unlicense" else (word,):
            out.append(Rule(20, label, w, f"{name}{ver}{later}", 0.97))
            out.append(Rule(25, label, w, f"{name}{ver}", 0.95))
        out.append(Rule(30, label, word, name, 0.9))
        out.append(Rule(15, label, "spdx", f"spdx license identifier {SPDX.get(label, short)}(?: (?:{versions}))?(?: (?:only|or later))?", 1.0))
        out += [Rule(40, label, word, pattern, 0.8) for word, pattern in _short_forms(short, versions)]
    for code, words in CREATIVE:
        parts = code.replace("-", " ")
        for ver in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out.append(Rule(20, f"cc-{code}", "cc", f"cc {parts} {ver}(?: (?:international|unported|generic))?", 0.97))
        out.append(Rule(22 - len(code) // 3, f"cc-{code}", "creativecommons", f"creativecommons org licenses {parts}(?: [0-9] [0-9])?", 0.99))
        out.append(Rule(25 - len(code) // 3, f"cc-{code}", "commons", f"creative commons {words}(?: (?:[1-4] [05]))?(?: (?:international|unported|generic))?(?: licen[cs]e)?", 0.97))
        out.append(Rule(35 - len(code) // 3, f"cc-{code}", "cc", f"cc {parts}", 0.9))
    for priority, confidence, block in ((10, 0.99, TEXTS), (12, 0.98, NOTICES), (50, 0.7, GENERAL)):
        out += [Rule(priority, label, word, pattern, confidence) for label, word, pattern in parsed(block)]
    return sorted(out, key=lambda r: (r.priority, r.label, r.pattern))


RULES = rules()


def words_of(text: Column) -> Column:
    """Lower-case words with a space before each and one after the last; a space alone if there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " ")), F.lit(" "))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _places(words: Column, pattern: Column) -> Column:
    """Intervals (first word, word after the last) of a pattern's matches, which begin after a space and end before one."""
    # the first and last word of each match are marked with characters that no word has
    marked = F.split(F.regexp_replace(words, pattern, F.lit("\u0001$0\u0002")), " ")
    # words of the text are numbered from 1 there, as it begins with a space
    numbered = F.transform(marked, lambda x, i: F.struct(i.alias("i"), F.startswith(x, F.lit("\u0001")).alias("first"), F.endswith(x, F.lit("\u0002")).alias("last")))
    ends = F.filter(numbered, lambda x: x["first"] | x["last"])
    found = bind(ends, lambda e: F.arrays_zip(F.filter(e, lambda x: x["first"])["i"].alias("a"), F.filter(e, lambda x: x["last"])["i"].alias("b")))
    places = F.transform(found, lambda x: F.struct((x["a"] - 1).alias("a"), x["b"].alias("b")))
    return F.when(F.rlike(words, pattern), places).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def _whole(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _base_places(phrase: str, label: str) -> Column:
    word = "cc" if label == "cc-by" else "license"
    at = F.transform(_places(F.col("w"), F.lit(_whole(phrase))), lambda x: F.struct(F.lit(label).alias("label"), x["a"].alias("a"), x["b"].alias("b")))
    return F.when(F.array_contains("keys", word), at).otherwise(F.array().cast("array<struct<label:string,a:int,b:int>>"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule_list: list[Rule] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, base (intervals of the base phrases with labels), found (detections that
    were not suppressed: label, first word a, end b, confidence)."""
    ordered = RULES if rule_list is None else rule_list
    src = columns_only(docs, **{id_col: "bigint", text_col: "string"})
    df = src.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w"))
    keywords = sorted({r.keyword for r in ordered} | {"license", "cc"})
    # short forms are many: those that differ only after their letters are asked for at once
    glued = sorted({m[1] for k in keywords if (m := re.fullmatch("([a-z]+?)v?[0-9]", k)) and m[1] in keywords})
    plain = [k for k in keywords if not re.fullmatch(f"(?:{'|'.join(glued) or '-'})(?:v?[0-9]|v)?", k)]
    gate = _whole("|".join([*plain, *([f"(?:{'|'.join(glued)})(?:v?[0-9]|v)?"] if glued else [])]))
    df = df.withColumn("keys", F.array_distinct(F.regexp_extract_all("w", F.lit(gate), F.lit(0))))
    n_words = F.when(F.col("w") == "  ", 0).otherwise(_spaces(F.col("w")) - 1)
    base = F.concat(*(_base_places(phrase, label) for phrase, label in BASE.items()))
    table = F.array(*(
        F.struct(F.lit(i).alias("nth"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(_whole(r.pattern)).alias("pattern"), F.lit(r.confidence).alias("confidence"))
        for i, r in enumerate(ordered)
    ))
    asked = F.filter(table, lambda r: F.array_contains("keys", r["keyword"]))
    hits = F.flatten(F.transform(asked, lambda r: F.transform(_places(F.col("w"), r["pattern"]), lambda x: F.struct(r["priority"].alias("priority"), (x["a"] - x["b"]).alias("short"), r["nth"].alias("nth"), x["a"].alias("a"), x["b"].alias("b"), r["label"].alias("label"), r["confidence"].alias("confidence")))))
    none = F.array().cast("array<struct<priority:int,short:int,nth:int,a:int,b:int,label:string,confidence:double>>")
    df = df.withColumn("hits", F.when(F.size("keys") > 0, hits).otherwise(none))
    # One that lies within a stronger one goes. Hits are in the order of their first words, longer ones first, so those that a
    # hit can lie within come before it; the last word that those of each priority, or of a stronger one, reach is enough.
    levels = sorted({r.priority for r in ordered})
    level = lambda x: F.array_position(F.array(*map(F.lit, levels)), x["priority"]).cast("int")

    def judge(reach: Column, x: Column) -> tuple[Column, Column]:
        after = F.transform(reach, lambda r, i: F.when(i + 1 >= x["level"], F.greatest(r, x["b"])).otherwise(r))
        stays = F.element_at(reach, x["level"]) < x["b"]
        return after, F.struct(*(x[c].alias(c) for c in ("priority", "short", "nth", "a", "b", "label", "confidence")), stays.alias("stays"))

    along = F.array_sort(F.transform("hits", lambda x: F.struct(x["a"].alias("a"), (-x["b"]).alias("back"), level(x).alias("level"), x["nth"].alias("nth"), *(x[c].alias(c) for c in ("b", "priority", "short", "label", "confidence")))))
    judged = running(along, F.array(*(F.lit(-1) for _ in levels)), "struct<priority:int,short:int,nth:int,a:int,b:int,label:string,confidence:double,stays:boolean>", judge)
    keep = F.array_sort(F.filter(judged, lambda x: x["stays"]))
    found = F.transform(keep, lambda x: F.struct(x["label"].alias("label"), x["a"].alias("a"), x["b"].alias("b"), x["confidence"].alias("confidence")))
    return df.select("doc_id", n_words.cast("bigint").alias("n_words"), base.alias("base"), found.alias("found"))


def digest(scan: DataFrame) -> DataFrame:
    """Counts, ends and labels of a scan's rows."""
    base_labels = F.array_distinct(F.transform("base", lambda x: x["label"]))
    every = F.array_union(base_labels, F.transform("found", lambda x: x["label"]))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    top = F.array_max(F.transform("found", lambda x: x["confidence"]))
    return scan.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["a"])).cast("bigint").alias("first_word"), F.array_max(F.transform("base", lambda x: x["a"])).cast("bigint").alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.array_distinct(every)).alias("labels"),
        F.greatest(F.coalesce(top, F.lit(0.0)), F.when(F.size("base") > 0, 0.9).otherwise(0.0)).alias("score"), F.size("found").cast("bigint").alias("n_found"),
    )
