"""Secret scan with a randomness test battery, in DataFrame functions only.

Three base patterns (assignments, access keys, hex runs) give spans outright.
Besides, every long run of code characters is a candidate: its encoding, the
smallest alphabet that it is in (decimal, hex, letters of one case or of both,
base32, base36, base62, base64), is inferred, and under the hypothesis that its
characters are drawn uniformly from that alphabet three tests give p-values:
chi-squared uniformity, Wald-Wolfowitz runs about the middle of the alphabet,
and serial correlation. With m the smallest, 1 - (1 - m) ** 3 is the candidate's
p: uniform for random strings if the tests were independent and exact.

They aren't quite (runs and correlation go together, and counts of short strings
are few), so p is judged against what random strings have: each candidate has a
twin, a string of its own encoding and length drawn with a hash of the
candidate, which takes the same tests. Random strings are spread as the twins
are, ordinary ones gather near 0. For each encoding and class of length two
histograms, of all distinct candidates in the corpus and of their twins (a few
hundred counts), show how many candidates are random (those over a limit, by the
twins' share there), and so how many of those above a threshold aren't. The
least threshold with an expected share of false ones of at most FALSE_SHARE is
used, so short strings, whose tests have little power, meet a stricter one; where
the candidates over 1/2 aren't spread as their twins, or ordinary ones are so
many that the share LEAK of them would be too much, there is no threshold and
nothing of the group is reported. The control holds as far as no more than LEAK
of ordinary strings are spread as random ones are. The scan is stored between the two steps
and texts are read once.

All steps take time in proportion to a text's length, however many spans it has.

Defined results: a null text is empty; texts without spans have counts 0 and
empty lists; a null id is kept; repeated rows are rows of their own; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_only, stored
from .native import bind, running

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"decimal": DIGITS, "hex": DIGITS + "abcdef", "lower": LOWER, "upper": UPPER, "letters": UPPER + LOWER, "base32": UPPER + "234567", "base36": LOWER + DIGITS, "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/"}
LENGTHS = [24, 32, 48, 80]
BINS = 100
FALSE_SHARE = 0.05
PRIOR = 200
#: The share of ordinary strings that may be spread like random ones, so that their p says nothing.
LEAK = 0.05
LEAST_P = 0.01

SPAN = "struct<a:int,kind:int,b:int>"
SPANS = f"array<{SPAN}>"


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, a group) of a pattern's leftmost matches, in code points."""
    rest = F.split(text, pattern, -1)
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(rest.alias("rest"), every.alias("m"), *([F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g")] if group else []))
    # of the pieces between matches there is one more, the last
    steps = F.transform(parts, lambda x: F.struct(F.length(x["rest"]).alias("gap"), F.length(x["m"]).alias("size"), x["g" if group else "m"].alias("s")))
    steps = F.filter(steps, lambda x: x["s"].isNotNull())

    def add(at: Column, x: Column) -> tuple[Column, Column]:
        a = at + x["gap"]
        b = a + x["size"]
        return b, F.struct(a.alias("a"), b.alias("b"), x["s"].alias("s"))

    kind = "struct<a:int,b:int,s:string>"
    return F.when(F.rlike(text, F.lit(pattern)), running(steps, F.lit(0), kind, add)).otherwise(F.array().cast(f"array<{kind}>"))


def _spans(found: Column, kind: int, fits: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(found, fits), lambda x: F.struct(x["a"].alias("a"), F.lit(kind).alias("kind"), x["b"].alias("b")))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    up = F.exp(-x * x / 2) / sqrt(2 * 3.141592653589793) * poly
    return F.when(z >= 0, up).otherwise(1 - up)


def _encoding(s: Column) -> Column:
    """The smallest alphabet that a string can be in. A string without digits, or of nothing else, is one of a smaller alphabet:
    given that it has none, a random string of the larger one is uniform in the smaller."""
    cases = F.when(s.rlike("^[0-9]+$"), "decimal").when(s.rlike("^[0-9a-f]+$") | s.rlike("^[0-9A-F]+$"), "hex")
    cases = cases.when(s.rlike("^[a-z]+$"), "lower").when(s.rlike("^[A-Z]+$"), "upper").when(s.rlike("^[A-Z2-7]+$"), "base32")
    cases = cases.when(s.rlike("^[a-z0-9]+$") | s.rlike("^[A-Z0-9]+$"), "base36").when(s.rlike("^[A-Za-z]+$"), "letters").when(s.rlike("^[A-Za-z0-9]+$"), "base62")
    return cases.otherwise("base64")


def _tested(s: Column, enc: str) -> Column:
    """p of the three tests together, for a string of one encoding."""
    alphabet = ALPHABETS[enc]
    k, n = len(alphabet), F.length(s).cast("double")
    letters = F.array(*map(F.lit, alphabet))
    squares = F.aggregate(letters, F.lit(0.0), lambda acc, c: acc + F.pow(F.length(s) - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)))
    z_chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
    values = F.transform(F.split(s, ""), lambda c: F.position(c, F.lit(alphabet)).cast("double"))
    zero = F.struct(*(F.lit(0.0).alias(x) for x in ("sum", "sq", "lag", "last", "high", "runs", "seen")))

    def add(acc: Column, v: Column) -> Column:
        side, before = (v > (k + 1) / 2).cast("double"), (acc["last"] > (k + 1) / 2).cast("double")
        first = acc["seen"] == 0
        return F.struct(
            (acc["sum"] + v).alias("sum"), (acc["sq"] + v * v).alias("sq"), (acc["lag"] + v * acc["last"]).alias("lag"), v.alias("last"),
            (acc["high"] + side).alias("high"), (acc["runs"] + F.when(first | (side != before), 1.0).otherwise(0.0)).alias("runs"), F.lit(1.0).alias("seen"),
        )

    def tests(acc: Column) -> Column:
        return F.struct(acc["sum"].alias("sum"), acc["sq"].alias("sq"), acc["lag"].alias("lag"), acc["high"].alias("high"), acc["runs"].alias("runs"), acc["last"].alias("last"))

    m = F.aggregate(values, zero, add, tests)

    def p_of(m: Column) -> Column:
        low = n - m["high"]
        mean_runs = 2 * m["high"] * low / n + 1
        z_runs = (m["runs"] - mean_runs) / F.sqrt(F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9)))
        mean, first = m["sum"] / n, F.position(F.substring(s, 1, 1), F.lit(alphabet)).cast("double")
        cov = m["lag"] - mean * (2 * m["sum"] - first - m["last"]) + (n - 1) * mean * mean
        z_serial = (cov / F.greatest(m["sq"] - n * mean * mean, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
        least = F.least(F.lit(1.0), _tail(z_chi), 2 * _tail(F.abs(z_runs)), 2 * _tail(F.abs(z_serial)))
        return 1 - F.pow(1 - least, F.lit(3.0))

    return bind(m, p_of)


def _length_class(n: Column) -> Column:
    return sum(((n >= x).cast("int") for x in LENGTHS), F.lit(0))


def _twin(seed: Column, n: Column, enc: str) -> Column:
    """A string of n characters drawn from an alphabet with a hash."""
    alphabet = F.lit(ALPHABETS[enc])
    draw = lambda j: F.substring(alphabet, (F.pmod(F.xxhash64(seed, j), F.lit(len(ALPHABETS[enc]))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), draw), "")


def _candidate(text: Column) -> Column:
    """What the battery finds about each candidate: start, end, encoding's number and class of length (grp), p, its twin's p, and
    a hash of the string."""
    encs = list(ALPHABETS)

    def look(x: Column) -> Column:
        s = F.translate(F.rtrim(x["s"], F.lit("=")), "-_", "+/")
        return F.struct(x["a"].alias("a"), x["b"].alias("b"), s.alias("s"), _encoding(s).alias("enc"), F.xxhash64(s).alias("h"))

    def both_tested(s: Column, seed: Column, enc: str) -> Column:
        return F.transform(F.array(s, _twin(seed, F.length(s), enc)), lambda y: _tested(y, enc))

    def test(x: Column) -> Column:
        s = F.when(x["enc"].isin("hex", "base36") & x["s"].rlike("[A-Z]"), F.lower(x["s"])).otherwise(x["s"])
        p = F.lit(None).cast("array<double>")
        for enc in encs:
            p = F.when(x["enc"] == enc, both_tested(s, x["h"], enc)).otherwise(p)
        group = F.array_position(F.array(*map(F.lit, encs)), x["enc"]).cast("int") * 10 + _length_class(F.length(s))
        return bind(p, lambda q: F.struct(x["a"].alias("a"), x["b"].alias("b"), group.alias("grp"), F.element_at(q, 1).alias("p"), F.element_at(q, 2).alias("twin"), x["h"].alias("h")))

    return F.transform(F.transform(_found(text, CANDIDATE), look), test)


def _threshold(seen: list[int], twins: list[int], share: float) -> float | None:
    """The least p above which at most that share of the candidates is expected not to be random; None if there is none."""
    above = [sum(seen[b:]) for b in range(BINS)]
    # few twins say little, so PRIOR uniform ones are added
    null = [(sum(twins[b:]) + PRIOR * (1 - b / BINS)) / (sum(twins) + PRIOR) for b in range(BINS)]
    half, quarter = BINS // 2, BINS * 3 // 4
    # among random strings those over 3/4 are a known part of those over 1/2; ordinary ones thin out on the way there
    part = null[quarter] / null[half]
    if not above[half] or above[quarter] < above[half] * part * (1 - share) - 2 * sqrt(above[half] * part * (1 - part) + 1):
        return None
    # how many are random, by those over a limit: the limit with the least expected error (Storey, 2002), as a high one leaves
    # few to go by and a low one takes in ordinary ones
    guesses = [(b, above[b] / null[b]) for b in range(5, half + 1, 5)]
    fewest = min(n for _, n in guesses)
    limit, random = min(guesses, key=lambda g: g[1] * (1 - null[g[0]]) / null[g[0]] + (g[1] - fewest) ** 2)
    stray = LEAK * max(0.0, above[0] - random)
    return next((b / BINS for b in range(max(1, int(LEAST_P * BINS)), limit + 1) if above[b] - random * null[b] + stray * null[b] <= share * above[b]), None)


def thresholds(found: DataFrame, share: float = FALSE_SHARE) -> dict[int, float]:
    """The threshold of each group of candidates that has one. found: grp, p, twin, h; equal strings count once."""
    place = lambda c: F.least(F.floor(F.col(c) * BINS), F.lit(BINS - 1)).cast("int")
    once = found.groupBy("grp", "h").agg(F.min(F.struct("p", "twin")).alias("x")).select("grp", "x.*")
    both = once.select("grp", F.explode(F.array(F.struct(F.lit(0).alias("own"), place("p").alias("bin")), F.struct(F.lit(1).alias("own"), place("twin").alias("bin")))).alias("y"))
    counts: dict[int, list[list[int]]] = {}
    for grp, own, b, n in both.groupBy("grp", "y.own", "y.bin").count().collect():  # at most 2 * BINS counts for each of 45 groups
        counts.setdefault(grp, [[0] * BINS, [0] * BINS])[own][b] = n
    out = {grp: _threshold(*hists, share) for grp, hists in counts.items()}
    return {grp: p for grp, p in out.items() if p is not None}


def _outside(candidates: Column, base: Column) -> Column:
    """The candidates (a, b) that lie within no base span, as spans."""
    mixed = F.concat(
        F.transform(base, lambda s: F.struct(s["a"].alias("a"), F.lit(0).alias("own"), s["b"].alias("b"))), F.transform(candidates, lambda c: F.struct(c["a"].alias("a"), F.lit(1).alias("own"), c["b"].alias("b")))
    )

    def pass_over(reach: Column, x: Column) -> tuple[Column, Column]:
        after = F.when(x["own"] == 0, F.greatest(reach, x["b"])).otherwise(reach)
        return after, F.struct(x["a"].alias("a"), F.lit(len(KINDS) - 1).alias("kind"), F.when((x["own"] == 1) & (reach < x["b"]), x["b"]).alias("b"))

    kept = F.filter(running(F.array_sort(mixed), F.lit(-1), SPAN, pass_over), lambda x: x["b"].isNotNull())
    return F.when(F.size(candidates) > 0, kept).otherwise(F.array().cast(SPANS))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FALSE_SHARE) -> DataFrame:
    """One row for each row of docs: doc_id, base and random, each a list of spans (a: start, kind: place in KINDS, b: end),
    in code points. A random span that lies within a base span is left out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = columns_only(docs, **{id_col: "bigint", text_col: "string"}).select(F.col(id_col).alias("doc_id"), text.alias("text"))
    assign = _spans(_found(F.col("text"), ASSIGN, 2), 0, lambda x: F.length(x["s"]) >= ASSIGN_VALUE)
    access = _spans(_found(F.col("text"), ACCESS), 1, lambda x: x["b"] - x["a"] >= ACCESS_LENGTH)
    # runs are maximal, so asking for their length in the pattern drops the same ones
    hexes = _spans(_found(F.col("text"), HEX[:-1] + f"{{{HEX_LENGTH},}}"), 2, lambda x: x["b"] > x["a"])
    seen = src.select("doc_id", F.array_sort(F.concat(assign, access, hexes)).alias("base"), _candidate(F.col("text")).alias("candidates"))
    seen, _ = stored(seen, "spans")
    least = thresholds(seen.select(F.explode("candidates").alias("c")).select("c.grp", "c.p", "c.twin", "c.h"), share)
    if not least:
        return seen.select("doc_id", "base", F.array().cast(SPANS).alias("random"))
    table = F.create_map(*(F.lit(x) for kv in sorted(least.items()) for x in kv))
    taken = seen.withColumn("taken", F.filter("candidates", lambda c: c["p"] >= F.try_element_at(table, c["grp"])))
    return taken.select("doc_id", "base", _outside(F.col("taken"), F.col("base")).alias("random"))


def digest(scan: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their hash, and all spans as text."""
    name = F.array(*map(F.lit, KINDS))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["a"].cast("string"), x["b"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return scan.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )
