"""Statement lines made from keys, so that what must be found in them is known without a regex.

Each family gives, as SQL that Spark and other engines read alike: a line, the
line that must be left (with digit-free placeholders), and the values found.
k stands for the key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digits(n: int, salt: int) -> str:
    """n digits that follow from k."""
    return f"lpad(cast((k * {7919 + 2 * salt} + {salt}) % {10**n} as string), {n}, '0')"


@dataclass(frozen=True)
class Family:
    line: str
    left: str
    found: str
    ocr: bool = False


def around(before: str, value: str, after: str, kind: str, ocr: bool = False) -> Family:
    quoted = [f"'{x}'" if x else None for x in (before, after)]
    return Family(" || ".join(x for x in (quoted[0], value, quoted[1]) if x), f"'{before}[{kind}-Z]{after}'", value, ocr)


_SSN = " || '-' || ".join((digits(3, 1), digits(2, 2), digits(4, 3)))
_ZIP = f"'9' || {digits(4, 9)}"
FAMILIES = {
    "ssn": around("EMPLOYEE SSN: ", _SSN, " WAGES 1,234.00", "SSN"),
    "ssn_spaced": around("SSN ", _SSN.replace("'-'", "' '"), "", "SSN"),
    "ssn_masked": around("RECIPIENT TIN ", f"'XXX-XX-' || {digits(4, 4)}", " WAGES 1,000.00", "SSN"),
    "ssn_bare": around("SOCIAL SECURITY NUMBER ", digits(9, 5), "", "SSN"),
    "ein": around("EMPLOYER EIN: ", f"{digits(2, 6)} || '-' || {digits(7, 7)}", "", "EIN"),
    "email": around("write to ", "'user' || cast(k as string) || '@example.com'", " today", "EMAIL"),
    "phone": around("call ", f"'(' || {digits(3, 8)} || ') ' || {digits(3, 9)} || '-' || {digits(4, 10)}", " now", "PHONE"),
    "dob": around("DATE OF BIRTH: ", f"cast(k % 12 + 1 as string) || '/' || cast(k % 28 + 1 as string) || '/19' || {digits(2, 11)}", "", "DOB"),
    "dob_word": around("DOB: ", f"'March ' || cast(k % 28 + 1 as string) || ', 19' || {digits(2, 12)}", " (copy)", "DOB"),
    "routing": around("ROUTING NUMBER (ABA): ", digits(9, 13), "", "ROUTING"),
    "po_box": around("MAILING ADDRESS: ", "'P.O. BOX ' || cast(k + 10 as string)", "", "ADDR"),
    "address": around("HOME ADDRESS: ", f"cast(k % 9000 + 100 as string) || ' EXAMPLE STREET, SAMPLETOWN, CA ' || {_ZIP}", "", "ADDR"),
    "unit": around("", "'SUITE ' || cast(k + 100 as string)", " of the tower", "ADDR"),
    "city_us": around("to: ", f"'SAMPLETOWN CA US ' || {_ZIP}", " by post", "ADDR"),
    "city_zip4": around("to: ", f"'SAMPLETOWN CA ' || {_ZIP} || '-' || {digits(4, 14)}", " by post", "ADDR"),
    "city_inline": around("to: ", f"'SAMPLETOWN, CA ' || {_ZIP}", " by post", "ADDR"),
    "city_line": around("  ", f"'SAMPLETOWN CA ' || {_ZIP}", " ", "ADDR"),
    "city_edge": around("", f"'SAMPLETOWN CA ' || {_ZIP}", "  enclosed", "ADDR", True),
    "acct_labeled": around("Account No. ", f"'Z12-' || {digits(6, 15)}", "", "ACCT"),
    "id": around("DRIVER LICENSE NO: ", f"'A' || {digits(7, 16)}", "", "ID"),
    "acct": around("REF ", digits(11, 17), " AMOUNT", "ACCT"),
    "envelope": around("Docusign Envelope ID: ", f"'0A' || {digits(6, 18)} || '-1B2C-' || {digits(4, 19)} || '-3D4E-' || {digits(12, 20)}", "", "ENVELOPE"),
    "signer": around("", f"'A1B2C3D4' || {digits(8, 21)} || '...'", " signed", "SIGNATURE"),
    "survivor": Family(f"'BOX 1b DATE ACQUIRED: 03/15/19' || {digits(2, 22)} || ' AMOUNT 1,000.' || {digits(2, 23)} || ' RATE 0.0000' || {digits(6, 24)} || ' %'", f"'BOX 1b DATE ACQUIRED: 03/15/19' || {digits(2, 22)} || ' AMOUNT 1,000.' || {digits(2, 23)} || ' RATE 0.0000' || {digits(6, 24)} || ' %'", "''"),
    "ocr_loosened": around("DATEOFBIRTH:", f"'3/' || cast(k % 28 + 1 as string) || '/19' || {digits(2, 25)}", "", "DOB", True),
    "ocr_shadow": around("EMPLOYEE SSN: ", f"'l' || {digits(2, 26)} || '-' || {digits(2, 27)} || '-' || {digits(3, 28)} || 'O'", "", "SSN", True),
}


def lines(keys: DataFrame, key: str, family: str) -> DataFrame:
    """A line of the family for each key: doc_ord, line_no, line, is_ocr."""
    f = FAMILIES[family]
    return keys.select(F.col(key).alias("k")).select(F.col("k").alias("doc_ord"), F.lit(0).alias("line_no"), F.expr(f.line).alias("line"), F.lit(f.ocr).alias("is_ocr"))


def oracle(family: str) -> str:
    f = FAMILIES[family]
    n = "0" if f.found == "''" else "1"
    return f"select k, {f.left} as text, {f.found} as found, cast({n} as bigint) as n_hits from (select c_custkey as k from customer)"
