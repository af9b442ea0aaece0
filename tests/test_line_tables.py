"""Tables of lines and what must be left of them, with the rules for a text layer and those for OCR.

Fixed values: the lines and what is left of them must come out like this for people who use the tool today.
"""

from __future__ import annotations

import re

import pytest

from maskwright.functions.patterns import ADDR, DIGIT_KINDS, compiled
from maskwright.operators import audit, dictionary, mining, tokens
from maskwright.operators.fold import fold, fold_line, native_text

LINES = "doc_ord bigint, line_no int, line string, is_ocr boolean"

#: Both modes; a line alone means that it stays.
BOTH = {
    "ACCT 00012345678": "ACCT [ACCT-...5678]",
    "REF 987650001 AMOUNT": "REF [ACCT-...0001] AMOUNT",
    "Account No.12345678": "Account No.[ACCT-...5678]",
    "No. 12345678.": "No. [ACCT-...5678].",
    "1234567890.50": "[ACCT-...7890].50",
    "Account No. Z12-345678": "Account No. [ACCT-...5678]",
    "Account No. Z12-345678 Recipient ID No. XXX-XX-4321": "Account No. [ACCT-...5678] Recipient ID No. [SSN-1]",
    "ACCOUNT NUMBER: 1234-5678-90": "ACCOUNT NUMBER: [ACCT-...7890]",
    "Acct # AB1234": "Acct # [ACCT-...1234]",
    "AccountNo.Z12-345678": "AccountNo.[ACCT-...5678]",
    "4 SAMPLETECH CENTER": "[ADDR-1]",
    "4 Sampletech Center": "[ADDR-1]",
    "4 SAMPLETECH CENTER, SAMPLETOWN, CA 90000": "[ADDR-1]",
    "100 EXAMPLE PLAZA STE 200": "[ADDR-1]",
    "500 OLD COUNTRY HWY": "[ADDR-1]",
    "12 TIMES SQ": "[ADDR-1]",
    "SUITE 2200": "[ADDR-1]",
    "Suite 2200": "[ADDR-1]",
    "100 EXAMPLE STREET SUITE 2200": "[ADDR-1]",
    "100 EXAMPLE STREET NW SUITE 2200": "[ADDR-1] NW [ADDR-2]",
    "100 EXAMPLE ST. SUITE 2200": "[ADDR-1]. [ADDR-2]",
    "4 SAMPLETECH CENTER, 22ND FLOOR, SUITE 2200": "[ADDR-1], [ADDR-2], [ADDR-3]",
    "ACME WIDGETS SUITE 2200 SAMPLETOWN, CA 90000": "ACME WIDGETS [ADDR-1] [ADDR-2]",
    "APT 4B": "[ADDR-1]",
    "Unit #12": "[ADDR-1]",
    "STE. 300": "[ADDR-1]",
    "Rm 204": "[ADDR-1]",
    "APT 12-C": "[ADDR-1]",
    "FLOOR 5": "[ADDR-1]",
    "SAMPLETOWN, CA 90000-1234 Recipient ID No. XXX-XX-4321 Payer's Fed ID Number 12-3456789": "[ADDR-1] Recipient ID No. [SSN-1] Payer's Fed ID Number [EIN-1]",
    "PO BOX 4321 SAMPLETOWN, CA 90000-1234 Account No. X12-345678": "[ADDR-1] [ADDR-2] Account No. [ACCT-...5678]",
    "1234 EXAMPLE STREET SAMPLETOWN, CA 90000 Recipient ID No. 987-65-4321": "[ADDR-1] [ADDR-2] Recipient ID No. [SSN-1]",
    "ACCT 12345678 SAMPLETOWN, CA 90000": "ACCT [ACCT-...5678] [ADDR-1]",
    "FORM 1099 SAMPLETOWN CA 90000-1234 for 2025": "FORM 1099 [ADDR-1] for 2025",
    "SAMPLETOWN CA US 90000 OTHERVILLE NY US 10000": "[ADDR-1] [ADDR-2]",
    "SAMPLE LAKE TOWN CA US 90000-1234 OTHERVILLE NY USA 10000": "[ADDR-1] [ADDR-2]",
    "1234 EXAMPLE STREET SAMPLETOWN CA US 90000 500 INDUSTRY WAY OTHERVILLE NY US 10000": "[ADDR-1] [ADDR-3] [ADDR-2] [ADDR-4]",
    "123 5TH AVE": "[ADDR-1]",
    "100 200 MAIN ST": "100 [ADDR-1]",
    "SAMPLE LAKE TOWN,CA 90000-1234": "[ADDR-1]",
    "SAMPLE LAKE TOWN,CA 90000": "[ADDR-1]",
    "SAMPLETOWN,CA 90000-1234 Recipient ID No. 987-65-4321": "[ADDR-1] Recipient ID No. [SSN-1]",
    "SAMPLETOWN,CA 90000 Recipient ID No. 987-65-4321": "[ADDR-1] Recipient ID No. [SSN-1]",
    "P.O. BOX 12345,SAMPLETOWN,CA 90000-1234": "[ADDR-1]",
    "STATE ID: CA 123-4567-8": "STATE ID: CA [ID-1]",
    "12bAA  9477.36  1234 EXAMPLE STREET": "12bAA  9477.36  [ADDR-1]",
}
STAY = [
    "0.00000123456 %", "0.00000123456%", ".00000123456 %", "12.00000123456", "rate 10000000 %",
    "Account Number 2025", "Account No. of shares 100", "Account No. 1,234.56", "Account No. 12/31/2025 statement", "Account Summary 2025-12-31",
    "Call 800 our service center today", "Box 3 Total for the square footage", "Line 5 see the trail of payments",
    "sold 1 unit 5 times", "UNITS 100", "Suite of services 2025", "ROOM AND BOARD 1200",
    "Shipped to CA US 90000 units", "Paid In US 10000.00", "wages,IN 10000 and tips", "Proceeds,OR 12345.00",
    "FORM 1099 for SAMPLETOWN, CA 90000 filers", "wages, IN 10000 and tips", "Total proceeds, OR 12345.00",
    "BOX 1 WAGES, TIPS, OTHER COMPENSATION: 120,450.00", "BOX 1b DATE ACQUIRED: 03/15/2025", "LINE 16 TAX: 11,885.00",
    "SCHEDULE CA 90000", "REFERENCE CODE: A1234567",
]
#: The text layer alone.
STRICT = {
    "EMPLOYEE SSN: 123-45-6789": "EMPLOYEE SSN: [SSN-1]",
    "RECIPIENT TIN: 123456789": "RECIPIENT TIN: [SSN-1]",
    "REFERENCE: 123456789": "REFERENCE: [ACCT-...6789]",
    "SSN XXX-XX-4321 WAGES 1,000.00": "SSN [SSN-1] WAGES 1,000.00",
    "SSN ***-**-4321 WAGES 1,000.00": "SSN [SSN-1] WAGES 1,000.00",
    "SSN xxxxx4321 WAGES 1,000.00": "SSN [SSN-1] WAGES 1,000.00",
    "ACCOUNT XXXXXX4321": "ACCOUNT XXXXXX4321",
    "EMPLOYER EIN: 12-3456789": "EMPLOYER EIN: [EIN-1]",
    "contact john.sample@example.com or (555) 123-4567": "contact [EMAIL-1] or [PHONE-1]",
    "HOME ADDRESS: 1234 EXAMPLE STREET, SAMPLETOWN, CA 90000": "HOME ADDRESS: [ADDR-1]",
    "DATE OF BIRTH: 03/15/1980": "DATE OF BIRTH: [DOB-1]",
    "BIRTHDATE March 15, 1980": "BIRTHDATE [DOB-1]",
    "DRIVER LICENSE NO: A1234567": "DRIVER LICENSE NO: [ID-1]",
    "ROUTING NUMBER (ABA): 121099999": "ROUTING NUMBER (ABA): [ROUTING-1]",
    "REFERENCE: 121099999": "REFERENCE: [ACCT-...9999]",
    "MAILING ADDRESS: P.O. BOX 4321": "MAILING ADDRESS: [ADDR-1]",
    "SAMPLETOWN, CA 90000": "[ADDR-1]",
    "SAMPLETOWN, XX 90000": "SAMPLETOWN, XX 90000",
    "PO BOX 1 SAMPLETOWN, CA 90000": "[ADDR-1] [ADDR-2]",
    "STATE ID SAMPLETOWN, CA 90000-1234": "[ADDR-1]",
    "DL SAMPLETOWN, CA 90000-1234": "[ADDR-1]",
    "1234 EXAMPLE STREET FORM SAMPLETOWN, CA 90000": "[ADDR-1] FORM SAMPLETOWN, CA 90000",
    "IMPORTANT TAX RETURN DOCUMENT ENCLOSED  SAMPLETOWN CA 90000": "IMPORTANT TAX RETURN DOCUMENT ENCLOSED  SAMPLETOWN CA 90000",
    "SSN: l23-45-6789": "SSN: l23-45-6789",
}
#: Text from OCR alone.
OCR = {
    "SSN: l23-45-6789": "SSN: [SSN-1]",
    "DATEOFBIRTH:03/15/1980": "DATEOFBIRTH:[DOB-1]",
    "IMPORTANT TAX RETURN DOCUMENT ENCLOSED  SAMPLETOWN, CA 90000": "IMPORTANT TAX RETURN DOCUMENT ENCLOSED  [ADDR-1]",
    "SAMPLETOWN, Ca 90000": "[ADDR-1]",
    "SAN LUIS OBISPO, CA 93401": "[ADDR-1]",
    "TOTAL DIVIDENDS 12345": "TOTAL DIVIDENDS 12345",
    "PAY BY 10000": "PAY BY 10000",
    "BOX 1 WAGES 120450": "BOX 1 WAGES 120450",
    "SEE SCHEDULE CA 12345": "SEE SCHEDULE CA 12345",
    "PAGE 1 OF 3  SAMPLETOWN, CA 90000": "PAGE 1 OF 3  SAMPLETOWN, CA 90000",
}
TABLE = [(line, want, ocr) for ocr in (False, True) for line, want in (BOTH | {s: s for s in STAY} | (OCR if ocr else STRICT)).items()]

#: Entries, and lines under them.
LISTED = [
    ([("name", "JOHN A SAMPLE")], "prepared for JOHN SAMPLE and SAMPLE, JOHN A", "prepared for [NAME-1] and [NAME-1]", False),
    ([("name", "JOHN A SAMPLE"), ("employer", "ACME WIDGETS INC")], "employee: John  A  Sample of ACME WIDGETS INC", "employee: [NAME-1] of [EMPLOYER-1]", False),
    ([("name", "JOHN A SAMPLE")], "First name John A. Last name Sample Suffix", "First name [NAME-1] Last name [NAME-1] Suffix", False),
    ([("name", "JOHN A SAMPLE"), ("name", "JANE SAMPLE")], "First JOHN Spouse JANE Last SAMPLE", "First [NAME-1] Spouse [NAME-2] Last [NAME-1]", False),
    ([("name", "JOHN A SAMPLE")], "CUSTOMER:JOHNASAMPLE", "CUSTOMER:[NAME-1]", True),
    ([("name", "JOHN A SAMPLE")], "CUSTOMER:JOHNASAMPLE", "CUSTOMER:JOHNASAMPLE", False),
    ([("employer", "EXAMPLE CREDIT UNION")], "EXAMPLECREDITUNION", "[EMPLOYER-1]", True),
    ([("ssn", "987-65-4321"), ("ssn", "123 45 6789")], "REF 987654321 and 987 65 4321 and 123-45-6789", "REF [SSN-1] and [SSN-1] and [SSN-2]", False),
    ([("email", "john.sample@example.com")], "CONTACT John.Sample@Example.com OR jane@example.org", "CONTACT [EMAIL-1] OR [EMAIL-2]", False),
    ([("id", "D1234567")], "REF D1234567 X", "REF [ID-1] X", False),
    ([("id", "D1234567")], "REF D12345678 X", "REF D[ACCT-...5678] X", False),
    ([("phone", "555-0142")], "CALL 555-0142 NOW", "CALL [PHONE-1] NOW", False),
    ([("phone", "555-0142")], "CALL 555 0142 NOW", "CALL [PHONE-1] NOW", False),
    ([("addr", "500 INDUSTRY DRIVE, SAMPLETOWN, CA 90001")], "500INDUSTRYDR,SAMPLETOWN,CA90001", "[ADDR-1]", True),
    ([("addr", "500 INDUSTRY DRIVE, SAMPLETOWN, CA 90001")], "[ACCT-...5678]-XX00  500INDUSTRYDR  Return file date:  10/7/2026", "[ACCT-...5678]-XX00  [ADDR-1]  Return file date:  10/7/2026", True),
    ([("addr", "123 MAIN DR, APT 4, SAMPLETOWN, CA 90000")], "AT 123 Main Dr Apt 4", "AT [ADDR-1]", False),
    ([("addr", "123 MAIN DR, APT 4, SAMPLETOWN, CA 90000")], "IN Sampletown CA 90000", "IN [ADDR-1]", False),
    *[([("addr", "77 QUIET HOLLOW, SAMPLETOWN, CA 90000")], f"MAIL {x} END", "MAIL [ADDR-1] END", False) for x in ("77 QUIET HOLLOW, SAMPLETOWN, CA 90000", "77 QUIET HOLLOW     SAMPLETOWN     CA 90000", "77 Quiet Hollow,Sampletown,CA 90000")],
    *[([("addr", "12 N MAIN ST APT 4")], f"AT {x} END", "AT [ADDR-1] END", False) for x in ("12 N MAIN ST APT 4", "12 NORTH MAIN STREET APARTMENT 4", "12 N. Main St., Apt. 4")],
    *[([("dob", "01/02/1980")], f"SEEN {x} HERE", "SEEN [DOB-1] HERE", False) for x in ("01/02/1980", "1/2/1980", "1-2-80", "01.02.1980", "1980-01-02", "January 2, 1980", "JAN 2 1980", "Jan. 2nd, 1980", "2 January 1980")],
    *[([("dob", "September 30, 1975")], f"SEEN {x} HERE", "SEEN [DOB-1] HERE", False) for x in ("9/30/1975", "Sept 30, 1975", "1975-09-30")],
    *[([("dob", "01/02/1980")], f"SEEN {x} HERE", f"SEEN {x} HERE", False) for x in ("01/02/1981", "11/02/1980", "01/02/19801", "2/1/1980", "January 12, 1980")],
    *[([("phone", "(555) 010-0199")], f"CALL {x} NOW", "CALL [PHONE-1] NOW", False) for x in ("(555) 010-0199", "555-010-0199", "555.010.0199", "5550100199", "1-555-010-0199", "+1 555 010 0199")],
]


def numbered(text: str, ocr: bool, pairs: list[tuple[str, str]]) -> str:
    """A line folded on its own, with tokens numbered by first encounter, in plain Python."""
    entries = dictionary.make_entries(pairs)
    line = fold_line(text, ocr, entries, dictionary.name_parts(entries))
    seen: dict[str, dict[str, str]] = {}
    tails: dict[str, int] = {}
    token: dict[int, str] = {}
    for n, h in sorted(enumerate(line.hits), key=lambda x: (x[1]["phase"], x[1]["ord"], -1 if x[1]["start"] is None else x[1]["start"], x[0])):
        norm = re.sub(r"\D", "", h["value"]) if h["kind"] in DIGIT_KINDS else " ".join(h["value"].split()).upper()
        known = seen.setdefault(h["kind"], {})
        if norm not in known and h["kind"] == "ACCT":
            tails[norm[-4:]] = k = tails.get(norm[-4:], 0) + 1
            known[norm] = f"[ACCT-{'' if k == 1 else f'{k}-'}...{norm[-4:]}]"
        token[n] = known.setdefault(norm, f"[{h['kind']}-{len(known) + 1}]")
    return "".join(p["lit"] if p["hit"] is None else token[p["hit"]] for p in line.pieces())


@pytest.mark.parametrize(("line", "want", "ocr"), TABLE)
def test_line(line, want, ocr):
    assert numbered(line, ocr, []) == want


@pytest.mark.parametrize(("pairs", "line", "want", "ocr"), LISTED)
def test_line_under_a_dictionary(pairs, line, want, ocr):
    assert numbered(line, ocr, pairs) == want


def test_tables_as_dataframes(spark):
    """The same lines through Spark: the fold, its native twin, and an audit that finds nothing more."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, 0, line, ocr) for i, (line, _, ocr) in enumerate(TABLE)], LINES)
    kinds = lambda s: re.sub(r"\[([A-Z]+)-[^\]]*\]", r"[\1-Z]", s)
    inert = tokens.inert(fold(df))
    got = {r["doc_ord"]: r["line"] for r in inert.collect()}
    assert [got[i] for i in range(len(TABLE))] == [kinds(want) for _, want, _ in TABLE]
    line = F.col("line")
    twin = dict(df.select("doc_ord", F.when(F.col("is_ocr"), native_text(line, True)).otherwise(native_text(line))).collect())
    shadowed = {i for i, (s, _, ocr) in enumerate(TABLE) if ocr and "l23" in s}  # the twin has no shadow pass
    assert [(i, twin[i]) for i in range(len(TABLE)) if i not in shadowed] == [(i, kinds(w)) for i, (_, w, _) in enumerate(TABLE) if i not in shadowed]
    left = {r["doc_ord"] for r in audit.audit(inert).filter("severity = 'FAIL'").collect()}
    open_ = {i for i, (_, w, ocr) in enumerate(TABLE) if i in left}
    assert open_ == set()


def test_listed_lines_as_dataframes(spark):
    """Values filed by key find what trying each finds, also where they meet lines in a join."""
    from maskwright.operators import fold as folding

    pairs = sorted({p for ps, *_ in LISTED for p in ps})
    entries = dictionary.make_entries(pairs)
    names = dictionary.name_parts(entries)
    lines = [(line, ocr) for _, line, _, ocr in LISTED] + [(line, ocr) for line, _, ocr in TABLE]
    df = spark.createDataFrame([(i, 0, line, ocr) for i, (line, ocr) in enumerate(lines)], LINES)
    want = {i: [(h["phase"], h["ord"], h["kind"], h["original"], h["start"]) for h in fold_line(line, ocr, entries, names).hits] for i, (line, ocr) in enumerate(lines)}
    of = lambda found: {r["doc_ord"]: [(h["phase"], h["ord"], h["kind"], h["original"], h["start"]) for h in r["hits"]] for r in found.collect()}
    assert of(fold(df, entries, names)) == want
    most, folding.SHIPPED = folding.SHIPPED, 3
    try:
        assert of(fold(df, entries, names)) == want
    finally:
        folding.SHIPPED = most


def test_short_suffixes_need_their_space():
    loose = compiled(ADDR, True, True)
    for s in ("7Payer made direct", "0o0ormore of  dividendsorinterest", "7 Payer made direct sales"):
        assert not loose.search(s)
    for s in ("123 MAIN ST", "123 MAIN ST APT 4", "789 NORTH ELM DR", "123MAINSTREET", "456 OAK AVE, SAMPLETOWN CA 90000"):
        assert loose.search(s)


def test_address_variants():
    split = {
        "123 MAIN DR, APT 4, SAMPLETOWN, CA 90000": ["123 MAIN DR, APT 4", "SAMPLETOWN, CA 90000"],
        "123 MAIN DR APT 4 SAMPLETOWN CA 90000": ["123 MAIN DR APT 4", "SAMPLETOWN CA 90000"],
        "77 QUIET HOLLOW SAMPLETOWN CA 90000": [], "500 INDUSTRY DRIVE": [], "500 INDUSTRY DRIVE, SAMPLETOWN": [],
    }
    assert {v: dictionary.address_variants(v)[1:] for v in split} == split


def test_form_wording_is_no_candidate(spark):
    said = [
        "COPY B FOR RECIPIENT", "INSTRUCTIONS FOR RECIPIENTS OF FORM 1099", "RECIPIENT: KEEP FOR YOUR RECORDS", "THIS IS YOUR FORM RECIPIENT",
        "IRS FATCA FILING REQUIREMENT RECIPIENT", "DEPARTMENT OF THE TREASURY RECIPIENT COPY", "SALE ELECTION UNDER SECTION 754 PER TREAS REG 1.754 PARTNER NAME",
        "PTE FEIN 12-3456789 TAXPAYER COPY", "TOTAL WAGES ACME HOLDINGS GROUP PAID TO EMPLOYEE", "RECIPIENT NAME: JOHN A SAMPLE", "PAYER: FIRST FEDERAL CREDIT UNION",
        "PAYER: BANK OF EXAMPLE", "RECIPIENT NAMES JO", "EMPLOYEE ADDRESS: JANE SAMPLE", "RECIPIENT'S NAME: JANE OTHER.",
    ]
    df = spark.createDataFrame([(1, i, s, False) for i, s in enumerate(said)], LINES)
    rows = mining.in_order(mining.suggest(df)).orderBy("nth").collect()
    assert [(r["category"], r["value"]) for r in rows] == [("name", "JOHN A SAMPLE"), ("employer", "FIRST FEDERAL CREDIT UNION"), ("employer", "BANK OF EXAMPLE"), ("name", "JANE OTHER")]
    known = dictionary.make_entries([("name", "JOHN A SAMPLE")])
    assert [r["value"] for r in mining.in_order(mining.suggest(df, known)).orderBy("nth").collect()] == ["FIRST FEDERAL CREDIT UNION", "BANK OF EXAMPLE", "JANE OTHER"]
