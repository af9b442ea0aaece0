"""Patterns, word lists and constants.

Fixed values: everything down to the end mark must equal what users of existing
lists and extracts rely on, the order of the rules too, so it is stated as plain
text.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

# ---------------------------------------------------------------- fixed values

SSN_SEP = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
SSN_SPACED = r"(?<!\d)\d{3} \d{2} \d{4}(?!\d)"
SSN_MASKED = r"(?<![\w*#•])[Xx*#•]{3}[- ]?[Xx*#•]{2}[- ]?\d{4}(?!\w)"
NINE_DIGITS = r"(?<!\d)\d{9}(?!\d)"
EIN = r"(?<!\d)\d{2}-\d{7}(?!\d)"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"\(?\d{3}\)?[-. ]\s?\d{3}[-. ]\d{4}(?!\d)"
ACCT = r"(?<!\d)(?<!\d\.)(?<![^\w]\.)(?<!^\.)\d{8,}(?!\d)(?!\s?%)"
ACCT_LABELED = r"(?:ACCOUNT|ACCT)\.?\s*(?:NO\.?|NUMBER|NUM\.?|#)\s*:?\s*(?P<v>(?=[A-Z0-9-]*\d)[A-Z0-9][A-Z0-9-]{4,19})(?![\w-])"
DOB_NUM = r"(?<!\d)\d{1,2}[/-]\d{1,2}[/-]\d{2,4}(?!\d)"
DOB_WORD = r"(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\.?\s+\d{1,2},?\s+\d{4}"
ID_TOKEN = r"(?<![A-Za-z0-9])[A-Z]{0,2}\d[A-Z0-9-]{4,14}(?![A-Za-z0-9])"
DOCUSIGN_ID = r"(?<![0-9A-Za-z])[0-9A-F]{12,}\.{3}"
ENVELOPE_ID = r"(?<![0-9A-Za-z])[0-9A-F]{8}(?:-[0-9A-F]{4}){3}-[0-9A-F]{12}(?![0-9A-Za-z])"

SSN_CONTEXT = r"SSN|SOCIAL\s+SECURITY|\bTIN\b|\bEIN\b"
DOB_CONTEXT = r"\bDOB\b|DATE\s+OF\s+BIRTH|BIRTH\s?DATE"
ID_CONTEXT = r"DRIVER'?S?\s?LIC|LICENSE\s?(?:NO|NUMBER|#)|\bDL\b|STATE\s+ID|\bID\s?(?:NO|NUMBER|#)"
ROUTING_CONTEXT = r"ROUTING|\bABA\b|\bRTN\b"
ENVELOPE_CONTEXT = r"ENVELOPE\s+ID"
FORM_VOCAB = r"SCHEDULE|\bFORM\b|\bBOX\b|\bLINE\b|\bPAGE\b"

STREET_SUFFIXES = "STREET|AVENUE|AVE|ROAD|RD|DRIVE|DR|LANE|LN|WAY|BLVD|BOULEVARD|COURT|CT|CIRCLE|CIR|PLACE|PL|TERRACE|TER|ST"
STREET_SUFFIXES_LONG = "STREET|AVENUE|DRIVE|LANE|BLVD|BOULEVARD|COURT|CIRCLE|PLACE|TERRACE"
EVERYDAY_SUFFIXES = "CENTER CTR PLAZA PLZ PARKWAY PKWY HIGHWAY HWY SQUARE SQ TRAIL TRL".split()
UNIT_NAMES = "SUITE STE APT APARTMENT UNIT ROOM RM FLOOR".split()
ADDRESS_SYNONYMS = [
    ["STREET", "ST"],
    ["AVENUE", "AVE", "AV"],
    ["ROAD", "RD"],
    ["DRIVE", "DR"],
    ["LANE", "LN"],
    ["BOULEVARD", "BLVD"],
    ["COURT", "CT"],
    ["CIRCLE", "CIR"],
    ["PLACE", "PL"],
    ["TERRACE", "TER"],
    ["PARKWAY", "PKWY"],
    ["HIGHWAY", "HWY"],
    ["SQUARE", "SQ"],
    ["TRAIL", "TRL"],
    ["CENTER", "CTR"],
    ["PLAZA", "PLZ"],
    ["NORTH", "N"],
    ["SOUTH", "S"],
    ["EAST", "E"],
    ["WEST", "W"],
    ["APARTMENT", "APT"],
    ["SUITE", "STE"],
]
UNIT_MARKS = "APT UNIT STE SUITE #".split()
STATES = (
    "AL|AK|AZ|AR|CA|CO|CT|DE|DC|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|"
    "UT|VT|VA|WA|WV|WI|WY"
)
TOKEN = r"\[[A-Z]+[A-Z0-9.\-]*\]"

_both = lambda words: "|".join(f"{w}|{w.capitalize()}" for w in words)
_SEP = r"(?:,\s*|\s+)"
_UNIT = r"(?:,?\s*(?:(?:APT|UNIT|STE|SUITE)\b\.?|#)\s*[\w-]+)?"
_NAME_WORD = r"(?!\d[\d,]*\.\d{2}(?!\d))(?!\d+\s)[A-Za-z0-9'.\-]+"
_STREET = rf"(?<!\d[.,])\d+(?![.,]?\d)\s+(?:{_NAME_WORD}\s+){{1,4}}(?:(?<=[ \t])(?:{STREET_SUFFIXES}|(?-i:{_both(EVERYDAY_SUFFIXES)}))|(?:{STREET_SUFFIXES_LONG})){_UNIT}"
_CITY_ZIP = rf",\s*[A-Za-z .]+{_SEP}[A-Za-z]{{2}}\s+\d{{5}}(?:-\d{{4}})?"
ADDR = rf"(?<!\w)(?:{_STREET}(?:{_CITY_ZIP})?|{_CITY_ZIP})(?!\w)"
POBOX = rf"\bP\.?\s?O\.?\s?BOX\s+\d+(?:{_CITY_ZIP})?"
UNIT_ALONE = rf"(?<![\w-])(?:(?:{_both(UNIT_NAMES)})\b\.?\s*#?\s*(?=[A-Za-z-]{{0,3}}\d)[\w-]+|\d{{1,3}}(?:ST|ND|RD|TH|st|nd|rd|th)\s+(?:FLOOR|Floor))(?!\w)"
CITY_LINE = rf"^(?:\s*{TOKEN})*\s*(?P<v>[A-Za-z][A-Za-z .]{{1,40}}{_SEP}(?:{STATES})\s+\d{{5}}(?:-\d{{4}})?)(?:\s*{TOKEN})*\s*$"
_CITY = r"(?<![\w,])[A-Z][A-Za-z.'\-]*(?:\s[A-Z][A-Za-z.'\-]*){0,2}"
CITY_US_INLINE = rf"{_CITY}{_SEP}(?:{STATES})\s+USA?\s+\d{{5}}(?:-\d{{4}})?(?![\w-]|[.,]\d)"
CITY_ZIP4_INLINE = rf"{_CITY}{_SEP}(?:{STATES})\s+\d{{5}}-\d{{4}}(?![\w-])"
CITY_INLINE = rf"{_CITY},\s*(?:{STATES})\s+\d{{5}}(?![\w-]|[.,]\d)"
_CITY_CORE = rf"[A-Za-z][A-Za-z.]*(?:\s[A-Za-z.]+){{0,2}}{_SEP}(?:{STATES})\s+\d{{5}}(?:-\d{{4}})?"
CITY_EDGE_OCR = rf"(?:^\s*{_CITY_CORE}(?=\s\s|\s*$))|(?:(?<=\s){_CITY_CORE}\s*$)"

SIG_LABEL = r"(Docu)?Signed\s+by:"
SIG_LABEL_STRICT = r"DocuSigned\s+by:"
ESIGN_HEADER = r"DOCU\s*SIGN\s+ENVELOPE\s+ID"
CERT_TITLE = r"CERTIFICATE\s+OF\s+COMPLETION"
SIG_MENTION = r"docu\s*sign|signed\s*by|signature"
NAME_LABEL = r"PAYER|EMPLOYER|EMPLOYEE|RECIPIENT|TAXPAYER|SPOUSE|CUSTOMER|\bNAME\b"
CAPS_RUN = r"\b[A-Z][A-Z&'.\-]+(?:\s+[A-Z][A-Z&'.\-]*)+"
CAPS_BLOB = r"\b[A-Z][A-Z&'.\-]{7,}\b"
SUGGEST_SKIP = r"ADDRESS"
SUGGEST_EMPLOYER = r"\bPAYER|\bEMPLOYER\b|BANK|BROKER|FUND"
AFTER_LABEL = r"(?:'?S)?(?:\s+NAMES?)?\s*[:\-]?\s*"
LIST_LINE = r"\s*([A-Za-z]+)\s*:\s*(.*)$"

LOOKALIKE = {"O": "0", "o": "0", "l": "1", "I": "1"}
SHADOW_KINDS = ("SSN", "EIN", "PHONE", "ROUTING", "ACCT")
DIGIT_KINDS = ("SSN", "EIN", "ACCT", "ROUTING")
CATEGORIES = {"name": "NAME", "addr": "ADDR", "acct": "ACCT", "employer": "EMPLOYER", "ssn": "SSN", "email": "EMAIL", "dob": "DOB", "id": "ID", "phone": "PHONE"}
ALIASES = {"social": "ssn", "address": "addr", "account": "acct"}
MONTHS = "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER".split()

AUDIT_STOPWORDS = (
    "PAYER PAYERS EMPLOYER EMPLOYERS EMPLOYEE RECIPIENT RECIPIENTS TAXPAYER SPOUSE CUSTOMER NAME ADDRESS HOME MAILING STREET SSN TIN EIN ID NO "
    "NUMBER ACCT ACCOUNT STATE FILING STATUS DOB DATE OF BIRTH DRIVER LICENSE ROUTING ABA RTN AND OR THE FAKE TEST DOCUMENT ALL VALUES FABRICATED"
).split()
SUGGEST_NEVER = (
    "FOR TO BY IN ON AT IF IS ARE BE AS IT THIS THAT YOUR YOU WITH FROM NOT SEE KEEP COPY FORM FORMS INSTRUCTIONS IRS FATCA OMB VOID CORRECTED BOX "
    "LINE PAGE SCHEDULE RECORDS UNDER SECTION SEC CODE PART PURSUANT TREAS REG REGS REGULATION REGULATIONS ELECTION SALE PTE FEIN PER ACT"
).split()
SUGGEST_NOT_A_PERSON = (
    "OF TAX TAXES RETURN STATEMENT INFORMATION DEPARTMENT TREASURY INTERNAL REVENUE SERVICE FEDERAL INCOME WITHHELD WITHHOLDING REQUIREMENT REQUIRED "
    "IMPORTANT NOTICE TOTAL AMOUNT PAYMENT PAYMENTS DIVIDENDS INTEREST PROCEEDS WAGES SUMMARY DETAIL CONSOLIDATED YEAR"
).split()

PAGE_SEP = "===== PAGE {n} ====="
LINE_ENDS = "\r\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
MIN_TEXT_CHARS = 20
OCR_NOTE = "OCR-DERIVED"
STAMP_LEFT = "[SIGNATURE] stamp label remains"
NAME_LEFT = "possible unredacted name"



@dataclass(frozen=True)
class Rule:
    """A pattern of the fold. gate is tested on the untouched line, unless on what is left of it."""

    name: str
    kind: str
    pattern: str
    any_case: bool = False
    gate: str | None = None
    unless: str | None = None
    ocr_only: bool = False

    @property
    def reason(self) -> str:
        return f"[PATTERN:{self.kind}]"


#: In the order in which they are folded over a line.
RULES = (
    Rule("signer_id", "SIGNATURE", DOCUSIGN_ID),
    Rule("envelope", "ENVELOPE", ENVELOPE_ID, True, ENVELOPE_CONTEXT),
    Rule("ssn_sep", "SSN", SSN_SEP),
    Rule("ssn_spaced", "SSN", SSN_SPACED),
    Rule("ssn_masked", "SSN", SSN_MASKED),
    Rule("ssn_bare", "SSN", NINE_DIGITS, False, SSN_CONTEXT),
    Rule("ein", "EIN", EIN),
    Rule("email", "EMAIL", EMAIL),
    Rule("phone", "PHONE", PHONE),
    Rule("dob_num", "DOB", DOB_NUM, False, DOB_CONTEXT),
    Rule("dob_word", "DOB", DOB_WORD, True, DOB_CONTEXT),
    Rule("routing", "ROUTING", NINE_DIGITS, False, ROUTING_CONTEXT),
    Rule("po_box", "ADDR", POBOX, True),
    Rule("address", "ADDR", ADDR, True),
    Rule("unit", "ADDR", UNIT_ALONE),
    Rule("city_us", "ADDR", CITY_US_INLINE),
    Rule("city_zip4", "ADDR", CITY_ZIP4_INLINE),
    Rule("city_inline", "ADDR", CITY_INLINE, unless=FORM_VOCAB),
    Rule("city_line", "ADDR", CITY_LINE, unless=FORM_VOCAB),
    Rule("city_edge", "ADDR", CITY_EDGE_OCR, True, unless=FORM_VOCAB, ocr_only=True),
    Rule("acct_labeled", "ACCT", ACCT_LABELED, True),
    Rule("id_token", "ID", ID_TOKEN, False, ID_CONTEXT),
    Rule("acct", "ACCT", ACCT),
    Rule("city_line_again", "ADDR", CITY_LINE, unless=FORM_VOCAB),
    Rule("city_edge_again", "ADDR", CITY_EDGE_OCR, True, unless=FORM_VOCAB, ocr_only=True),
)

# -------------------------------------------------------------- end of fixed values

#: So many digits in a row has every match of a rule, or one at least; those of signer_id, envelope and email need none.
DIGITS = {"signer_id": 0, "envelope": 0, "email": 0, "ssn_bare": 9, "routing": 9, "acct": 8, "ein": 7} | dict.fromkeys(("ssn_sep", "ssn_spaced", "ssn_masked", "phone", "dob_word"), 4)
DIGITS |= dict.fromkeys(("city_us", "city_zip4", "city_inline", "city_line", "city_edge", "city_line_again", "city_edge_again"), 5)


def loosened(pattern: str) -> str:
    """For text from OCR, which drops spaces: white space that a pattern asks for is optional."""
    return pattern.replace(r"\s+", r"\s*").replace(r"\s?", r"\s*")


@functools.lru_cache(maxsize=100_000)
def compiled(pattern: str, any_case: bool = False, ocr: bool = False) -> re.Pattern[str]:
    return re.compile(loosened(pattern) if ocr else pattern, re.IGNORECASE if any_case else 0)


def for_java(pattern: str, any_case: bool = False, ocr: bool = False) -> str:
    """The same pattern for Spark's own regex functions, with Unicode classes."""
    out = (loosened(pattern) if ocr else pattern).replace("(?P<", "(?<")
    return ("(?iuU)" if any_case else "(?U)") + out
