"""op5: keys of letters only and of digits only are tested too."""

from __future__ import annotations

import random
import string

import pytest
from pyspark.sql import functions as F
from test_contracts import frame

from maskwright.llm.secret_scan import ALPHABETS, _candidate, secret_scan


@pytest.mark.parametrize("alphabet", [string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase, string.digits])
def test_random_keys_of_letters_or_digits_only_are_found(spark, alphabet):
    rnd = random.Random(8)
    keys = ["".join(rnd.choices(alphabet, k=40)) for _ in range(60)]
    names = [("getTheCustomerOrderLineItemForTheSupplier" + chr(65 + i % 26)).ljust(44, "s") if alphabet != string.digits else f"{i % 7}" * 44 for i in range(60)]
    rows = [(i, f"value {x} here", None, None, None, "", 0) for i, x in enumerate(keys + names)]
    found = {r["doc_id"]: len(r["random"]) for r in secret_scan(frame(spark, rows)).collect()}
    # few of 60 are under the threshold; a digit string can be a hex run of the base too, and is then left out there
    taken = sum(found[i] for i in range(60))
    assert (taken == 0 if alphabet == string.digits else taken >= 48) and sum(found[i] for i in range(60, 120)) <= 6


def test_every_long_run_is_a_candidate(spark):
    said = {"abcdefghij" * 3: "lower", "ABCDEFGHIJ" * 3: "upper", "abcdeFGHIJ" * 3: "letters", "0123456789" * 3: "decimal", "0123abcdef" * 3: "hex", "abc-DEF_ghi" * 3: "base64", "-" * 30: "base64"}
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    got = dict(rows.select("i", _candidate(F.col("t"))).collect())
    assert [[list(ALPHABETS)[c["grp"] // 10 - 1] for c in got[i]] for i in range(len(said))] == [[x] for x in said.values()]
