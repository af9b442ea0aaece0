"""op3's rules written by hand: every one has a text, and finds its label in it."""

from __future__ import annotations

import random
import time
from re import _parser

import pytest
from test_contracts import frame
from test_license_gate import match_of

from maskwright.llm.license_rules import GENERAL, NOTICES, TEXTS, parsed
from maskwright.llm.license_scan import RULES, digest, license_scan

HAND = [(label, pattern) for block in (TEXTS, NOTICES, GENERAL) for label, pattern in dict.fromkeys((r[0], r[2]) for r in parsed(block))]
SAID = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
    "you may not use this file except in compliance with the License.": "apache",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl",
    "Released under the MIT license, see LICENSE": "mit",
    "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "bsd",
    "http://www.apache.org/licenses/LICENSE-2.0": "apache",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.": "apache",
    "The Software shall be used for Good, not Evil.": "json",
    "Distributed under the Boost Software License, Version 1.0.": "bsl",
    "altered source versions must be plainly marked as such, and must not be misrepresented": "zlib",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND": "warranty",
    "Copyright (c) 2019-2021 Somebody. All rights reserved.": "proprietary",
    "https://creativecommons.org/publicdomain/zero/1.0/": "cc0",
}


def test_most_rules_are_written_by_hand():
    assert len(HAND) >= 200 and len(set(HAND)) == len(HAND)


def test_each_rule_finds_its_label(spark):
    rnd = random.Random(6)
    said = [(label, match_of(rnd, _parser.parse(pattern))) for label, pattern in HAND]
    rows = [(i, t, None, None, None, "", 0) for i, (_, t) in enumerate(said)]
    only = [r for r in RULES if (r.label, r.pattern) in set(HAND)]
    got = {r["doc_id"]: {x["label"] for x in r["found"]} for r in license_scan(frame(spark, rows), rule_list=only).collect()}
    # what a stronger rule says of the whole text counts as found
    missed = [(label, t, got[i]) for i, (label, t) in enumerate(said) if not got[i]]
    assert not missed
    assert sum(label in got[i] for i, (label, _) in enumerate(said)) >= 0.95 * len(said)


def test_sentences_as_they_stand_in_files(spark):
    rows = [(i, t, None, None, None, "", 0) for i, t in enumerate(SAID)]
    got = {r["doc_id"]: r["labels"].split(",") for r in digest(license_scan(frame(spark, rows))).collect()}
    assert [(t, label) for i, (t, label) in enumerate(SAID.items()) if label not in got[i]] == []


@pytest.mark.parametrize("said", ["cc by ", "the mit license and apache license 2 0 or later "])
def test_time_grows_with_the_text(spark, said):
    """Many matches in one text: twice the text takes about twice the time, and all are found."""
    took = []
    for n in (500, 8000, 16_000):
        began = time.time()
        (row,) = digest(license_scan(frame(spark, [(1, said * n, None, None, None, "", 0)]))).collect()
        took.append(time.time() - began)
        assert row["n_base"] == n * (1 if said == "cc by " else 2)
    assert took[2] < 3 * took[1] + 5
