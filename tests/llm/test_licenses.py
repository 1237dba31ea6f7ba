"""License scans against a plain version, without the keyword gate and with every pair of detections."""

import re
from collections import Counter

import pytest

from scholium.llm import licenses
from scholium.llm.license_rules import KINDS, rules

ORDERED, NAMES = rules(), list(KINDS)
BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_scan(text, ordered=ORDERED):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in BETWEEN.split(text) if w]
    starts, base = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    joined = f" {' '.join(words)} "
    found = []
    for i, r in enumerate(ordered):
        for m in re.finditer(f"(?<= )(?:{r.regex})(?= )", joined):
            start = joined[: m.start()].count(" ") - 1
            found.append((NAMES.index(r.kind), i, start, start + m.group().count(" ") + 1))
    kept = []
    for k, i, a, b in found:
        if not any(l <= k and c <= a and b <= d and (a - c, d - b) != (0, 0) or (c, d) == (a, b) and (l, j) < (k, i) for l, j, c, d in found):
            kept.append((k, i))
    labels = base | {ordered[i].label for _, i in kept}
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max((list(KINDS.values())[k] for k, _ in kept), default=0.0)


TEXTS = [
    "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.",
    "mit license MIT-LICENSE mit\nlicense mit licenses smit license", "SPDX-License-Identifier: GPL-2.0-or-later", "GNU Lesser General Public License v2.1 and the Apache-2.0 license",
    "licensed under CC BY-SA 4.0; see https://creativecommons.org/licenses/by-sa/4.0/", "MİT LICENSE mıt license", "licénse general public license", "All rights reserved.",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause, see http://www.apache.org/licenses/LICENSE-2.0", "general public license general public license general public license", "", None, " .,;\n", "cc by 2.0 fr licensed under cc by",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Dual licensed under MIT and GPL v2",
]


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_same_as_plain(spark, docs, odd, none):
    made = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (3, TEXTS[3])], "doc_id long, text string")
    long = spark.createDataFrame([(1, "mit license apache license, version 2.0 " * 20_000), (2, "license " + "word " * 200_000)], "doc_id long, text string")
    for df in (made, docs, odd, none):
        assert as_rows(licenses.scan(df)) == Counter((r.doc_id, *plain_scan(r.text)) for r in df.collect())
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(long).collect()}
    assert got[1][:5] == (140_000, 40_000, 0, 139_995, "apache,mit") and got[1][5] == "apache,apache-2.0,mit" and got[1][6] == 0.8


def test_labels_of_usual_notices():
    assert plain_scan(TEXTS[1])[5] == "gpl,gpl-3.0" and plain_scan(TEXTS[4])[5] == "gpl-2.0-or-later" and plain_scan(TEXTS[10])[5:] == ("gpl,gpl-3.0-or-later", 1.0)
    assert plain_scan(TEXTS[5])[5] == "apache-2.0,gpl,lgpl-2.1" and plain_scan(TEXTS[9])[5:] == ("all-rights-reserved", 0.4)


@pytest.mark.parametrize("rule", ORDERED, ids=lambda r: f"{r.kind}-{r.label}")
def test_keyword_is_in_every_match(rule):
    """Without its optional parts and alternatives a regex must still have the keyword."""
    needed, before = rule.regex, None
    while needed != before:
        before, needed = needed, re.sub(r"\(\?:[^()]*\)\??", "", needed)
    assert rule.keyword in re.sub(r"(\w)\?|\[\w+\]", r"\1", needed).split() or rule.keyword in needed.split()
    assert rule.kind in KINDS and not re.search(r" \?|\(\?[=!<]", rule.regex)
