import random
import re
import time

import pytest

from sawmill.llm import licenses

from .conftest import NASTY

CASES = [
    ("Licensed under CC BY-NC 4.0.", "cc-by", "cc-by,cc-by-nc-4.0"),
    ("under the GNU General Public License, version 3.", "gpl", "gpl,gpl-3.0"),
    ("SPDX-License-Identifier: MPL-2.0", "", "mpl"),
    ("GNU Lesser General Public License v2.1 or later", "", "lgpl-2.1-or-later"),
    ("Redistribution and use in source and binary forms, with or without modification", "", "bsd"),
    ("the BSD 3-Clause license", "", "bsd-3-clause"),
    ("nothing here, just prose about a licensee", "", ""),
    ("(C) All rights reserved.", "", "all-rights-reserved"),
    ("creativecommons.org/licenses/by-sa/4.0", "", "cc-by-sa"),
    ("MIT-LICENSE and Apache/License", "apache,mit", "apache,mit"),
]


@pytest.mark.parametrize("text, base, labels", CASES)
def test_labels(spark, text, base, labels):
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.base_labels, r.labels) == (base, labels)
    assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, lab) for p, lab in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({lab for _, lab in places}))


def test_base_by_brute_force(spark, nasty, clashing):
    texts = [t for _, t, *_ in NASTY] + [t for t, *_ in CASES] + ["mit mit license mit license", "CC, by; ccK by", "émit license", "apache\x7flicense", "İ GNU GENERAL PUBLIC LICENSE"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert licenses.scan_licenses(clashing).count() == len(NASTY)


def test_priorities_and_containment():
    s = licenses.Scanner()
    found = s.scan("gnu general public license version 2 or any later version")
    assert [x[0] for x in found] == ["gpl-2.0-or-later"]
    spans = [(a, b) for _, _, a, b, _ in s.scan("apache license 2.0 and the mit license, spdx-license-identifier: isc")]
    assert len(spans) >= 3 and not any(x != y and x[0] <= y[0] and y[1] <= x[1] for x in spans for y in spans)


def test_rules_are_many_and_gated():
    assert len(licenses.RULES) > 200 and all(len(r.keyword) >= 2 for r in licenses.RULES)
    assert len({r.name for r in licenses.RULES}) == len(licenses.RULES)


GATED, UNGATED = licenses.Scanner(), licenses.Scanner([r._replace(keyword="") for r in licenses.RULES])


def example(parsed, space):
    """The shortest text that a parsed regular expression matches: first branches, optional parts left out."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "NOT_LITERAL":
            out += "x"
        elif op == "ANY":
            out += "x"
        elif op == "IN":
            kind, first = arg[0]
            out += {"CATEGORY_SPACE": space, "CATEGORY_DIGIT": "1", "CATEGORY_WORD": "w", "CATEGORY_NOT_SPACE": "x"}[str(first)] if str(kind) == "CATEGORY" else chr(first if str(kind) == "LITERAL" else first[0])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += example(arg[2], space) * arg[0]
        elif op == "SUBPATTERN":
            out += example(arg[3], space)
        elif op == "BRANCH":
            out += example(arg[1][0], space)
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    return out


@pytest.mark.parametrize("space", [" ", "\n", " \t\n  "])
def test_gated_and_ungated_scans_agree_for_an_example_of_every_rule(space):
    for rule in licenses.RULES:
        text = example(re._parser.parse(rule.regex), space)
        assert re.search(rule.regex, text), (rule.name, text)
        ungated = UNGATED.scan(text)
        assert ungated and licenses.Scanner([rule]).scan(text) and GATED.scan(text) == ungated, (rule.name, text)


@pytest.mark.parametrize(
    "text, label",
    [("Distributed under Apache 2.0.", "apache-2.0"), ("MPL-2.0", "mpl-2.0"), ("EPL 2.0", "epl-2.0"), ("BUSL-1.1", "busl-1.1"), ("NCSA Open Source License", "ncsa"), ("Redistribution and\nuse in source and binary forms, with or without modification", "bsd")],
)
def test_short_names_and_broken_lines(text, label):
    assert [x[0] for x in GATED.scan(text.lower())] == [label]


def test_sweep_keeps_what_comparing_all_keeps():
    rng = random.Random(2)
    names = [example(re._parser.parse(r.regex), " ") for r in rng.sample(licenses.RULES, 60)]
    text = " ".join(rng.choice(names) for _ in range(400))
    kept = []
    plain = " ".join(text.split())
    for rule in licenses.RULES:
        for m in re.finditer(rule.regex, text) if rule.keyword in plain else ():
            if not any(a <= m.start() and m.end() <= b for a, b, _ in kept):
                kept.append((*m.span(), rule.name))
    assert sorted((a, b, n) for _, n, a, b, _ in GATED.scan(text)) == sorted(kept) and len(kept) > 300


def test_many_detections_take_linear_time():
    began = time.monotonic()
    assert len(GATED.scan("mit license, " * 20_000)) == 20_000
    assert time.monotonic() - began < 20


def test_empty(empty):
    assert licenses.scan_licenses(empty).collect() == []
