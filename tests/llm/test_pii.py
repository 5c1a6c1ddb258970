import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest

from sawmill.llm import pii

from .conftest import NASTY

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for kind, p in BASE:
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    "mail a@b.c_d@e.f and a.b+c%d@x-y.co.uk, no@tld, @x.y, a@b@c.d",
    "ip 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0255.000.1.01 1.2.3 1..2.3.4",
    "card 4242 4242 4242 4242 and 4242-4242-4242-4243, 4065505858411061, 12 34",
    "call +1 (246) 555-8083 or +49.30.1234567 or +123 or +1 ((((, +1(2)3 4-5.6 7 8 9 0 1 2 3 4 5 6 7",
    "漢字 \U0001f600 x@y.zz +1 222 333 4444 é 10.0.0.1",
    "4242424242424242 4242424242424242 1.1.1.1",
    "99999999999999999999999.1.1.1 1.1.1.99999999999999999999",
    "",
    None,
    "1" * 30_000 + " a@b.c",
    "a" * 60_000,
    "a." * 20_000 + "@",
    "+" * 5_000 + "1 2345678",
]


def test_base_like_the_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii.digest(pii.find(df)).collect():
        t = TEXTS[r.doc_id] or ""
        if len(t) > 50_000 or t.startswith("a."):  # the plain forms take quadratic time here
            assert r.n_email + r.n_ip + r.n_card + r.n_phone == 0
            continue
        want = brute(t)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t[:80], want, r)
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k + ":") for w in want) for k in pii.KINDS)


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [(i, f"note {i}: please phone office +1 (555) 010-{1000 + i} today") for i in range(12)]
    unseen = [(100, "please phone office 5550107788 today"), (101, "the sum was 5550107788 today, more or less")]
    noise = [(200 + i, f"the sum was {i * 7919} and so on") for i in range(30)]
    rows = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(seeds + unseen + noise, "doc_id long, text string"))).collect()}
    assert rows[100] == "phone:20:30" and rows[101] == ""
    assert all(rows[200 + i] == "" for i in range(30))


def graph(marked, rounds):
    """The graph's scores by plain Python."""
    known, unknown = set(), set()
    names = lambda left: {" ".join(left.split()[-2:]), *left.split()[-1:]} - {""}
    for r in marked:
        for s in r.seeds or ():
            known |= {(p, s.kind, s.value) for p in names(s.left)}
        for s in r.others or ():
            unknown |= {(p, s.value.lower()) for p in names(s.left)}
    size = Counter(p for p, *_ in known) + Counter(p for p, _ in unknown)
    accepted, scores = {}, {}
    for _ in range(rounds):
        n = Counter((p, k) for p, k, _ in known) + Counter((p, accepted[v]) for p, v in unknown if v in accepted)
        scores = {(p, k): m / size[p] * (1 - 1 / (1 + math.log2(1 + m))) for (p, k), m in n.items() if m >= pii.MIN_SEEDS}
        miss = {}
        for p, v in unknown:
            for k in range(4):
                if (p, k) in scores:
                    miss[v, k] = miss.get((v, k), 1.0) * max(1e-9, 1 - scores[p, k])
        accepted = {}
        for (v, k), m in sorted(miss.items(), key=lambda x: (-x[1], -x[0][1])):
            if 1 - m >= pii.BELIEF:
                accepted[v] = k
    return scores


def bootstrap_docs(spark):
    seeds = [(i, f"note {i}: please phone office +1 (555) 010-{1000 + i} today") for i in range(12)]
    # Found behind "phone office", and then the reason why "dial desk" is a pattern.
    unseen = [(100 + i, f"please phone office 55501077{i:02d} today") for i in range(5)] + [(120 + i, f"or dial desk 55501077{i:02d} instead") for i in range(5)]
    last = [(140, "or dial desk 030 123 4567 instead")]
    noise = [(200 + i, f"the sum was {i * 7919} and so on") for i in range(30)]
    return spark.createDataFrame(seeds + unseen + last + noise, "doc_id long, text string")


def test_instances_found_induce_patterns(spark):
    docs = bootstrap_docs(spark)
    rows = {r.doc_id: r.spans for r in pii.digest(pii.find(docs)).collect()}
    assert all(rows[100 + i] and rows[120 + i] for i in range(5))
    assert rows[140] == "phone:13:25" and all(rows[200 + i] == "" for i in range(30))


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_graph_scores_like_plain_python(spark, rounds):
    marked = pii._marked(bootstrap_docs(spark))
    want = graph(marked.collect(), rounds)
    got = {(r.pattern, r.kind): r.score for r in pii.score_patterns(marked, rounds).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_many_matches_take_linear_time(spark):
    def seconds(n):
        text = "1.1.1.1 x1111 " * n
        began = time.monotonic()
        r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert r.n_ip == n and r.base[-1].end == len(text) - 7 and r.base[n - 1].start == 14 * (n - 1)
        return time.monotonic() - began

    seconds(100)
    small = seconds(4_000)
    assert seconds(12_000) < 5 * small + 5


def test_instances_apart_from_many_base_spans(spark):
    text = " ".join(f"{i % 250}.1.1.1 order {i:06d} a{i}@b.cc" if i % 3 else f"+1 555 010 {i % 10000:04d} k{i:05d}" for i in range(300))
    r = pii._marked(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = [x for x in re.finditer(r"(?<!\S)[^\s0-9@]*[0-9@]\S*(?:\x20[(0-9][0-9()./-]*(?!\S))*", text) if len(x[0]) >= 5 and not any(s.start < x.end() and x.start() < s.end for s in r.base)]
    assert len(r.base) > 300 and [(s.start, s.value) for s in r.others] == [(x.start(), x[0]) for x in want] and want
    assert all(s.left == re.search(r"(\S+\s+\S+|\S+)\s*$", text[max(0, s.start - 80) : s.start].lower())[1] for s in r.others if s.start > 80)


def test_main_path_is_native(spark, capsys):
    df = spark.createDataFrame(list(enumerate(TEXTS[:6])), "doc_id long, text string")
    pii.digest(pii.find(df)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "write a@b.cc or +1 (246) 555-8083, at 10.0.0.1", 5), (2, None, 5), (3, "clean", 5)], "doc_id long, text string, row int")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "write <EMAIL> or <PHONE>, at <IP>", 2: None, 3: "clean"}


def test_redaction_of_long_texts(spark):
    """Spans at and across the ends of pieces, overlapping ones, wide characters."""
    rng = random.Random(3)
    items = [("4242424242424242", "<CARD>"), ("a@b.cc", "<EMAIL>"), ("+1 (246) 555-8083", "<PHONE>"), ("10.0.0.1", "<IP>"), ("+4242424242424242", "+<CARD>")]
    rows, want = [], {}
    for i in range(30):
        parts = [(rng.choice(["x", "\U0001f600", "é\n"]) * rng.randrange(1, 2 * pii.PIECE // 3), None) if rng.random() < 0.6 else rng.choice(items) for _ in range(30)]
        rows.append((i, " | ".join(a for a, _ in parts)))
        want[i] = " | ".join(a if b is None else b for a, b in parts)
    rows.append((50, "x" * (pii.PIECE - 3) + " 10.0.0.1@a.bc " + "y " * 3000))
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == want[i] for i in want)
    assert got[50] == "x" * (pii.PIECE - 3) + " <IP> " + "y " * 3000


def test_nasty_rows(spark, nasty, clashing, empty):
    for df in (nasty, clashing):
        rows = pii.digest(pii.find(df)).collect()
        assert len(rows) == len(NASTY) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
        assert pii.redact(df).count() == len(NASTY)
    assert pii.find(empty).collect() == [] and pii.redact(empty).collect() == []


@pytest.mark.parametrize("number, good", [("4242424242424242", True), ("4242424242424241", False), ("378282246310005", False), ("6011000990139424", True)])
def test_luhn(spark, number, good):
    r = pii.find(spark.createDataFrame([(1, number)], "doc_id long, text string")).first()
    assert bool(r.n_card) == good
