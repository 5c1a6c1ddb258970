import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sawmill.llm import decontam

from .conftest import NASTY


def distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        prev, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            prev, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, prev + (p != c))
        best = min(best, row[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=70), st.text("abc", max_size=90))
def test_myers(pattern, text):
    got = decontam.myers(pattern, text, len(pattern))
    want = distance(pattern, text)
    assert (got[0] if got else len(pattern)) == want


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "z" + text[i + 1 :]])
    return text


def test_finds_what_brute_force_finds(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(25)) for i in range(8)]
    docs = []
    for i in range(60):
        item = items[i % 8][1]
        docs.append((i, prose(40) + " " + (edited(rng, item, i // 4) if i % 2 else "") + " " + prose(40)))
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            x, t2 = f" {decontam.normalise(x)} ", f" {decontam.normalise(t)} "
            n = distance(x, t2)
            if n <= int(len(x) * decontam.ERROR_RATE):
                want[d, i] = n
    assert got == want and want and len(want) < 30


def test_items_match_whole_words(spark):
    items = spark.createDataFrame([(1, "the other"), (2, "a"), (3, "the"), (4, "is a cat")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "bathe others"), (2, "see the other one"), (3, "this is a catalogue"), (4, "the is a cat.")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.end) for r in decontam.contaminated(docs, items).collect())
    assert got == [(2, 1, 4, 13), (4, 4, 4, 12)]


def test_clean_keeps_other_texts_of_an_id(spark):
    items = spark.createDataFrame([(1, "some benchmark item to find")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "has some benchmark item to find"), (1, "has nothing")], "doc_id long, text string")
    assert [r.text for r in decontam.clean(docs, items).collect()] == ["has nothing"]


def test_blocks_of_items_agree(spark):
    items = spark.createDataFrame([(i, f"item number {i} says something of its own {i * i}") for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before. Item, number {i} SAYS something of its own {i * i}! after") for i in range(30)], "doc_id long, text string")
    one = sorted(map(tuple, decontam.contaminated(docs, items).collect()))
    many = sorted(map(tuple, decontam.contaminated(docs, items, block_chars=200).collect()))
    assert one == many and {(r[0], r[1]) for r in one} >= {(i, i) for i in range(30)}


def test_nasty_rows(spark, nasty, empty, clashing):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy"), (2, None), (3, ""), (4, "..."), (None, "long long"), (1, "quick brown fox jumps over the lazy")], "item_id long, text string")
    for docs in (nasty, clashing):
        assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()) == [(1, 1), (4, 1), (4, 1)]
        kept = decontam.clean(docs, items)
        assert kept.columns == docs.columns and kept.count() == len(NASTY) - 3
    assert decontam.contaminated(empty, items).collect() == []
    assert decontam.contaminated(nasty, items.limit(0)).collect() == []
    assert decontam.clean(nasty, items.limit(0)).count() == len(NASTY)
