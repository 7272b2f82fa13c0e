"""Leaked passages against brute force."""

import random

from quarrycast.llm import leaks
from quarrycast.llm.words import words
from tests.conftest import rows


def brute(docs, items, least):
    grams = lambda t: {tuple(w[i : i + least]) for w in [words(t)] for i in range(len(w) - least + 1)}
    return sorted({(d, i) for d, t in docs for i, x in items if grams(t) & grams(x)})


def corpus(rng, least=4):
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(1, 14))) for i in range(30)]
    docs = []
    for d in range(120):
        own = text(rng.randint(0, 30)).split()
        if d % 2:
            piece = rng.choice(items)[1].split()
            a = rng.randint(0, len(piece))
            own[len(own) // 2 : len(own) // 2] = piece[a : a + rng.randint(1, 10)]
        docs.append((d, ", ".join(own).title()))
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus(random.Random(2))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = rows(leaks.find(d, i, min_words=4).distinct())
    assert got == sorted(brute(docs, items, 4), key=lambda r: tuple((x is None, str(x)) for x in r)) and len(got) > 30
    assert rows(leaks.find(d, i, min_words=4, block_mb=0.0004).distinct()) == got  # items in blocks


def test_longest_lengths():
    auto = leaks.Automaton([(1, "a b c d".split()), (2, "x b c d e".split()), (3, "b c d".split())], 3)
    assert [(p, n, sorted(i)) for p, n, i in auto.matches("q b c d e a b c d".split())] == [(3, 3, [1, 2, 3]), (4, 4, [2]), (7, 3, [1]), (8, 4, [1, 2, 3])]


def test_spans_and_removal(spark):
    d = spark.createDataFrame([(1, "Keep this. One two THREE four five! And that is far from all of it."), (2, None), (3, ""), (4, "one two three four"), (5, "nothing here")], "doc_id long, text string")
    i = spark.createDataFrame([(9, "zero one two three four"), (8, None), (7, "")], "item_id long, text string")
    assert rows(leaks.spans(d, i, min_words=3)) == [(1, 11, 29, 4), (4, 0, 18, 4)]
    out = {r.doc_id: (r.text, round(r.leaked_share, 2)) for r in leaks.without_leaks(d, i, min_words=3).collect()}
    assert out == {1: ("Keep this.  five! And that is far from all of it.", 0.27), 2: (None, 0.0), 3: ("", 0.0), 4: ("", 1.0), 5: ("nothing here", 0.0)}


def test_defined_cases(spark):
    """Nulls, repeated rows, long texts, clashing columns, empty tables."""
    long_ = "pad " * 200_000 + "a b c"
    d = spark.createDataFrame([(1, long_, "x"), (1, long_, "x"), (None, "a b c", "y"), (2, None, None)], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(5, "a b c", 1), (5, "a b c", 2), (6, "a b c", 3), (None, "a b c", 4)], "item_id long, text string, doc_id int")
    assert rows(leaks.find(d, i, min_words=3)) == [(1, 5), (1, 5), (1, 6), (1, 6), (None, 5), (None, 6)]
    assert leaks.find(d.where("false"), i, min_words=3).count() == 0
    assert leaks.find(d, i.where("false"), min_words=3).count() == 0
