"""The similarity join against all pairs, and the defined cases."""

import random
from itertools import combinations

from quarrycast.llm import neardup
from quarrycast.llm.words import words
from tests.conftest import rows


def brute(docs, threshold, n):
    sets = {i: {tuple(w[k : k + n]) for w in [words(t)] for k in range(len(w) - n + 1)} for i, t in docs}
    return sorted((a, b) for a, b in combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold)


def corpus(rng, n):
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.6:
            w = rng.choice(docs)[1].split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 99)}"
        else:
            w = [f"w{rng.randint(0, 400)}" for _ in range(60)]
        docs.append((i + 1, " ".join(w)))
    return docs


def test_all_pairs_are_found(spark):
    docs = corpus(random.Random(4), 300)
    df = spark.createDataFrame(docs, "id long, text string")
    for threshold, n in ((0.7, 3), (0.8, 5)):
        got = rows(neardup.all_pairs(df, "id", ["text"], threshold=threshold, n=n))
        assert len(got) == len(set(got)) and sorted(got) == brute(docs, threshold, n) and len(got) > 50


def test_deep_and_large_nodes(spark):
    """Small leaves and few levels force branching and the blocked comparison of nodes that stay large."""
    docs = corpus(random.Random(8), 200)
    df = spark.createDataFrame(docs, "id long, text string")
    for leaf, levels in ((3, 8), (3, 1), (2, 0)):
        assert sorted(rows(neardup.all_pairs(df, "id", ["text"], threshold=0.7, n=3, leaf=leaf, levels=levels))) == brute(docs, 0.7, 3)


def test_a_third_of_all_rows_is_one_text(spark):
    """Copies form one class of which one member enters the forest; their pairs come from the class."""
    docs = [(i, "same text of several words here") for i in range(1, 41)] + [(i, f"other text {i} of {i} words {i}") for i in range(41, 121)]
    df = spark.createDataFrame(docs, "id long, text string")
    assert len(rows(neardup.all_pairs(df, "id", ["text"], threshold=0.7, n=3))) == 40 * 39 // 2
    got = {r.id: (r.class_id, r.links) for r in neardup.classes(df, "id", ["text"], threshold=0.7, n=3).collect()}
    assert got[40] == (1, 0) and len(got) == 120


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, "a b c d", None, 1), (1, "a b c d", None, 1), (2, "A, b; c d", "", 1), (3, None, None, 1), (4, "a b", None, 1), (None, "a b c d", None, 1), (5, "z " * 50_000, "y", 1), (6, "z " * 50_000, "y", 2)], "id long, t string, u string, size int")
    assert rows(neardup.all_pairs(df, "id", ["t", "u"], threshold=0.7, n=3).distinct()) == [(1, 2), (5, 6)]
    assert neardup.all_pairs(df.where("false"), "id", ["t"], threshold=0.7, n=3).count() == 0


def test_trees():
    assert neardup.trees_for(0.7, 0.999, 2) == 9 and neardup.trees_for(0.9, 0.99, 2) < 4


def test_a_recall_out_of_reach_is_an_error():
    """No silent cap on trees: what can't be had is refused, and more branches widen what can."""
    import pytest

    assert neardup.trees_for(0.6, 0.999, 3) <= neardup.COORDINATES and neardup.trees_for(1.0, 0.999, 2) == 1
    for threshold in (0.5, 0.3, 0.2, 0.0):
        with pytest.raises(ValueError):
            neardup.trees_for(threshold, 0.999, 2)


def test_recall_at_the_lowest_threshold_that_is_accepted(spark):
    docs = corpus(random.Random(9), 250)
    df = spark.createDataFrame(docs, "id long, text string")
    got = rows(neardup.all_pairs(df, "id", ["text"], threshold=0.55, n=3, leaf=4, branch=3))
    want = brute(docs, 0.55, 3)
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) > 50
