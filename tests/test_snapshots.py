"""Changes between deliveries against a loop over small histories, and the defined cases."""

import random

import pytest

from quarrycast.operators import snapshots
from tests.conftest import rows

SCHEMA = "snapshot_no int, source string, board string, poll_ok int, external_id string, title string, jd_text string, n int"


def changes(df):
    return snapshots.changes(df, "snapshot_no", ["source", "board"], "external_id", ["title", "jd_text"], ["jd_text"], "poll_ok", "n")


def run(spark, data):
    return rows(changes(spark.createDataFrame(data, SCHEMA)), "source", "external_id", "snapshot_no", "change_kind")


def loop(data):
    """The same, board by board and delivery by delivery."""
    out = set()
    numbers = sorted({r[0] for r in data})
    for source, board in {(r[1], r[2]) for r in data}:
        own = [r for r in data if (r[1], r[2]) == (source, board)]
        before, texts = None, {}
        for n in numbers:
            if any(r[0] == n and r[3] == 0 for r in own):
                continue
            now = {}
            for r in own:
                if r[0] == n and r[3] != 0 and r[4] and r[4].strip():
                    key = r[4].strip()
                    bare = lambda t: "".join((t or "").split())
                    if bare(r[6]):
                        texts[key] = bare(r[6])
                    now[key] = (bare(r[5]), texts.get(key))
            if before is not None:
                out |= {(source, k, n, "added") for k in now.keys() - before.keys()} | {(source, k, n, "removed") for k in before.keys() - now.keys()}
                out |= {(source, k, n, "changed") for k in now.keys() & before.keys() if now[k] != before[k]}
            before = now
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_against_a_loop(spark):
    rng = random.Random(5)
    data = []
    for board in "abcde":
        for key in "pqrst":
            text = "t0"
            for n in range(1, 6):
                text = rng.choice([text, text, f"t{n}", " ".join(text) + " "])
                if rng.random() < 0.7:
                    data.append((n, "s", board, 1, f" {key}{board}\t", "T", rng.choice([text, text, None, " \n"]) if n > 1 else text, 0))
        if rng.random() < 0.7:
            n = rng.randint(2, 5)
            data = [r for r in data if (r[0], r[2]) != (n, board)] + [(n, "s", board, 0, None, None, None, 0)]
    assert run(spark, data) == loop(data) and len(loop(data)) > 20


def test_no_change(spark):
    """White space of any kind, Unicode composition, repeated rows, lost texts."""
    a = (1, "s", "b", 1, "x", "Café Lead", "One  two\r\nthree", 0)
    b = (2, "s", "b", 1, " x ", "Café  Lead ", "One two three​", 0)
    c = (3, "s", "b", 1, "x", "Café Lead", None, 0)
    assert run(spark, [a, b, b, c]) == []
    for space in "\t\r\x0b\x0c\x85\xa0\u2003\u2028\u2029\u202f\u3000\u200b\ufeff":
        assert run(spark, [(1, "s", "b", 1, "x", "Lead", "One two", 0), (2, "s", "b", 1, "x", f"Lead{space}", f"{space}One{space} two{space}", 0)]) == [], space
    assert run(spark, [a, (2, "s", "b", 1, "x", "café Lead", "One two three", 0)]) == [("s", "x", 2, "changed")]


def test_defined_cases(spark):
    """Null keys and numbers, null groups, failed polls, an empty delivery, long texts."""
    data = [(1, None, None, 1, "x", None, None, 0), (2, None, None, 1, "x", "t", None, 0), (None, "s", "b", 1, "y", "t", "t", 0), (1, "s", "b", 1, None, "t", "t", 0), (1, "s", "b", 1, "  ", "t", "t", 0), (1, "s", "b", 1, "z", "t", "w " * 200_000, 0), (2, "s", "b", 0, None, None, None, 0), (3, "s", "c", 1, "q", "t", "t", 0)]
    assert run(spark, data) == [("s", "q", 3, "added"), ("s", "z", 3, "removed"), (None, "x", 2, "changed"), (None, "x", 3, "removed")]


def test_empty(spark):
    assert run(spark, []) == []


def test_the_last_of_differing_repeats_counts(spark):
    """Whatever their hashes; a blank text that arrives last hides no text, a title that arrives last does."""
    for old, new in (("a", "b"), ("b", "a")):
        first = (1, "s", "b", 1, "x", new, new, 1)
        repeats = [(2, "s", "b", 1, "x", old, old, 1), (2, "s", "b", 1, "x", new, new, 2), (2, "s", "b", 1, "x", new, " ", 3), (2, "s", "b", 1, "x", old, old, None)]
        assert run(spark, [first, *repeats]) == []
        assert run(spark, [first, *repeats, (2, "s", "b", 1, "x", old, None, 4)]) == [("s", "x", 2, "changed")]


def test_hundreds_of_deliveries(spark):
    """The plan doesn't grow with the deliveries, and a posting that comes and goes is followed through all of them."""
    data = [(n, "s", "b", 1, k, f"T{n // 100}", "t", 0) for n in range(1, 401) for k in ("x", "y") if k == "x" or n % 7]
    few, many = spark.createDataFrame(data[:6], SCHEMA), spark.createDataFrame(data, SCHEMA)
    plans = [changes(df)._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0] for df in (few, many)]
    assert len(plans[0]) == pytest.approx(len(plans[1]), rel=0.05)
    assert run(spark, data) == loop(data) and len(data) > 700
