"""Stateful rules against loops, and idempotence."""

import random

import pytest
from pyspark.sql import functions as F

from quarrycast.operators import health, listing, state
from quarrycast.streaming import ingest
from tests.conftest import rows


def test_link_new_is_the_row_by_row_rule(spark):
    rng = random.Random(3)
    old = [(i, f"k{rng.randint(0, 6)}", rng.choice(["a", "b", None])) for i in range(1, 25)]
    new = [(i, rng.choice([f"k{rng.randint(0, 9)}", "||"]), rng.choice(["a", "b", "c", None])) for i in range(30, 60)]
    want, seen = {}, [(i, k, s or "") for i, k, s in old]
    for i, k, s in new:
        hit = [x for x, kk, ss in sorted(seen) if kk == k != "||" and ss != (s or "")]
        # rows that got a link are no longer candidates
        want[i] = hit[0] if hit else None
        if not hit:
            seen.append((i, k, s or ""))
    schema = "id long, dedupe_key string, source string"
    got = state.link_new(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema))
    assert {r.id: r.canonical_id for r in got.collect() if r.dedupe_key in {k for _, k, _ in old} or r.dedupe_key == "||"} == {i: want[i] for i, k, _ in new if k in {k for _, k, _ in old} or k == "||"}


BATCH = "source string, external_id string, title string, jd_text string, url string"
ARRIVING = BATCH + ", loaded_at int"


def test_upsert(spark):
    batch = spark.createDataFrame([("g", "1", "Z", "early", "u0", 1), ("g", "1", "A", "text", "u1", 2), ("g", "1", "A", "text", "u1", 2), ("g", "1", "Y", "unknown", "u7", None), ("g", "2", "B", None, "", 1), ("g", None, "C", "t", "u3", 1)], ARRIVING)
    empty = spark.createDataFrame([], BATCH + ", seen_at string, first_seen_at string, source_urls array<string>")
    one = state.upsert(empty, batch, ["source", "external_id"], "t1", ["jd_text"], ["loaded_at"])
    assert rows(one.groupBy("outcome").count()) == [("new", 3)]
    keyed = one.where("external_id is not null").drop("outcome")
    again = spark.createDataFrame([("g", "1", "A2", "", "u9", 1)], ARRIVING)
    two = state.upsert(keyed, again, ["source", "external_id"], "t2", ["jd_text"], ["loaded_at"])
    r = two.where("external_id = '1'").first()
    assert (r.title, r.jd_text, r.seen_at, r.first_seen_at, r.source_urls, r.outcome) == ("A2", "text", "t2", "t1", ["u1", "u9"], "updated")
    assert rows(state.upsert(two.drop("outcome"), again, ["source", "external_id"], "t2", ["jd_text"], ["loaded_at"]), "external_id", "title") == rows(two, "external_id", "title")


def test_insert_or_ignore(spark):
    batch = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), (None, 7)], "url string, item_id long")
    old = spark.createDataFrame([("b", 1)], "url string, item_id long")
    assert rows(state.insert_or_ignore(batch, old, ["url"], "item_id")) == [("a", 1)]
    assert state.insert_or_ignore(batch.where("false"), old, ["url"], "item_id").count() == 0


def test_latest_poll_counts(spark):
    """A later success beats an earlier failure and the other way round; ties go to the greater status."""
    c = spark.createDataFrame([(i, "never", "old", None) for i in range(1, 5)], "id long, last_polled_at string, poll_etag string, poll_last_modified string")
    o = spark.createDataFrame([(1, 1, 500, None, None), (1, 2, 200, "new", "m"), (2, 1, 200, "new", "m"), (2, 2, 500, None, None), (3, 2, 304, "x", None), (None, 1, 200, "n", None)], "company_id long, at int, status int, etag string, last_modified string")
    assert rows(state.mark_polled(c, o, "now"), "id", "last_polled_at", "poll_etag", "poll_last_modified") == [(1, "now", "new", "m"), (2, "now", "old", None), (3, "now", "old", None), (4, "never", "old", None)]


def test_backfill(spark):
    """The first item of the name fills an empty domain, unless its domain is another company's; nothing else changes."""
    c = spark.createDataFrame([(1, "Acme", None), (2, "Bolt", "bolt.example"), (3, None, None), (4, "Cork", None)], "id long, name string, domain string")
    items = spark.createDataFrame([(5, " acme.example", "ACME"), (4, "", "Acme"), (3, None, "Acme"), (6, "other.example", "acme"), (7, "BOLT.example ", "Cork"), (8, "new.example", "Bolt"), (9, "x.example", None)], "id long, site string, company string")
    assert rows(state.backfill(c, items, "site", "company", "id")) == [(1, "Acme", "acme.example"), (2, "Bolt", "bolt.example"), (3, None, None), (4, "Cork", None)]
    assert rows(state.backfill(c, items.where("false"), "site", "company", "id")) == rows(c)


def test_apply_funding(spark):
    c = spark.createDataFrame([(1, "old", "Seed"), (2, "kept", "A"), (3, None, None)], "id long, recently_funded_at string, funding_stage string")
    raises = spark.createDataFrame([(1, 1, "2026-01-01", "Seed", "$1m"), (1, 2, "2026-03-01T10:00:00Z", "", None), (3, 1, "soon", "B", "$2m"), (None, 9, "2026-01-01", "X", "y")], "company_id long, order long, announced_at string, round_stage string, amount_raw string")
    assert rows(state.apply_funding(c, raises, 60)) == [(1, "2026-03-01T10:00:00Z", None, None, "2026-04-30"), (2, "kept", "A", None, None), (3, "soon", "B", "$2m", None)]


def test_versions(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    where = str(tmp_path / "t")
    assert state.read_current(spark, where) is None and state.current_version(spark, where) == 0
    assert [state.publish(df, where), state.publish(df.union(df), where)] == [1, 2]
    assert state.read_current(spark, where).count() == 2
    assert state.append(df, where, "more") == 3 and state.read_current(spark, where).count() == 3
    assert state.append(df, where, "more") == 3 and state.read_current(spark, where).count() == 3


@pytest.mark.parametrize("step", ["write", "create", "rename"])
def test_a_lost_commit_leaves_the_last_version(spark, tmp_path, monkeypatch, step):
    """A run that dies while it writes the part, before the manifest, or before its rename changes nothing, and the next succeeds."""
    where, df = str(tmp_path / "t"), spark.createDataFrame([(1,)], "x int")
    state.publish(df, where)
    commit, fs = state._commit, state._fs

    def die(*_):
        raise KeyboardInterrupt

    if step == "rename":

        class Dying:
            def __init__(self, real):
                self.real = real

            def __getattr__(self, name):
                return die if name == "rename" else getattr(self.real, name)

        monkeypatch.setattr(state, "_fs", lambda s, p: (fs(s, p)[0], Dying(fs(s, p)[1])))
    elif step == "create":
        monkeypatch.setattr(state, "_commit", die)
    for lost in (lambda: state.publish(df.union(df), where), lambda: state.append(df, where, "p")):
        if step == "write":
            (tmp_path / "t" / "parts" / "p").mkdir(exist_ok=True)  # what a lost job leaves of a part
        else:
            with pytest.raises(KeyboardInterrupt):
                lost()
    monkeypatch.setattr(state, "_commit", commit)
    monkeypatch.setattr(state, "_fs", fs)
    assert state.current_version(spark, where) == 1 and state.read_current(spark, where).count() == 1
    assert state.append(df, where, "p") == 2 and state.read_current(spark, where).count() == 2


def test_a_version_is_published_once(spark, tmp_path):
    where, df = str(tmp_path / "t"), spark.createDataFrame([(1,)], "x int")
    state.publish(df, where)
    with pytest.raises(RuntimeError):
        state._commit(spark, where, 1, ["other"])
    assert state.read_current(spark, where).count() == 1


def test_vacuum(spark, tmp_path):
    where, df = str(tmp_path / "t"), spark.createDataFrame([(1,)], "x int")
    state.publish(df, where)
    state.publish(df, where)
    state.append(df, where, "p")
    assert len(state.vacuum(spark, where, keep=1)) == 1
    assert state.vacuum(spark, where, keep=1) == [] and state.read_current(spark, where).count() == 2 and state.append(df, where, "p") == 3


def test_insert_stream_appends_and_replays(spark, tmp_path):
    """Batches add only new keys, write no stored row again, and a batch that runs twice adds nothing."""
    source, where = tmp_path / "in", str(tmp_path / "t")
    batches = [[("a", 2), ("a", 1), ("b", 5)], [("b", 1), ("c", 9), (None, 3)], [("c", 1)]]
    run = lambda: ingest.insert_new(ingest.read_table(spark, str(source), files_per_trigger=1), where, ["url"], "item_id", str(tmp_path / "checkpoint")).awaitTermination()
    size = []
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, "url string, item_id long").coalesce(1).write.mode("append").parquet(str(source))
        before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
        run()
        assert all(p.stat().st_mtime_ns == t for p, t in before.items()), "a stored file was written again"
        size.append(rows(state.read_current(spark, where), "url", "item_id"))
    assert size == [[("a", 1), ("b", 5)], [("a", 1), ("b", 5), ("c", 9)], [("a", 1), ("b", 5), ("c", 9)]]
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # the last batch was published, but its end was never recorded
    (last.parent / f".{last.name}.crc").unlink()
    version = state.current_version(spark, where)
    run()
    assert state.current_version(spark, where) == version and rows(state.read_current(spark, where), "url", "item_id") == size[-1]


def test_rank_is_row_number(spark):
    df = spark.createDataFrame([(i, i * 7919 % 101) for i in range(500)], "id long, v long")
    got = {r.id: r["rank"] for r in listing.rank(df, [F.col("v").desc(), F.col("id")]).collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((-(i * 7919 % 101), i) for i in range(500)), 1)}
    assert got == want


def _reason(polls):
    fails = 0
    for ok, *_ in polls:
        if ok:
            break
        fails += 1
    if fails >= 3:
        return "failing"
    empties = 0
    for ok, status, items in polls:
        if not ok:
            return None
        if status == 304:
            continue
        if items == 0:
            empties += 1
            continue
        return "empty" if empties >= 3 else None
    return None


def test_diagnosis_against_a_loop(spark):
    from quarrycast.streaming.ingest import diagnose

    rng = random.Random(11)
    data, want, history = [], {}, {}
    for t in range(150):
        polls = []
        for i in range(rng.randint(1, 12)):
            kind = rng.choice("fueepn" if t % 2 else "ffueeep")
            polls.append({"f": (False, 500, None), "u": (True, 304, None), "e": (True, 200, 0), "p": (True, 200, 4), "n": (True, 200, None)}[kind])
            data.append((t, i, *polls[-1]))
            history[t, i] = _reason(polls[::-1])
        want[t] = _reason(polls[::-1])
        letters = "".join("f" if not o else "u" if s == 304 else "e" if n == 0 else "p" for o, s, n in polls[::-1])
        assert diagnose(letters) == want[t]
    df = spark.createDataFrame(data, "target int, id int, ok boolean, status int, item_count int")
    assert {r.target: r.reason for r in health.diagnose(df, ["target"], "id").collect()} == want
    assert {(r.target, r.id): r.reason for r in health.poll_reasons(df, ["target"], "id").collect()} == history


def test_a_target_with_most_polls(spark):
    """One target has nine tenths of the polls: its history is spread over ranges, and is that of a loop."""
    from quarrycast.streaming.ingest import diagnose

    rng = random.Random(5)
    data, want, trail, open_ = [], [], {}, {}
    for i in range(3_000):
        t = None if rng.random() < 0.02 else 0 if rng.random() < 0.9 else rng.randint(1, 4)
        k = rng.choice("f" * 3 + "u" * 2 + "ep") if i // 40 % 2 else rng.choice("eeeeeup")
        data.append((t, i, k != "f", {"f": 500, "u": 304}.get(k, 200), {"e": 0, "p": 4}.get(k)))
        trail[t] = (k + trail.get(t, ""))[:30]
        reason = diagnose(trail[t])
        if reason and t not in open_:
            open_[t] = len(want)
            want.append((t, i, reason, None))
        elif not reason and t in open_:
            n = open_.pop(t)
            want[n] = (*want[n][:3], i)
    df = spark.createDataFrame(data, "target int, id int, ok boolean, status int, item_count int")
    got = {tuple(r) for r in health.alerts(df, ["target"], "id").select("target", "raised_at", "reason", "resolved_at").collect()}
    assert got == set(want) and len(want) > 30
    ranges = health._ranges(df, ["target"], "id").where("target = 0").groupBy("q__range").count().collect()
    assert len(ranges) >= 8 and max(r["count"] for r in ranges) < 800


def test_alerts(spark):
    data = [("t", i, k != "f", 500 if k == "f" else 200, None if k == "f" else 3) for i, k in enumerate("pfffffppffff")]
    df = spark.createDataFrame(data, "target string, id int, ok boolean, status int, item_count int")
    assert rows(health.alerts(df, ["target"], "id"), "raised_at", "reason", "resolved_at") == [(10, "failing", None), (3, "failing", 6)]


def test_filters(spark):
    companies = spark.createDataFrame([(1, "Grafana Labs"), (2, "Gopuff")], "id long, name string")
    cols = "id long, company_id long, title string, location string, url string, source string, comp_model string, pay_min double, pay_max double, pay_currency string, auth_required int, hires_in_india int, remote int, first_seen_at string, seen_at string, canonical_id long"
    row = lambda i, c, t, auth=0, india=0, remote=0, first="2026-08-01", canon=None: (i, c, t, None, f"u{i}", "s", "unknown", None, None, None, auth, india, remote, first, "2026-07-01", canon)
    jobs = spark.createDataFrame([row(1, 1, "Engineer", 0, 1, 1), row(2, 1, "Engineer II"), row(4, 2, "Engineer", 1), row(5, 1, "Engineer", canon=1), row(6, 1, "Designer", None, None, None, None)], cols)
    ids = lambda **f: [r.id for r in listing.JobFilter(**f).ranked(jobs, companies).collect()]
    assert ids() == [1, 2, 6, 4] and ids(limit=2) == [1, 2] and ids(include_duplicates=True) == [1, 5, 2, 6, 4]
    assert ids(company="GRAFANA") == [1, 2, 6] and ids(title="eng_neer") == [1, 2, 4] and ids(india_only=True) == [1] and ids(remote_only=True) == [1]
    assert listing.JobFilter(limit=1).count(jobs, companies).first().n == 4
