"""The matching cascade on companies of our own, with held-out labels."""

import random

from pyspark.sql import functions as F

from quarrycast.llm import matching
from tests.conftest import rows

COMPANY = "id long, name string, domain string, notes string, rule string"
ITEM = "id long, company_name string, headline string, resolved_domain string, company string"
REST = ["Labs", "Foods", "Cloud", "Energy"]


def world(rng):
    names = []
    while len(names) < 120:
        base = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5)).title()
        names.append(f"{base} {rng.choice(REST)}")
    names = list(dict.fromkeys(names))
    sectors, cities = ["payroll", "cold storage", "telehealth"], ["Pune", "Berlin", "Austin"]
    companies = [(i, n, n.lower().replace(" ", "") + ".example", f"{rng.choice(sectors)}; HQ {rng.choice(cities)}", "") for i, n in enumerate(names, 1)]
    return companies


def test_matching(spark):
    rng = random.Random(6)
    companies = world(rng)
    items, want = [], {}
    for k in range(600):
        cid, name, site, notes, _ = rng.choice(companies)
        sector, city = notes.split("; HQ ")
        base, rest = name.split()
        form = rng.choice(["plain", "turned", "upper", "legal", "glued", "initial", "base", "typo", "accent", "site", "stranger", "twin"])
        given = {"plain": name, "turned": f"{rest} {base}", "upper": name.upper(), "legal": f"{name} Pvt. Ltd", "glued": base + rest, "initial": f"{base} {rest[0]}.", "base": base, "typo": base[:3] + base[4:] + " " + rest, "accent": name.replace("a", "à"), "site": site, "stranger": "Xyzzy Quuxly", "twin": name}[form]
        if form == "twin":
            sector, city = ("mining", "Oslo")
        items.append((k, given, f"{city}-based {sector} startup {given} raises $1 Mn", site if k % 5 == 0 and form not in ("stranger", "twin") else None, "z"))
        want[k] = None if form in ("stranger", "twin") else cid
    out = matching.match(spark.createDataFrame(items, ITEM), spark.createDataFrame(companies, COMPANY))
    got = {r.id: (r.company_id, r.confidence) for r in out.collect()}
    right = sum(got.get(k, (None,))[0] == w for k, w in want.items())
    assert right / len(want) > 0.97
    assert not any(k in got for k, w in want.items() if w is None)
    assert all(0 < c < 1 for _, c in got.values()) and len(got) == out.count()


def test_defined_cases(spark):
    """Nulls in any column, repeated rows, ties, long names, empty tables."""
    companies = spark.createDataFrame([(1, "Acme Labs", "acme.example", None, "a"), (1, "Acme Labs", "acme.example", None, "a"), (2, "Twin", None, None, None), (3, "Twin", None, "payroll; HQ Pune", None), (None, "Nobody", "n.example", None, None), (4, None, "four.example", "x", None)], COMPANY)
    items = spark.createDataFrame([(1, "ACME Labs, Inc", None, None, "c"), (1, "ACME Labs, Inc", None, None, "c"), (2, "Twin", None, None, None), (3, "Twin", "Pune-based payroll firm Twin raises", None, None), (4, None, "h", "acme.example", None), (5, "x", "h", "HTTPS://www.Four.example/a?b", None), (6, "", "", "", ""), (7, "n" * 100_000, "h", None, None), (None, "Acme Labs", None, None, None)], ITEM)
    assert rows(matching.match(items, companies), "id", "company_id") == [(1, 1), (3, 3), (5, 4)]
    assert matching.match(items.where("false"), companies).count() == 0
    assert matching.match(items, companies.where("false")).count() == 0


def test_names():
    g = frozenset({"labs", "foods"})
    assert matching.parse_name("[Update] Pune-based cold storage startup Zuvro Labs™ (YC)", g)[:3] == ("zuvro", "labs", "zuvrolabs")
    assert matching.parse_name("Foods Zuvró Pvt Ltd", g)[:3] == ("zuvro", "foods", "zuvrofoods")
    assert matching.parse_name("Zuvro Ri F.", g)[3:5] == ("zuvrori", "f")
    assert matching.parse_name("getzuvro.example", g)[0] == "zuvro"
    assert matching.parse_name(" ", g) == (None,) * 6


def test_tests_come_before_uniqueness(spark):
    """A company that an edit too many or a contradiction rules out stands in nobody's way."""
    companies = spark.createDataFrame([(1, "Kavoru", None, None, None), (2, "Zkavoru", None, None, None), (3, "Twin", None, "HQ Pune", None), (4, "Twin", None, "mining; HQ Oslo", None), (5, "Twice", None, "mining; HQ Oslo", None), (6, "Twice", None, "HQ Pune", None)], COMPANY)
    items = spark.createDataFrame([(1, "Kavoruq", None, None, None), (2, "Twin", "fintech startup Twin raises $1 Mn", None, None), (3, "Twin", "Twin raises", None, None), (4, "Twice", "Pune-based mining startup Twice raises", None, None)], ITEM)
    out = matching.match(items, companies)
    assert rows(out, "id", "company_id") == [(1, 1), (2, 3), (4, 6)]
    assert {r.confidence for r in out.collect()} == {0.5}, "no label says anything of these rules"


def _apart(a, b):
    """One letter put in, left out, replaced or two neighbours exchanged, by brute force."""
    if a == b:
        return True
    letters = set(a + b)
    near = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + x + a[i + k :] for i in range(len(a) + 1) for x in letters for k in (0, 1)} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    return b in near


def test_one_edit_in_names_of_any_length(spark):
    """Pairs that share a key and pass the test are those one edit apart, around the length where keys change too."""
    rng = random.Random(2)
    data, want = [], {}
    for k, n in enumerate([6, 7, 12, 40, 79, 80, 81, 82, 83, 150] * 8):
        a = "".join(rng.choice("abc") for _ in range(n))
        i = rng.randrange(n - 1)
        b = rng.choice([a, a[:i] + a[i + 1 :], a[:i] + "x" + a[i:], a[:i] + "x" + a[i + 1 :], a[:i] + a[i + 1] + a[i] + a[i + 2 :], a[: i // 2] + "x" + a[i // 2 : i] + "y" + a[i:], a[::-1]])
        data.append((k, a, b))
        want[k] = len(a) >= 6 and len(b) >= 6 and _apart(a, b)
    df = spark.createDataFrame(data, "k int, a string, b string")
    met = F.coalesce(F.arrays_overlap(matching._variants(F.col("a")), matching._variants(F.col("b"))), F.lit(False))
    got = {r.k: r.met and r.near for r in df.select("k", met.alias("met"), matching._one_edit(F.col("a"), F.col("b")).alias("near")).collect()}
    assert got == want and 20 < sum(want.values()) < 70


def test_plan_is_short(spark, data):
    """The cascade is a few joins, whatever the number of its rules."""
    from quarrycast.llm import queries

    plan = queries.p3_found(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 15


def test_nothing_that_grows_is_broadcast(spark):
    """Keys of companies and items never pass through the driver, whatever size Spark takes them for."""
    companies = world(random.Random(6))
    items = [(k, [name, name[:3] + name[4:], name.split()[0]][k % 3], None, site if k % 2 else None, None) for k, name, site, *_ in companies]
    companies = spark.createDataFrame([*companies, (1000, companies[0][1], None, None, None)], COMPANY)
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {(e := runs.apply(k)).executionId(): e.physicalPlanDescription() for runs in [store.executionsList()] for k in range(runs.size())}
    before, held = ids(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        assert len(matching.match(spark.createDataFrame(items, ITEM), companies).collect()) > 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    trees = [p.split("\n\n")[0].split("== Initial Plan ==")[0] for k, p in ids().items() if k not in before]
    assert sum(t.count("BroadcastExchange") for t in trees) == 2, "the confidence of each kind and rule"
