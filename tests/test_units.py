"""Amounts: the grammar, the unit algebra, and the operator's defined cases."""

import pytest

from pyspark.sql import functions as F

from quarrycast.operators import units
from quarrycast.operators.units import Quantity, number, read_amount, read_pay, read_unit
from tests.conftest import rows


@pytest.mark.parametrize("text,value", [("1,234,567", 1234567), ("18,70,00,000", 187000000), ("2,5", 2.5), ("1.5", 1.5), ("17.400.000", 17400000), ("1,234.50", 1234.5), ("twenty-five", 25), ("twelve", 12), ("banana", None), ("12", 12)])
def test_numbers(text, value):
    assert number(text) == value


@pytest.mark.parametrize(
    "text,want",
    [("USD k p.a.", ("USD", "thousand", "year")), ("INR/mo", ("INR", None, "month")), ("TEUR", ("EUR", "thousand", None)), ("LPA", ("INR", "lakh", "year")), ("C$", ("CAD", None, None)), ("$", ("USD", None, None)), ("Rs. lacs", ("INR", "lakh", None)), ("pounds sterling '000", ("GBP", "thousand", None)), ("", (None, None, None)), (None, (None, None, None)), ("GBP hourly", ("GBP", None, "hour"))],
)
def test_unit_expressions(text, want):
    q = read_unit(text)
    assert (q.currency, q.scale, q.period) == want


def test_units_are_exponent_vectors(spark):
    """Products add exponents, powers multiply them, conversion asks for equal dimensions and knows offsets."""
    base = {"usd": ({"money": 1}, 1.0, 0.0), "inr": ({"money": 1}, 0.01, 0.0), "year": ({"time": 1}, 1.0, 0.0), "month": ({"time": 1}, 1 / 12, 0.0), "km": ({"length": 1}, 1000.0, 0.0), "hour": ({"time": 1}, 3600.0, 0.0), "celsius": ({"temperature": 1}, 1.0, 273.15), "fahrenheit": ({"temperature": 1}, 5 / 9, 459.67 * 5 / 9), "kelvin": ({"temperature": 1}, 1.0, 0.0)}
    table = F.map_from_arrays(F.array(*map(F.lit, base)), F.array(*[units.base_unit(*x) for x in base.values()]))
    cases = [
        (100.0, [("inr", 1), ("month", -1)], [("usd", 1), ("year", -1)], 12.0),
        (20.0, [("celsius", 1)], [("kelvin", 1)], 293.15),
        (293.15, [("kelvin", 1)], [("celsius", 1)], 20.0),
        (212.0, [("fahrenheit", 1)], [("celsius", 1)], 100.0),
        (36.0, [("km", 1), ("hour", -1)], [("km", 1), ("hour", -1)], 36.0),
        (9.0, [("km", 2)], [("km", 1), ("km", 1)], 9.0),
        (5.0, [("usd", 1)], [("usd", 1), ("year", -1)], None),  # another dimension
        (5.0, [("celsius", 1), ("usd", 1)], [("celsius", 1), ("usd", 1)], None),  # offsets make no products
        (5.0, [("celsius", 2)], [("celsius", 2)], None),
        (5.0, [("furlong", 1)], [("km", 1)], None),
        (5.0, None, [("km", 1)], None),
        (None, [("km", 1)], [("km", 1)], None),
    ]
    kind = "array<struct<code: string, exponent: int>>"
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, v double, a {kind}, b {kind}, want double")
    got = df.select("i", units.convert(F.col("v"), units.product(table, F.col("a")), units.product(table, F.col("b"))).alias("x"), "want").orderBy("i").collect()
    assert [r.x for r in got] == [r.want if r.want is None else pytest.approx(r.want) for r in got]
    with pytest.raises(ValueError):
        units.vector({"luck": 1})
    assert Quantity([1], "USD", None, "month").dims == (("money", 1), ("time", -1))


@pytest.mark.parametrize(
    "text,value,unit",
    [
        ("250.000 EUR", 250_000, ("EUR", None, None)),
        ("EUR 12.500", 12_500, ("EUR", None, None)),
        ("0.125 EUR", 0.125, ("EUR", None, None)),
        ("1.125 million USD", 1.125, ("USD", "million", None)),
        ("1,250 Mio. \u20ac", 1.25, ("EUR", "million", None)),
        ("1 250 000 EUR", 1_250_000, ("EUR", None, None)),
        ("CHF 1'250'000", 1_250_000, ("CHF", None, None)),
        ("1.2 lakh crore rupees", 1.2, ("INR", "lakh crore", None)),
        ("one hundred twenty million dollars", 120, ("USD", "million", None)),
        ("two and a half million dollars", 2.5, ("USD", "million", None)),
        ("half a million euros", 0.5, ("EUR", "million", None)),
        ("a million dollars", 1, ("USD", "million", None)),
        ("one million two hundred thousand euros", 1_200_000, ("EUR", None, None)),
        ("3 crore 50 lakh rupees", 35_000_000, ("INR", None, None)),
        ("two hundred and fifty thousand pounds", 250, ("GBP", "thousand", None)),
        ("12 JPY per day", 12, ("JPY", None, "day")),
        ("1.234,56 \u20ac", 1234.56, ("EUR", None, None)),
    ],
)
def test_composed_amounts(text, value, unit):
    ((_, _, q),) = units.amounts(text)
    assert (q.values, (q.currency, q.scale, q.period)) == ([value], unit)


@pytest.mark.parametrize("text,values,scale", [("900 thousand to 1.2 million USD", [900, 1200], "thousand"), ("90k\u2013120k", [90, 120], "thousand"), ("between 90 and 120 thousand dollars", [90, 120], "thousand"), ("from 5 to 7 EUR", [5, 7], None)])
def test_ranges(text, values, scale):
    ((_, _, q),) = units.amounts(text)
    assert (q.values, q.scale) == (values, scale)


def test_numbers_of_other_things_give_no_scale():
    q = read_amount("26", "EUR", "Weekly wrap: 26 startups raise funds, led by a \u20ac26 mn round")
    assert (q.values[0], q.currency, q.scale) == (26, "EUR", "million")


def test_dimension_decides(spark):
    """A yearly sum is no sum, and an amount without period no pay; products of scales and unknown currencies."""
    schema = "row_id long, field_name string, value double, currency string, scale string, period string"
    q = spark.createDataFrame([(1, "x", 2.0, "USD", "thousand", "month"), (2, "x", 2.0, "USD", "thousand", None), (3, "x", 2.0, "USD", "thousand thousand", None), (4, "x", 2.0, "CHF", "one", None), (5, "x", 2.0, None, "one", None)], schema)
    f = spark.createDataFrame(FACTORS, "kind string, unit_code string, factor double")
    assert rows(units.canonical(q, f), "row_id", "canonical") == [(1, 24000.0), (2, None), (3, None), (4, None), (5, None)]
    assert rows(units.canonical(q, f, units.SUM_DIMS), "row_id", "canonical") == [(1, None), (2, 2000.0), (3, 2e6), (4, None), (5, None)]


@pytest.mark.parametrize(
    "recorded,unit,text,want",
    [
        ([104, 139], None, "We ship. Salary range 104,000-139,000 EUR yearly. Bye.", ("EUR", "thousand", "year")),
        ([11000, 14300], None, "Pay between 11000 and 14300 EUR per month.", ("EUR", "one", "month")),
        ([12.3, 17.5], None, "CTC 12.3 to 17.5 LPA (INR).", ("INR", "lakh", "year")),
        ([112, None], "USD", "Salary numbers above are in thousands.", ("USD", "thousand", None)),
        ([510, 590], "AUD", "The pay range is a daily rate.", ("AUD", None, "day")),
        ([440, 630], "USD", "This contract is paid by the day, and the range reflects that.", ("USD", None, "day")),
        ([89, 133], "SGD", "Pay for this position is quoted on an hourly basis.", ("SGD", None, "hour")),
        ([2000, 3000], None, "Salary for all of the people who join us in the course of the coming year, which we fix together: 2000 to 3000 in euros, gross and before tax, monthly.", ("EUR", "one", "month")),
        ([90, 120], "GBP", "Benefits include a yearly learning budget of 15 hundred dollars.", ("GBP", None, None)),
        ([90, 120], None, "Our customers move 8 crore rupees a day through the product.", (None, None, None)),
        ([319, 232], None, "Annual salary: 232-319 thousand US dollars.", ("USD", "thousand", "year")),
        ([5, 6], None, None, (None, None, None)),
        ([5, 6], None, "", (None, None, None)),
    ],
)
def test_statements_on_pay(recorded, unit, text, want):
    q = read_pay(recorded, unit, text)
    assert (q.currency, q.scale, q.period) == want


@pytest.mark.parametrize(
    "raw,unit,text,want",
    [
        ("189", None, "X closes INR 189 crore round", (189, "INR", "crore")),
        ("3.8", "USD", "X nets $3.8 Mn in Series C", (3.8, "USD", "million")),
        ("USD40million", None, None, (40, "USD", "million")),
        ("2,5 Mio. €", None, None, (2.5, "EUR", "million")),
        ("71 करोड़ रुपये", None, None, (71, "INR", "crore")),
        ("twenty-five million dollars", None, None, (25, "USD", "million")),
        ("A$187,000,000", None, "A$187,000,000", (187e6, "AUD", "one")),
        ("5", None, "no money here", (5, None, None)),
    ],
)
def test_amounts(raw, unit, text, want):
    q = read_amount(raw, unit, text)
    assert (q.values[0], q.currency, q.scale) == want


@pytest.mark.parametrize("raw", ["undisclosed", "N/A", "", "an undisclosed sum"])
def test_no_amount(raw):
    assert read_amount(raw, "USD", "raises $5 m") is None


JOBS = "id long, pay_min double, pay_max double, pay_currency string, jd_text string, k string, v0 int"
FACTORS = [("currency", "USD", 1.0), ("currency", "INR", 0.01), ("period", "year", 1.0), ("period", "month", 12.0), ("scale", "one", 1.0), ("scale", "thousand", 1000.0), ("scale", "thousand", 1000.0)]


def test_operator_cases(spark):
    """Nulls in any column, repeated rows, long texts, clashing extra columns."""
    jobs = spark.createDataFrame([(1, 10.0, None, "USD k", None, "x", 1), (1, 10.0, None, "USD k", None, "x", 1), (2, None, None, None, None, None, None), (None, 5.0, 6.0, "USD", "", "x", 1), (3, 1.0, 2.0, None, "word " * 50_000 + "Pay between 1 and 2 USD per month.", "x", 1), (4, 7.0, None, "XYZ", "nothing", "x", 1)], JOBS)
    read = units.read_pays(jobs, "id", ["pay_min", "pay_max"], "pay_currency", "jd_text")
    out = units.canonical(read, spark.createDataFrame(FACTORS, "kind string, unit_code string, factor double"))
    assert rows(out, "row_id", "field_name", "canonical") == [(1, "pay_min", 10000.0), (1, "pay_min", 10000.0), (3, "pay_max", 24.0), (3, "pay_min", 12.0), (4, "pay_min", None), (None, "pay_max", 6.0), (None, "pay_min", 5.0)]


def test_empty_tables(spark):
    jobs = spark.createDataFrame([], JOBS)
    items = spark.createDataFrame([], "id long, amount_raw string, currency string, raw_text string")
    none = spark.createDataFrame([], "kind string, unit_code string, factor double")
    both = units.read_pays(jobs, "id", ["pay_min", "pay_max"], "pay_currency", "jd_text").unionByName(units.read_amounts(items, "id", "amount_raw", "currency", "raw_text"))
    assert units.canonical(both, none).count() == 0


@pytest.mark.parametrize(
    "recorded,unit,text,want",
    [
        ([6900, 9550], "GBP", "We ship. Gehalt: Angabe brutto pro Monat. Bye.", ("GBP", None, "month")),
        ([55.5, 77], "CAD", "- R\u00e9mun\u00e9ration indiqu\u00e9e \u00e0 l'heure.", ("CAD", None, "hour")),
        ([55.5, 77], "CAD", "Re\u0301mune\u0301ration indique\u0301e a\u0300 l\u2019heure.", ("CAD", None, "hour")),
        ([40, 60], "EUR", "Die Verg\u00fctung wird st\u00fcndlich angegeben.", ("EUR", None, "hour")),
        ([61000, 70000], None, "Gehalt: 61000 bis 70000 Euro im Jahr.", ("EUR", "one", "year")),
        ([500, None], None, "Tagessatz: 500 EUR.", ("EUR", "one", "day")),
        ([2400, 3100], None, "Salaire brut : 2400 \u00e0 3100 \u20ac par mois.", ("EUR", "one", "month")),
        ([48, None], "EUR k", "Le salaire est annuel.", ("EUR", "thousand", "year")),
        ([40, 60], "EUR", "Der Kurs wird monatlich abgehalten.", ("EUR", None, None)),
    ],
)
def test_statements_in_german_and_french(recorded, unit, text, want):
    q = read_pay(recorded, unit, text)
    assert (q.currency, q.scale, q.period) == want


def test_accents_in_unit_fields():
    assert read_unit("EUR j\u00e4hrlich").period == "year"
    assert read_unit("71 करोड़ रुपये").scale == "crore"
