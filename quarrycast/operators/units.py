"""Amounts recorded in mixed units, converted to canonical ones.

A grammar reads numbers (grouped digits, decimals, number words, sums and products of terms such as "one million
two hundred thousand" or "1.2 lakh crore"), ranges, currencies, scales and periods from fields and free text, over
Arrow batches. Each amount comes with a unit: a product of base units with exponents. A base unit has a dimension,
the vector of exponents of DIMENSIONS, a scale and an offset to the canonical unit of that dimension. Products and
conversions are computed in the JVM from a table of base units, and only amounts whose dimension is the one asked
for are converted.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrycast.runtime import ship

# --- fixed values: how currencies, scales and periods are written -------------------------------------------
CURRENCIES = {
    "USD": ["usd", "us$", "$", "us dollars", "us dollar", "dollars", "dollar"],
    "INR": ["inr", "₹", "rs", "rs.", "indian rupees", "rupees", "rupee", "रुपये", "lpa"],
    "EUR": ["eur", "€", "euro", "euros", "teur"],
    "GBP": ["gbp", "£", "pounds sterling", "pound sterling", "pounds"],
    "SGD": ["sgd", "s$", "singapore dollars", "singapore dollar"],
    "CAD": ["cad", "c$", "ca$", "canadian dollars", "canadian dollar"],
    "AUD": ["aud", "a$", "au$", "australian dollars", "australian dollar"],
    "CHF": ["chf", "sfr", "sfr.", "swiss francs", "swiss franc"],
    "JPY": ["jpy", "¥", "yen"],
    "CNY": ["cny", "rmb", "yuan"],
    "HKD": ["hkd", "hk$", "hong kong dollars"],
    "NZD": ["nzd", "nz$", "new zealand dollars"],
    "BRL": ["brl", "r$", "reais"],
    "SEK": ["sek", "swedish kronor"],
    "NOK": ["nok", "norwegian kroner"],
    "DKK": ["dkk", "danish kroner"],
    "PLN": ["pln", "zł", "zloty", "zlotys"],
    "KRW": ["krw", "₩"],
    "ILS": ["ils", "₪", "shekels"],
    "ZAR": ["zar"],
    "AED": ["aed", "dirhams"],
}
SCALES = {
    "thousand": ["k", "thousand", "thousands", "'000", "’000", "teur", "tsd", "tsd.", "tausend"],
    "lakh": ["l", "lakh", "lakhs", "lac", "lacs", "lpa", "लाख"],
    "million": ["m", "mn", "million", "millions", "mio", "mio.", "millionen"],
    "crore": ["cr", "crore", "crores", "करोड़"],
    "billion": ["b", "bn", "billion", "billions", "mrd", "mrd."],
}
#: Nouns of periods, which follow one of EACH, and forms that stand alone. Without accents, as fold() leaves them.
EACH = ["per", "a", "an", "each", "every", "by the", "/", "pro", "im", "je", "am", "die", "par", "au", "a la", "a l'", "de l'", "l'"]
NOUNS = {
    "year": ["year", "yr", "y", "annum", "jahr", "an", "annee"],
    "month": ["month", "mo", "monat", "mois"],
    "week": ["week", "wk", "woche", "semaine"],
    "day": ["day", "d", "diem", "tag", "jour", "journee"],
    "hour": ["hour", "hr", "h", "stunde", "std", "heure"],
}
PERIODS = {
    "year": ["p.a.", "p.a", "annual", "annually", "yearly", "lpa", "ctc", "jahrlich", "jahresgehalt", "bruttojahresgehalt", "annuel", "annuelle", "annuels", "annuelles", "annuellement"],
    "month": ["p.m.", "p.m", "monthly", "monatlich", "monatsgehalt", "bruttomonatsgehalt", "monatslohn", "mensuel", "mensuelle", "mensuels", "mensuelles", "mensuellement"],
    "week": ["p.w.", "p.w", "weekly", "wochentlich", "wochenlohn", "hebdomadaire", "hebdomadaires"],
    "day": ["p.d.", "p.d", "daily", "day rate", "taglich", "tagessatz", "tageslohn", "journalier", "journaliere", "journaliers"],
    "hour": ["p.h.", "p.h", "hourly", "stundlich", "stundenlohn", "stundensatz", "horaire", "horaires"],
}
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
#: Words between the numbers of a range.
BETWEEN = ["-", "–", "—", "to", "and", "bis", "und", "a", "à", "et"]
#: Words that make a sentence one on pay, in the same languages.
PAY = r"\b(?:pay|paid|salary|salaries|compensation|ctc|remuneration|wages?|stipend|package|(?:hourly|day|daily|weekly) rate|we offer"
PAY += r"|(?:(?:brutto|netto|grund|jahres|monats|wochen|tages|stunden)*(?:gehalt|lohn)|gehalter|gehalts\w*|lohne|vergutung|stundensatz|tagessatz|salaires?|paie|taux (?:horaire|journalier)|tarif journalier))\b"
# -------------------------------------------------------------------------------------------------------------
SCALE_FACTORS = {"one": 1.0, "thousand": 1e3, "lakh": 1e5, "million": 1e6, "crore": 1e7, "billion": 1e9}

# --- base units and their algebra, as columns ------------------------------------------------------------------
DIMENSIONS = ("money", "time", "length", "mass", "temperature")
Dims = dict[str, int]
PAY_DIMS: Dims = {"money": 1, "time": -1}
SUM_DIMS: Dims = {"money": 1}


def vector(dims: Dims) -> Column:
    """The exponents of DIMENSIONS as array<int>."""
    if unknown := dims.keys() - set(DIMENSIONS):
        raise ValueError(f"no such dimension: {', '.join(sorted(unknown))}")
    return F.array(*[F.lit(dims.get(d, 0)) for d in DIMENSIONS])


def base_unit(dims: Dims, scale: Column | float, offset: Column | float = 0.0) -> Column:
    """struct<dims, scale, offset> of a unit: a value v of it is v * scale + offset canonical ones."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(vector(dims).alias("dims"), as_column(scale).cast("double").alias("scale"), as_column(offset).cast("double").alias("offset"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, whose expression appears once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def product(units: Column, terms: Column) -> Column:
    """The unit that terms, array<struct<code, exponent>>, multiply to; units maps codes to base units.

    Null where a code is unknown, and where a unit with an offset is multiplied or raised to a power.
    """
    none = F.struct(vector({}).alias("dims"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"))

    def times(acc: Column, x: Column) -> Column:
        dims = F.zip_with(acc["dims"], x["unit"]["dims"], lambda a, b: a + b * x["exponent"])
        return F.struct(dims.alias("dims"), (acc["scale"] * F.pow(x["unit"]["scale"], x["exponent"])).alias("scale"), (acc["offset"] + x["unit"]["offset"]).alias("offset"))

    def multiplied(known: Column) -> Column:
        whole = F.forall(known, lambda x: x["unit"].isNotNull())
        alone = (F.size(known) == 1) & F.forall(known, lambda x: x["exponent"] == 1)
        plain = F.forall(known, lambda x: x["unit"]["offset"] == 0)
        return F.when(whole & (alone | plain), F.aggregate(known, none, times))

    of = lambda units: F.transform(terms, lambda t: F.struct(units[t["code"]].alias("unit"), t["exponent"].alias("exponent")))
    return _let(units, lambda units: _let(of(units), multiplied))


def convert(value: Column, unit: Column, target: Column) -> Column:
    """value of unit in target; null where the dimensions differ or a unit is null."""
    return _let(unit, lambda u: _let(target, lambda t: F.when(u["dims"] == t["dims"], (value * u["scale"] + u["offset"] - t["offset"]) / t["scale"])))


# --- the grammar -----------------------------------------------------------------------------------------------
@dataclass
class Quantity:
    """What the grammar read: numbers (one, or two of a range) and the codes of their unit. A scale that is a
    product of scales has their codes with blanks between."""

    values: list[float] = field(default_factory=list)
    currency: str | None = None
    scale: str | None = None
    period: str | None = None

    @property
    def dims(self) -> tuple[tuple[str, int], ...]:
        """The exponents of money and time."""
        return tuple(x for x in (("money", 1) if self.currency else None, ("time", -1) if self.period else None) if x)


def factor_of(scale: str | None) -> float:
    """The number that a scale, or a product of scales, stands for."""
    out = 1.0
    for code in (scale or "one").split():
        out *= SCALE_FACTORS[code]
    return out


def _lexicon(table: dict[str, list[str]]) -> dict[str, str]:
    return {form: code for code, forms in table.items() for form in forms}


_EACH = {e if e[-1] in "/'" else f"{e} " for e in EACH}
_PERIOD_FORMS = _lexicon(PERIODS) | {each + noun: code for code, nouns in NOUNS.items() for noun in nouns for each in _EACH if len(noun) > 2 or noun in ("yr", "mo", "wk", "hr", "an") or each == "/"}
_PERIOD_FORMS |= {f"on {a} {adverb} basis": code for code, forms in PERIODS.items() for adverb in forms if adverb.isalpha() for a in ("a", "an")}
_FORMS: dict[str, list[tuple[str, str]]] = {}
for _kind, _table in (("currency", _lexicon(CURRENCIES)), ("scale", _lexicon(SCALES)), ("period", _PERIOD_FORMS)):
    for _form, _code in _table.items():
        _FORMS.setdefault(_form, []).append((_kind, _code))


def _alternatives(forms) -> str:
    """The forms as one pattern, longest first; forms of letters begin and end at no other letter."""
    pick = lambda lettered: "|".join(re.escape(f).replace(r"\ ", r"\s+") + (r"(?![^\W\d_])" if f[-1].isalpha() else "") for f in sorted(forms, key=len, reverse=True) if f[0].isalpha() == lettered)
    signs = pick(False)
    return rf"(?<![^\W\d_])(?:{pick(True)})" + (f"|{signs}" if signs else "")


_SPACES = "    '’"  #: between groups of three digits
_DIGITS = rf"(?<![\w.,])\d{{1,3}}(?:[{_SPACES}]\d{{3}})+(?![\d]|[.,]\d{{3}})(?:[.,]\d+)?|\d+(?:[,.]\d+)*"
_WORDS = [*NUMBER_WORDS, *TENS, "hundred", "half", "quarter", "dozen"]
#: A text in tokens: digits, units, number words, words between numbers, blanks and brackets, other words, other signs.
_TOKEN = re.compile(rf"(?P<digits>{_DIGITS})|(?P<unit>{_alternatives(_FORMS)})|(?P<number>{_alternatives(_WORDS)})|(?P<between>{_alternatives(BETWEEN)}|(?<![^\W\d_])an(?![^\W\d_]))|(?P<glue>[\s()]+)|(?P<word>[^\W\d_]+)|(?P<sign>.)", re.S)
_UNIT = re.compile(_alternatives(_FORMS))
_PAYRX = re.compile(PAY)
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^a-z])|[\r\n]+")

#: Latin letters to those without accents, typographic apostrophes to plain ones.
_PLAIN = {c: b for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if (b := unicodedata.normalize("NFD", chr(c))[0]).isascii()} | dict.fromkeys(range(0x300, 0x370)) | {0x2019: "'"}


def fold(text: str) -> str:
    """text in lower case, without the accents of Latin letters."""
    return text.lower() if text.isascii() else text.translate(_PLAIN).lower()


def _from_digits(t: str, scaled: bool = False, comma: bool = False) -> float | None:
    """The number of digits with marks. One dot before three last digits groups them, unless the number is below one
    or scaled (1.250 million); one comma does so too, unless the number is below one or comma is the decimal mark."""
    t = re.sub(rf"[{_SPACES}]", "", t)
    dots, commas = t.count("."), t.count(",")
    three = re.fullmatch(r"[1-9]\d{0,2}[.,]\d{3}", t) is not None
    if dots and commas:
        group, mark = (",", ".") if t.rfind(".") > t.rfind(",") else (".", ",")
        t = t.replace(group, "").replace(mark, ".")
    elif commas:
        t = t.replace(",", "") if commas > 1 or (re.search(r"[1-9]\d*,\d{3}$", t) and not comma) else t.replace(",", ".")
    elif dots > 1 or (dots and three and not scaled):
        t = t.replace(".", "")
    try:
        return float(t)
    except ValueError:
        return None


def _from_words(words: list[str]) -> float | None:
    """The number of number words: hundreds, tens, ones, and a half or a quarter."""
    total, last, any_number = 0.0, None, False
    for w in words:
        if w in NUMBER_WORDS or w in TENS:
            n = NUMBER_WORDS.get(w) or TENS.get(w) or 0
            if any_number and last is not None and (n >= last or last < 20):
                return None  # two numbers side by side
            total, last, any_number = total + n, n, True
        elif w in ("hundred", "dozen"):
            k = 100 if w == "hundred" else 12
            total, last, any_number = (total if any_number else 1.0) * k, float(k), True
        elif w in ("half", "quarter"):
            total, last, any_number = total + (0.5 if w == "half" else 0.25), 0.0, True
        elif w not in ("and", "a", "an"):
            return None
    return total if any_number else None


def number(text: str) -> float | None:
    """The number that text writes in digits, with grouping or decimal marks, or in words."""
    t = text.strip().lower()
    if t and t[0].isdigit():
        return _from_digits(t)
    return _from_words(re.split(r"[-\s]+", t)) if t else None


@lru_cache(maxsize=10_000)
def _unit_codes(text: str) -> tuple[str | None, str | None, str | None]:
    q = dict.fromkeys(("currency", "scale", "period"))
    for m in _UNIT.finditer(fold(text)):
        for kind, code in _codes(m[0]):
            if q[kind] is None:
                q[kind] = code
    return tuple(q.values())


def _codes(form: str) -> list[tuple[str, str]]:
    return _FORMS[re.sub(r"\s+", " ", form)]


def read_unit(text: str | None) -> Quantity:
    """The currency, scale and period that a unit expression such as 'USD k p.a.' or 'INR/mo' names."""
    return Quantity([], *_unit_codes(text or ""))


class _Reader:
    """A recursive descent over the tokens of one text; glue is skipped where a rule allows for it."""

    def __init__(self, text: str):
        self.tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]

    def kind(self, i: int) -> str | None:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else None

    def past_glue(self, i: int) -> int:
        while self.kind(i) == "glue":
            i += 1
        return i

    def unit(self, i: int, wanted: str) -> tuple[str, int] | None:
        """(code, next place) of a unit of the kind wanted at i."""
        if self.kind(i) == "unit":
            for kind, code in _codes(self.tokens[i][1]):
                if kind == wanted:
                    return code, i + 1
        return None

    def words(self, i: int) -> tuple[list[str], int] | None:
        """The number words from i on: 'twenty-five', 'two and a half', 'one hundred and twenty', 'half a', 'a'."""
        out, end, k = [], i, i
        while (kind := self.kind(k)) in ("number", "glue", "between"):
            w = self.tokens[k][1]
            if kind == "number":
                if _from_words([*out, w]) is None:
                    break
                out.append(w)
                end = k + 1
            elif kind == "between" and w not in ("-", "a", "an", "and"):
                break
            elif kind == "between":
                out.append("and" if w == "-" else w)
            k += 1
        while out and out[-1] in ("and", "a", "an"):
            out.pop()
        if out:
            if out == ["half"] and self.kind(a := self.past_glue(end)) == "between" and self.tokens[a][1] == "a":
                end = a + 1  # half a million
            return out, end
        if self.kind(i) == "between" and self.tokens[i][1] in ("a", "an"):
            scale = self.unit(self.past_glue(i + 1), "scale")
            if scale and len(self.tokens[scale[1] - 1][1]) > 3:
                return ["one"], i + 1  # a million
        return None

    def term(self, i: int) -> tuple[float, list[str], int, bool] | None:
        """(number, scales, next place, in words) at i."""
        worded = self.kind(i) != "digits"
        if worded:
            found = self.words(i)
            if not found:
                return None
            words, end = found
        else:
            end = i + 1
        scales, k = [], end
        while s := self.unit(self.past_glue(k), "scale"):
            scales.append(s[0])
            k = s[1]
            if "currency" in dict(_codes(self.tokens[k - 1][1])):
                k -= 1  # a form that names a currency too is read again as such
                break
        if worded:
            n = _from_words(words)
        else:
            german = k > end and self.tokens[k - 1][1].startswith(("mio", "mrd", "tsd"))
            n = _from_digits(self.tokens[i][1], bool(scales), german)
        return None if n is None else (n, scales, k, worded)

    def value(self, i: int) -> tuple[float, str | None, int] | None:
        """(number, scale, next place): a term, or a sum of terms of falling scale."""
        first = self.term(i)
        if first is None:
            return None
        n, scales, end, worded = first
        total, least, more = n * factor_of(" ".join(scales)), factor_of(" ".join(scales)), False
        while scales and least > 1:
            k = self.past_glue(end)
            if worded and self.kind(k) == "between" and self.tokens[k][1] == "and":
                k = self.past_glue(k + 1)
            t = self.term(k) if self.kind(k) in ("digits", "number") else None
            if t is None or factor_of(" ".join(t[1])) >= least or t[3] != worded or (not t[1] and not worded) or t[0] * factor_of(" ".join(t[1])) >= least:
                break
            total, least, end, more = total + t[0] * factor_of(" ".join(t[1])), factor_of(" ".join(t[1])), t[2], True
        return (total, None, end) if more else (n, " ".join(scales) or None, end)

    def amount(self, i: int) -> tuple[Quantity, int] | None:
        """(quantity, next place): a currency or none, a value, a second one of a range, then the rest of the unit."""
        q, k = Quantity(), i
        if c := self.unit(k, "currency"):
            q.currency, k = c[0], self.past_glue(c[1])
        v = self.value(k)
        if v is None:
            return None
        n, q.scale, k = v
        q.values = [n]
        if self.kind(b := self.past_glue(k)) == "between" and self.tokens[b][1] not in ("an",):
            b = self.past_glue(b + 1)
            c = self.unit(b, "currency")
            second = self.value(self.past_glue(c[1]) if c else b)
            if second:
                q.currency = q.currency or (c[0] if c else None)
                if q.scale is None:
                    q.scale = second[1]  # 66-84 thousand
                q.values.append(second[0] * factor_of(second[1]) / factor_of(q.scale) if second[1] and second[1] != q.scale else second[0])
                k = second[2]
        while self.kind(u := self.past_glue(k)) == "unit":
            for kind, code in _codes(self.tokens[u][1]):
                if getattr(q, kind) is None:
                    setattr(q, kind, code)
            k = u + 1
        return q, k

    def amounts(self) -> Iterator[tuple[int, int, Quantity]]:
        i = 0
        while i < len(self.tokens):
            glued = self.kind(i) == "digits" and self.kind(i - 1) == "word" and self.tokens[i - 1][3] == self.tokens[i][2]
            found = None if glued or self.kind(i) in ("word", "sign", "glue") else self.amount(i)
            if found:
                yield self.tokens[i][2], self.tokens[found[1] - 1][3], found[0]
                i = found[1]
            else:
                i += 1


def amounts(text: str) -> Iterator[tuple[int, int, Quantity]]:
    """(begin, end, quantity) of each number in fold(text), with the unit around it; a range is one quantity."""
    return _Reader(fold(text)).amounts()


def ratio_scale(full: float, recorded: float) -> str | None:
    """The scale by which recorded makes full, if there is one."""
    if recorded and full:
        for code, f in SCALE_FACTORS.items():
            if abs(full / recorded / f - 1) < 1e-6:
                return code
    return None


def read_pay(recorded: list[float | None], unit: str | None, text: str | None) -> Quantity:
    """The unit of the recorded pay: what its unit field says, else what a statement on pay in text says.

    A statement is a sentence with a word on pay. One that repeats one of the recorded numbers in full gives their
    scale by the ratio; the unit of an amount is what stands with it, then what the sentence names between the
    amount before and it, then between it and the next. Statements without numbers name scale or period. Sums in
    sentences that aren't on pay say nothing.
    """
    q = read_unit(unit)
    if not text or (q.currency and q.scale and q.period):
        return q
    known = [r for r in recorded if r]
    numbered: list[tuple[Quantity, str | None]] = []
    plain = Quantity()
    for sentence in _SENTENCE.split(text):
        sentence = fold(sentence)
        first = _PAYRX.search(sentence)
        if not first:
            continue
        read = list(amounts(sentence))
        found = False
        for k, (a, b, s) in enumerate(read):
            if a < first.end() or not (s.currency or s.scale or s.period or len(s.values) == 2):
                continue
            before = read_unit(sentence[read[k - 1][1] if k else 0 : a])
            after = read_unit(sentence[b : read[k + 1][0] if k + 1 < len(read) else len(sentence)])
            s.period = s.period or before.period or after.period
            s.currency = s.currency or before.currency or after.currency
            matches = [c for r in known for v in s.values if (c := ratio_scale(v * factor_of(s.scale), r))]
            if len(s.values) == 2 or matches:
                found = True
                numbered.append((s, matches[0] if matches else None))
        if not found and not re.search(r"\d", sentence):
            s = _statement(sentence)
            plain = Quantity([], plain.currency or s.currency, plain.scale or s.scale, plain.period or s.period)
    best = next((x for x in numbered if x[1]), numbered[0] if numbered else (None, None))
    s, scale = best[0] or Quantity(), best[1] or (best[0].scale if best[0] else None)
    return Quantity([], q.currency or s.currency or plain.currency, q.scale or scale or plain.scale, q.period or s.period or plain.period)


#: Wordings of statements without numbers, besides the forms of PERIODS and SCALES.
_STATED = re.compile(r"\b(?:in|are|is|stated in|shown in|quoted in)\s+(k|thousands?|lakhs?|lacs|crores?|millions?)\b")


def _statement(sentence: str) -> Quantity:
    """Scale and period of a sentence on pay without numbers."""
    q = read_unit(sentence)
    m = _STATED.search(sentence)
    return Quantity([], q.currency, read_unit(m[1]).scale if m else None, q.period)


def read_amount(raw: str, unit: str | None, text: str | None) -> Quantity | None:
    """The amount that raw states, its currency from the unit field, raw or text; None if raw states none."""
    own = next((q for _, _, q in amounts(raw) if q.values), None)
    if own is None:
        return None
    if (own.scale is None or own.currency is None) and text:
        mine = own.values[0] * factor_of(own.scale)
        for _, _, q in amounts(text):
            code = ratio_scale(q.values[0] * factor_of(q.scale), mine)
            if code and (q.currency or q.scale) and (own.scale is None or code == "one"):
                own.scale, own.currency = own.scale or code, own.currency or q.currency
                break
    own.currency = read_unit(unit).currency or own.currency
    return own


_SCHEMA = "row_id bigint, field_name string, value double, currency string, scale string, period string"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 6
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["row_id", "field_name", "value", "currency", "scale", "period"])


def read_pays(df: DataFrame, key: str, fields: list[str], unit: str, text: str) -> DataFrame:
    """(row_id, field_name, value, currency, scale, period) of each non-null value of the pay fields of df."""
    ship(df.sparkSession)
    some = F.coalesce(*[F.col(f).try_cast("double") for f in fields]).isNotNull()
    rows = df.where(some).select(F.col(key).cast("long").alias("k"), *[F.col(f).try_cast("double").alias(f"v{i}") for i, f in enumerate(fields)], F.col(unit).cast("string").alias("u"), F.col(text).cast("string").alias("t"))

    def run(batches):
        for b in batches:
            out = []
            values = [b.column(f"v{i}").to_pylist() for i in range(len(fields))]
            for k, u, t, *vs in zip(b.column("k").to_pylist(), b.column("u").to_pylist(), b.column("t").to_pylist(), *values):
                q = read_pay(vs, u, t)
                out += [(k, f, v, q.currency, q.scale or "one", q.period or "year") for f, v in zip(fields, vs) if v is not None]
            yield _emit(out)

    return rows.mapInArrow(run, _SCHEMA)


def read_amounts(df: DataFrame, key: str, raw: str, unit: str, text: str) -> DataFrame:
    """(row_id, field_name, value, currency, scale, period) of each raw amount of df that states one."""
    ship(df.sparkSession)
    rows = df.where(F.col(raw).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(raw).cast("string").alias("r"), F.col(unit).cast("string").alias("u"), F.col(text).cast("string").alias("t"))

    def run(batches):
        for b in batches:
            out = []
            for k, r, u, t in zip(*(b.column(c).to_pylist() for c in "krut")):
                q = read_amount(r, u, t)
                if q:
                    out.append((k, raw, q.values[0], q.currency, q.scale or "one", q.period))
            yield _emit(out)

    return rows.mapInArrow(run, _SCHEMA)


def unit_table(factors: DataFrame) -> Column:
    """The base units of factors (kind, unit_code, factor) as one map of codes 'kind:unit_code', a scalar subquery.

    A currency is money, a scale a number; a period's factor says how often it fits into the year. Only codes of the
    grammar are taken, so the map is bounded; units given twice count once.
    """
    codes = [f"{kind}:{c}" for kind, known in (("currency", CURRENCIES), ("scale", SCALE_FACTORS), ("period", PERIODS)) for c in known]
    code = F.concat_ws(":", "kind", "unit_code")
    one = factors.where(code.isin(codes) & F.col("factor").isNotNull()).groupBy(code.alias("code"), "kind").agg(F.max("factor").alias("factor"))
    unit = F.when(F.col("kind") == "currency", base_unit({"money": 1}, F.col("factor"))).when(F.col("kind") == "period", base_unit({"time": 1}, 1 / F.col("factor"))).otherwise(base_unit({}, F.col("factor")))
    return one.agg(F.map_from_entries(F.collect_list(F.struct("code", unit.alias("unit")))).alias("units")).scalar()


def canonical(quantities: DataFrame, factors: DataFrame, dims: Dims = PAY_DIMS) -> DataFrame:
    """quantities with canonical double: their values in the canonical unit of the dimension asked for.

    The unit is currency * scales / period. Quantities without currency, with a unit that factors lack, or of
    another dimension have null.
    """
    term = lambda kind, code, exponent: F.struct(F.concat(F.lit(f"{kind}:"), code).alias("code"), F.lit(exponent).alias("exponent"))
    scales = F.transform(F.split("scale", " "), lambda s: term("scale", s, 1))
    terms = F.concat(F.array(term("currency", F.col("currency"), 1)), scales, F.when(F.col("period").isNull(), F.expr("cast(array() as array<struct<code: string, exponent: int>>)")).otherwise(F.array(term("period", F.col("period"), -1))))
    # a column of its own: a subquery can't stand in a higher-order function
    unit = F.when(F.col("currency").isNotNull(), product(F.col("q__units"), terms))
    return quantities.withColumn("q__units", unit_table(factors)).select(*quantities.columns, convert(F.col("value"), unit, base_unit(dims, 1.0)).alias("canonical"))
