"""Records that name companies loosely, matched to a company table by a cascade of exact joins.

Names become attributes: folded base words, generic words (those that many company names share), an initial,
a domain, and sector and city from headline or notes. The keys of all rules of the cascade, from strong to weak, are
joined at once as one long table, N:1 with the keys of the companies: those that name one company lead to it unless
its sector, city or domain contradicts; those that name several are looked up again together with what the record
knows, in counts of companies for each combination of sector, city and domain, known, unknown or any. A rule decides
where exactly one company is left, the first that decides holds, and only records that no rule resolves are compared
with one edit. Records whose domain is that of a company serve as labels: a copy of each without its domain runs
along, and the share of copies that a rule resolves to the labelled company, smoothed, is the rule's confidence.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrycast.runtime import cut, ship

GENERIC_SHARE, GENERIC_LEAST = 0.005, 5  #: a word is generic if at least this share and number of names has it
LEAST_TYPO = 6  #: letters of the shortest name that is compared with one edit
CUTS, ENDS = 80, 32  #: letters up to which names are found by leaving out one, else by so many first or last ones
LEAST_CONFIDENCE = 0.5  #: what a match must exceed; a rule of a kind without any label has just that

# --- fixed values: legal forms, and what news puts around a name ---------------------------------------------
LEGAL = r"\b(?:pvt|private|ltd|limited|inc|incorporated|gmbh|co|company|corp|corporation|technologies|technology|llc|llp|plc|ag|sa|srl|bv|pte|oy|ab)\b\.?"
KINDS = r"(?:start-?up|firm|company|platform|maker|provider)"
DOMAIN_WRAP = r"^(?:get|try|use|join)(?=\w{4})|(?:hq|-?app)$"
# --------------------------------------------------------------------------------------------------------------
_TAGS = re.compile(r"\[[^\]]*\]|\([^)]*\)|[™®©]")
_BASED = re.compile(r"^.*?\S-based\s+", re.S)
_KIND = re.compile(rf"^[\w &/-]{{2,40}}?\s{KINDS}\s+(?=\S)", re.I)
_LEGAL = re.compile(LEGAL, re.I)
_INITIAL = re.compile(r"\s([^\W\d_])\.$")
_DOMAIN = re.compile(r"(?:https?://)?(?:www\.)?([a-z0-9-]+(?:\.[a-z0-9-]+)+)/?", re.I)
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """text in lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def domain(url: Column) -> Column:
    """The host of a domain or URL written in any way: lower case, without scheme, www, path and blanks."""
    d = F.regexp_replace(F.lower(F.trim(url)), r"^(?:[a-z]+://)?(?:www\.)?", "")
    return F.nullif(F.regexp_replace(d, r"[/?#:\s].*$|\.$", ""), F.lit(""))


def parse_name(name: str | None, generic: frozenset[str]) -> tuple[str | None, ...]:
    """(base, rest, full, stem, initial, site) of a name; base holds its rare words, rest its generic ones, full
    both in that order, stem and initial all words but the last and its letter, site the domain that stands for a name."""
    if not name or not name.strip():
        return (None,) * 6
    text = _TAGS.sub(" ", name).strip()
    if m := _DOMAIN.fullmatch(text):
        site = m[1].lower()
        label = re.sub(r"[^a-z0-9]", "", re.sub(DOMAIN_WRAP, "", site.rsplit(".", 1)[0].split(".")[-1]))
        return label, "", label, None, None, site
    text = _KIND.sub("", _BASED.sub("", text))
    m = _INITIAL.search(text.strip())
    if m and not _LEGAL.fullmatch(m[0].strip()):
        stem = "".join(_WORD.findall(fold(text.strip()[: m.start()])))
        return None, None, None, stem or None, fold(m[1]), None
    words = _WORD.findall(fold(_LEGAL.sub(" ", text))) or _WORD.findall(fold(text))
    base, rest = "".join(w for w in words if w not in generic), "".join(w for w in words if w in generic)
    ordered = [w for w in words if w not in generic] + [w for w in words if w in generic]
    return base or None, rest, (base + rest) or None, "".join(ordered[:-1]) or None, ordered[-1][0] if ordered else None, None


def generic_words(companies: DataFrame, name: str) -> frozenset[str]:
    """Words that many names share. No more than (words in a name) / GENERIC_SHARE words can be so."""
    names = companies.where(F.col(name).isNotNull())
    n = names.count()
    words = names.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w"))
    least = max(GENERIC_LEAST, GENERIC_SHARE * n)
    return frozenset(fold(r.w) for r in words.groupBy("w").count().where(F.col("count") >= least).collect())


def _named(df: DataFrame, name: str, generic: frozenset[str]) -> DataFrame:
    """df with the attributes of parse_name()."""

    @F.pandas_udf("base string, rest string, full string, stem string, initial string, site string")
    def parse(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_name(n, generic) for n in names], columns=["base", "rest", "full", "stem", "initial", "site"])

    return df.withColumn("n", parse(F.col(name))).select("*", "n.*").drop("n")


def _clean(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def headline_hints(headline: Column) -> tuple[Column, Column]:
    """(sector, city) that a headline names: 'City-based sector startup Name ...'."""
    city = _clean(F.regexp_extract(headline, r"((?:\p{Lu}[\p{L}.']*\s?)+)-based\b", 1))
    sector = _clean(F.regexp_extract(headline, rf"(?i)(?:^|-based\s+|[\]:–-]\s+)((?:[\p{{L}}&/]+\s+){{1,3}}?){KINDS}\s", 1))
    return sector, city


def note_hints(notes: Column) -> tuple[Column, Column]:
    """(sector, city) of a company's notes, which may name either or both in several wordings."""
    n = F.trim(notes)
    forms = [(r"^HQ:\s*(.*?)\.\s*Sector:\s*(.*)$", 2, 1), (r"^(.*?);\s*HQ:?\s+(.*)$", 1, 2), (r"^(.*?),\s*based in\s+(.*)$", 1, 2), (r"^(.*?)\s*\|\s*(.*)$", 2, 1), (r"^()HQ:?\s*(.*)$", 1, 2), (r"^()(\p{Lu}.*)$", 1, 2), (r"^(.*)()$", 1, 2)]
    sector, city = F.lit(None), F.lit(None)
    for rx, s, c in reversed(forms):
        sector = F.when(n.rlike(rx), F.regexp_extract(n, rx, s)).otherwise(sector)
        city = F.when(n.rlike(rx), F.regexp_extract(n, rx, c)).otherwise(city)
    return _clean(sector), _clean(city)


def _variants(full: Column) -> Column:
    """Keys of which names one edit apart share one: all letters but any one, or both ends of long names.

    One edit touches two neighbours at most, so it leaves one end of a long name as it is. Names of CUTS letters and
    one more have both kinds of keys, as an edit may lead from one to the other.
    """
    n = F.length(full)
    cuts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(full, F.lit(1), i - 1), F.substring(full, i + 1, n)))
    short = F.when(n <= CUTS + 1, F.concat(F.array(full), cuts)).otherwise(F.expr("cast(array() as array<string>)"))
    long = F.when(n >= CUTS, F.array(F.concat(F.lit("<"), F.substring(full, 1, ENDS)), F.concat(F.lit(">"), F.right(full, F.lit(ENDS))))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.when(n >= LEAST_TYPO, F.array_distinct(F.concat(short, long)))


def _one_edit(a: Column, b: Column) -> Column:
    """a and b are the same or differ by one letter put in, left out or replaced, or by two neighbours exchanged."""
    n = F.least(F.length(a), F.length(b))
    head = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: F.when((s == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(s))
    swapped = (F.substring(a, head + 1, F.lit(1)) == F.substring(b, head + 2, F.lit(1))) & (F.substring(a, head + 2, F.lit(1)) == F.substring(b, head + 1, F.lit(1))) & (F.substring(a, head + 3, n) == F.substring(b, head + 3, n))
    apart = F.levenshtein(a, b, 2)
    return (apart.between(0, 1)) | F.when((apart == 2) & (F.length(a) == F.length(b)), swapped).otherwise(False)


#: Which of sector and city must agree, strongest first.
LEVELS = ["sector_city", "sector", "city", "alone"]
#: The cascade, strongest first: rule, attributes of the record, space of the companies' keys, condition, with levels or not.
CASCADE = [
    ("domain", ["domain"], "domain", None, False),
    ("site", ["site"], "domain", None, False),
    ("name", ["full"], "full", None, True),
    ("site_name", ["full"], "turned", "site is not null", True),
    ("initial", ["stem", "initial"], "initial", "full is null", True),
    ("base", ["base"], "base", "rest = ''", True),
    ("typo", ["near"], "full", None, True),
    ("base_typo", ["near"], "base", "rest = ''", True),
]
SPACES = {"domain": ["domain"], "full": ["full"], "turned": ["turned"], "initial": ["stem", "initial"], "base": ["base"]}
EVIDENCE = ["sector", "city", "domain"]
ANY, NONE = "\x01", "\x00"  #: in place of an attribute: whatever it is, and unknown
ITEM = ["item", "probe", "label"]


def _sorted(df: DataFrame) -> DataFrame:
    """df with a hint that keeps a join with it from being a broadcast.

    Spark takes what explode() makes for as large as its input, so that it would send keys of many times its limit
    through the driver.
    """
    return df.hint("merge")


def _joined(parts: list[str]) -> Column:
    """The attributes as one key; null where one is null."""
    return F.concat(*[x for i, c in enumerate(parts) for x in ((F.lit("\x02"), F.col(c)) if i else (F.col(c),))])


def _item_keys(items: DataFrame, rules: list[str]) -> DataFrame:
    """(item, probe, label, rule, space, key, sector, city, domain) of each rule that an item has a key for."""
    keys = []
    for n, (rule, mine, space, when, _) in enumerate(CASCADE):
        if rule in rules:
            key = F.when(F.expr(when), _joined(mine)) if when else _joined(mine)
            keys.append(F.struct(F.lit(n).alias("rule"), F.lit(space).alias("space"), key.alias("key")))
    some = items.select(*ITEM, *EVIDENCE, F.explode(F.array(*keys)).alias("k")).where("k.key is not null")
    # the domain rule is the domain's own evidence
    return some.select(*ITEM, "k.*", "sector", "city", F.when(F.col("k.rule") != 0, F.col("domain")).alias("domain"))


def _company_keys(companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one, several): keys with the number of their companies and the only one's evidence, and for keys of several
    companies their number for each combination of evidence, any of which may be ANY."""
    keys = F.array(*[F.struct(F.lit(space).alias("space"), _joined(parts).alias("key")) for space, parts in SPACES.items()])
    flat = companies.select("company", *EVIDENCE, F.explode(keys).alias("k")).select("company", *EVIDENCE, "k.*").where("key is not null")
    one = flat.groupBy("space", "key").agg(F.count("*").alias("n"), F.min("company").alias("company"), *[F.min(e).alias(f"their_{e}") for e in EVIDENCE])
    several = flat.join(_sorted(one.where("n > 1").select("space", "key")), ["space", "key"], "left_semi")
    for e in EVIDENCE:
        several = several.withColumn(e, F.explode(F.array(F.coalesce(e, F.lit(NONE)), F.lit(ANY))))
    return one, several.groupBy("space", "key", *EVIDENCE).agg(F.count("*").alias("n"), F.min("company").alias("company"))


def _decide(keys: DataFrame, one: DataFrame, several: DataFrame) -> DataFrame:
    """(item, probe, label, company, rule) by the first rule that leaves one company which nothing contradicts."""
    met = keys.join(_sorted(one), ["space", "key"])
    fits = F.lit(True)
    for e in EVIDENCE:
        fits &= F.col(e).isNull() | F.col(f"their_{e}").isNull() | (F.col(e) == F.col(f"their_{e}"))
    agrees = lambda e: F.coalesce(F.col(e) == F.col(f"their_{e}"), F.lit(False)).alias(f"same_{e}")
    alone = met.where((F.col("n") == 1) & fits).select(*ITEM, "rule", "n", "company", agrees("sector"), agrees("city"))
    many = met.where("n > 1").select(*ITEM, "rule", "space", "key", *EVIDENCE)
    for e in EVIDENCE:
        many = many.withColumn(e, F.explode(F.when(F.col(e).isNull(), F.array(F.lit(ANY))).otherwise(F.array(F.col(e), F.lit(NONE)))))
    same = lambda e: (~F.col(e).isin(ANY, NONE)).alias(f"same_{e}")
    many = many.join(_sorted(several), ["space", "key", *EVIDENCE]).select(*ITEM, "rule", "n", "company", same("sector"), same("city"))
    when = {"sector_city": F.col("same_sector") & F.col("same_city"), "sector": F.col("same_sector"), "city": F.col("same_city"), "alone": F.lit(True)}
    sums = [x for level, c in when.items() for x in (F.sum(F.when(c, F.col("n"))).alias(f"n_{level}"), F.min(F.when(c, F.col("company"))).alias(f"company_{level}"))]
    left = alone.unionByName(many).groupBy(*ITEM, "rule").agg(*sums)
    names = F.array(*[F.lit(c[0]) for c in CASCADE])
    levelled = F.array(*[F.lit(c[4]) for c in CASCADE])[F.col("rule")]
    decision = F.lit(None)
    for level in reversed(LEVELS):
        name = F.concat_ws("_", names[F.col("rule")], F.when(levelled, F.lit(level)))
        decision = F.when((F.col(f"n_{level}") == 1) & (levelled | F.lit(level == "alone")), F.struct(F.col(f"company_{level}").alias("company"), name.alias("rule"), names[F.col("rule")].alias("kind"))).otherwise(decision)
    decided = left.select(*ITEM, F.col("rule").alias("order"), decision.alias("d")).where("d is not null")
    return decided.groupBy(*ITEM).agg(F.min_by("d", "order").alias("d")).select(*ITEM, "d.*")


def match(items: DataFrame, companies: DataFrame, item_id: str = "id", name: str = "company_name", headline: str = "headline", site: str = "resolved_domain", company_id: str = "id", company_name: str = "name", company_domain: str = "domain", notes: str = "notes") -> DataFrame:
    """(item_id, company_id, rule, confidence): at most one company for each item.

    Items without name, id or match have no row. Companies without name match by domain only. Where several
    companies that nothing contradicts have the attributes of a rule, it decides nothing; copies of one company row
    count once. A rule's confidence is (right + 2 * p) / (labelled + 2), p that of all rules of its kind with one
    right and one wrong added.
    """
    ship(items.sparkSession)
    generic = generic_words(companies, company_name)
    sector, city = note_hints(F.col(notes))
    c = companies.where(F.col(company_id).isNotNull()).select(F.col(company_id).cast("long").alias("company"), F.col(company_name).alias("given"), domain(F.col(company_domain)).alias("domain"), sector.alias("sector"), city.alias("city"))
    c = _named(c.dropDuplicates(["company"]), "given", generic)
    c = cut(c.withColumn("turned", F.concat("rest", "base")).drop("given", "site"))
    sector, city = headline_hints(F.col(headline))
    i = items.where(F.col(name).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(name).alias("given"), domain(F.col(site)).alias("domain"), sector.alias("sector"), city.alias("city"))
    i = _named(i.dropDuplicates(["item"]), "given", generic).drop("given")
    # cities count only where companies have them too: other words before "-based" are no places
    unique_domains = c.where("domain is not null").groupBy("domain").agg(F.min("company").alias("label"), F.count("*").alias("k")).where("k = 1").drop("k")
    i = i.join(_sorted(unique_domains), "domain", "left")
    # an item with a label runs twice: as it is, and as a probe without its domain
    i = i.withColumn("probe", F.explode(F.when(F.col("label").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))).withColumn("domain", F.when(~F.col("probe"), F.col("domain")))
    i = cut(i)
    one, several = _company_keys(c)
    exact = [rule for rule, mine, *_ in CASCADE if mine != ["near"]]
    found = cut(_decide(_item_keys(i, exact), one, several))
    # what is left, by one edit: names of companies that are near stand for the item's own in the keys
    rest = i.where("full is not null").join(_sorted(found.select("item", "probe")), ["item", "probe"], "left_anti")
    wholes = c.select(F.explode(F.array(F.struct(F.lit("typo").alias("kind"), F.col("full").alias("near")), F.struct(F.lit("base_typo").alias("kind"), F.col("base").alias("near")))).alias("w")).select("w.*").where("near is not null").distinct()
    # names alone are laid out in their variants, by hashes; whether two really are near is looked at afterwards
    laid_out = lambda names, c: names.withColumn("v", F.explode(F.transform(_variants(F.col(c)), lambda v: F.xxhash64(v))))
    near = laid_out(rest.select("full").distinct(), "full").join(_sorted(laid_out(wholes, "near")), "v")
    near = rest.join(_sorted(near.where(_one_edit(F.col("full"), F.col("near"))).drop("v").distinct()), "full")
    keys = _item_keys(near.where("kind = 'typo'"), ["typo"]).unionByName(_item_keys(near.where("kind = 'base_typo'"), ["base_typo"]))
    found = cut(found.unionByName(_decide(keys, one, several)))
    # the domain rule is judged by how often the names of its items lead to the same company
    probed = found.where("probe").select("rule", "kind", (F.col("company") == F.col("label")).alias("right"))
    probed = probed.unionByName(probed.select(F.lit("domain").alias("rule"), F.lit("domain").alias("kind"), "right"))
    of_kind = probed.groupBy("kind").agg(((F.count_if("right") + 1) / (F.count("*") + 2)).alias("p"))
    of_rule = probed.groupBy("rule").agg(F.count("*").alias("labelled"), F.count_if("right").alias("right"))
    out = found.where("not probe").join(F.broadcast(of_kind), "kind", "left").join(F.broadcast(of_rule), "rule", "left")
    none = F.lit(0)
    p = F.coalesce("p", F.lit(LEAST_CONFIDENCE))
    return out.select(F.col("item").alias(item_id), F.col("company").alias("company_id"), "rule", ((F.coalesce("right", none) + 2 * p) / (F.coalesce("labelled", none) + 2)).alias("confidence"))
