"""Changes between full deliveries of a table.

All deliveries are united, tagged by their number. One aggregation by key and number leaves a row of hashes for each
side that a key has, combined before the shuffle, so repeated rows and hot keys cost nothing; the sides of a key, at
most as many as there are deliveries, are then put in order and classified in the JVM. No text crosses a shuffle,
and the plan is the same for five deliveries and for five hundred.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrycast.runtime import ship

#: Fixed value: white space of any kind, zero-width spaces included.
SPACE = r"(?U)[\s\x{200B}\x{2060}\x{FEFF}]+"
#: Text that no composition can change: all characters below U+0300, and general punctuation.
COMPOSED = r"^[\x{0000}-\x{02FF}\x{2010}-\x{2027}\x{2030}-\x{205E}]*\z"
#: The same, without white space.
DONE = r"^[\x{0000}-\x{0008}\x{000E}-\x{001F}!-\x{0084}\x{0086}-\x{009F}\x{00A1}-\x{02FF}\x{2010}-\x{2027}\x{2030}-\x{205E}]*\z"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def with_bare(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """df with each text as a column of its name, without any white space and with composed characters; null where
    nothing is left.

    Blanks and line feeds are cut out byte by byte; only what has other white space then, or characters that
    composition may change, is held against patterns, and only the latter leaves the JVM. Each step is a column of
    its own, so that none is computed twice.
    """
    cut = {n: F.replace(F.replace(t.cast("string"), F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")) for n, t in texts.items()}
    plain = {n: F.when(F.col(n).rlike(DONE), F.col(n)).otherwise(F.regexp_replace(n, SPACE, "")) for n in texts}
    loose = {f"{n}__loose": F.when(~F.col(n).rlike(COMPOSED), F.col(n)) for n in texts}
    composed = {f"{n}__loose": _nfc(f"{n}__loose") for n in texts}
    whole = {n: F.nullif(F.coalesce(f"{n}__loose", n), F.lit("")) for n in texts}
    return df.withColumns(cut).withColumns(plain).withColumns(loose).withColumns(composed).withColumns(whole).drop(*loose)


def stripped(text: Column) -> Column:
    """text without surrounding white space of any kind; null where nothing is left."""
    return F.nullif(F.regexp_replace(text.cast("string"), rf"^{SPACE}|{SPACE}$", ""), F.lit(""))


def changes(df: DataFrame, number: str, group: list[str], key: str, compared: list[str], kept: list[str], delivered: str | None = None, arrived: str | None = None) -> DataFrame:
    """(group..., key, number, change_kind) of each key that was added, removed or changed.

    df has one row per record of a delivery; all numbers of df are deliveries. group columns name the partial table
    (such as a board) whose consecutive deliveries are compared; a row whose `delivered` is 0 says that its group had
    no such delivery, which is skipped then. A column of `compared` differs if its text without white space, in
    composed form, does; one that is also in `kept` stands for the last delivered value where it is null or blank.
    The first delivery of a group gives no rows. Of repeated rows of a key in one delivery the last by `arrived`
    counts, of those that tie in it the one with the greatest hash; for a column of kept the last that isn't blank.
    Rows without key or number count for nothing, a null in a group column is a value of its own.
    """
    ship(df.sparkSession)
    rows = df.where(F.col(number).isNotNull()).withColumn("q__n", F.col(number).cast("int"))
    ok = F.coalesce(F.col(delivered), F.lit(1)) != 0 if delivered else F.lit(True)
    at = F.col(arrived) if arrived else F.lit(0)
    hashes = [f"h{i}" for i in range(len(compared))]
    tagged = rows.where(ok).select(*group, stripped(F.col(key)).alias("q__key"), "q__n", at.alias("q__at"), *[F.col(c).alias(f"q__{h}") for c, h in zip(compared, hashes)])
    tagged = with_bare(tagged.where("q__key is not null"), {f"q__{h}": F.col(f"q__{h}") for h in hashes})
    tagged = tagged.select(*group, F.col("q__key").alias(key), "q__n", "q__at", *[F.when(F.col(f"q__{h}").isNotNull(), F.xxhash64(f"q__{h}")).alias(h) for h in hashes])
    last = lambda c, h: F.max(F.when(F.col(h).isNotNull(), F.struct("q__at", h)) if c in kept else F.struct("q__at", h))[h].alias(h)
    sides = tagged.groupBy(*group, key, "q__n").agg(*[last(c, h) for c, h in zip(compared, hashes)])
    records = sides.groupBy(*group, key).agg(F.map_from_entries(F.collect_list(F.struct("q__n", F.struct(*hashes)))).alias("q__sides"))
    if delivered:
        missing = rows.where(~ok).groupBy(*[F.col(g).alias(f"m_{g}") for g in group]).agg(F.collect_set("q__n").alias("q__missing"))
        on = F.lit(True)
        for g in group:
            on &= F.col(g).eqNullSafe(F.col(f"m_{g}"))
        records = records.join(missing, on, "left")
    else:
        records = records.withColumn("q__missing", F.lit(None).cast("array<int>"))
    none = F.expr("cast(array() as array<int>)")
    deliveries = rows.agg(F.sort_array(F.collect_set("q__n")).alias("n")).scalar()
    # columns of their own, since a subquery can't stand in a higher-order function
    records = records.withColumn("q__all", deliveries).withColumn("q__taken", F.array_except("q__all", F.coalesce("q__missing", none)))
    nothing = F.struct(F.lit(False).alias("begun"), F.lit(False).alias("p"), *[F.lit(None).cast("bigint").alias(h) for h in hashes], F.expr("cast(array() as array<struct<n: int, kind: string>>)").alias("out"))

    def step(s: Column, n: Column) -> Column:
        x = F.try_element_at(F.col("q__sides"), n)
        p = x.isNotNull()
        now = {h: F.coalesce(x[h], s[h]) if c in kept else F.when(p, x[h]).otherwise(s[h]) for h, c in zip(hashes, compared)}
        differs = F.lit(False)
        for h in hashes:
            differs |= ~now[h].eqNullSafe(s[h])
        kind = F.when(p & ~s["p"], "added").when(~p & s["p"], "removed").when(p & s["p"] & differs, "changed")
        out = F.when(s["begun"] & kind.isNotNull(), F.concat(s["out"], F.array(F.struct(n.alias("n"), kind.alias("kind"))))).otherwise(s["out"])
        return F.struct(F.lit(True).alias("begun"), p.alias("p"), *[now[h].alias(h) for h in hashes], out.alias("out"))

    cases = records.select(*group, key, F.explode(F.aggregate("q__taken", nothing, step, lambda s: s["out"])).alias("c"))
    return cases.select(*group, key, F.col("c.n").cast(df.schema[number].dataType).alias(number), F.col("c.kind").alias("change_kind"))
