"""UTC instants of timestamps written in mixed forms, with or without zone.

A value is taken apart by patterns in the JVM into local date, local time and zone. Zones with rules are then
resolved by an as-of join: zone-offset intervals, exploded by local year, are joined on (zone, year), and the
intervals that hold the local time decide. One gives the offset; two mean that the local time occurs twice,
and the earlier instant is taken; none means that it is skipped, and the offset before the change holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrycast.runtime import ship, small_enough

#: English month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
FIRST_YEAR, LAST_YEAR = 1970, 2100  #: years whose zone rules are known to the join
#: A plain number is in seconds, milliseconds or microseconds, whichever falls into these years.
NUMBER_YEARS = (2024, 2026)
MAX_HINTS = 100_000  #: rows of a hint or name table that may be broadcast

_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_ZONE = r"(z|[+-]\d{2}(?::?\d{2})?|\[?[a-z][a-z0-9_+-]*(?:/[a-z0-9_+-]+)*\]?)"
_TIME = rf"(?:(?:t|\s+at\s+|,?\s+)(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,]\d+)?)?\s*((?<![a-z])[ap]\.?m\b\.?)?\s*{_ZONE}?)?"
#: Groups: 1-3 year, month, day; 4-6 first, second, year of a date in the order of its source, with the separator
#: between; 7-9 day, month name, year; 10-12 month name, day, year; 13-17 hour, minute, second, half of day, zone.
FORM = rf"(?i)^\s*(?:(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})|(\d{{1,2}})[/.](\d{{1,2}})[/.](\d{{4}})|{_DAY}(\d{{1,2}})\s+({_MONTH})\.?,?\s+(\d{{4}})|{_DAY}({_MONTH})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})){_TIME}\s*$"
COMPACT = r"(?i)^\s*(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})?"
NUMBER = r"^\s*\d+(?:\.\d*)?(?:[eE]\+?\d+)?\s*$"


def offset_intervals(spark: SparkSession) -> DataFrame:
    """(tz_name, year, intervals): the offsets in force in each local year of each IANA zone.

    An interval (from, until, off) holds local seconds from <= t < until at off seconds east. One row per zone
    and year, so its size is bounded by the IANA database.
    """
    import zoneinfo

    ship(spark)
    names = spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "tz_name string").repartition(8)
    lower, upper = datetime(FIRST_YEAR - 1, 12, 1, tzinfo=timezone.utc), datetime(LAST_YEAR + 1, 2, 1, tzinfo=timezone.utc)

    def rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name in batch["tz_name"]:
                try:
                    zone = zoneinfo.ZoneInfo(name)
                except Exception:  # noqa: BLE001 - a name that this machine's database lacks
                    continue
                at = lambda t: int(datetime.fromtimestamp(t, zone).utcoffset().total_seconds())  # noqa: E731, B023
                begin, end = int(lower.timestamp()), int(upper.timestamp())
                pieces, start, off = [], begin, at(begin)
                step = 14 * 86400
                for t in range(begin + step, end + step, step):
                    while at(t) != off:  # a change lies in (t - step, t]; halve down to its first second
                        a, b = max(start, t - step), t
                        while b - a > 1:
                            m = (a + b) // 2
                            a, b = (m, b) if at(m) == off else (a, m)
                        pieces.append((start, b, off))
                        start, off = b, at(b)
                pieces.append((start, end + step, off))
                local = [(a + o, b + o, o) for a, b, o in pieces]
                for year in range(FIRST_YEAR, LAST_YEAR + 1):
                    y0 = int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp()) - 2 * 86400
                    y1 = y0 + 370 * 86400
                    out.append((name, year, [{"from": a, "until": b, "off": o} for a, b, o in local if a < y1 and b > y0]))
            yield pd.DataFrame(out, columns=["tz_name", "year", "intervals"])

    return names.mapInPandas(rules, "tz_name string, year int, intervals array<struct<from: bigint, until: bigint, off: int>>")


def _number(value: Column) -> Column:
    """UTC seconds of a plain number, null unless one of its units falls into NUMBER_YEARS."""
    v = F.when(value.rlike(NUMBER), F.trim(value)).try_cast("decimal(38,9)")
    first, last = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (NUMBER_YEARS[0], NUMBER_YEARS[1] + 1))
    units = [F.floor(v / F.lit(k).cast("decimal(8,0)")).try_cast("bigint") for k in (1, 1_000, 1_000_000)]
    return F.coalesce(*[F.when((u >= first) & (u < last), u) for u in units])


def utc_seconds(df: DataFrame, value: str, source: str | None, hints: DataFrame, names: DataFrame) -> DataFrame:
    """df with utc_second bigint: the instant that the column value names, null where it names none.

    hints has (source, tz_name, day_order), names (abbr, offset_minutes). A zone in the value wins, whether
    offset, abbreviation or IANA name; else the zone of the row's source holds. A date alone is its midnight,
    fractions are cut off. A numeric day and month follow day_order ('mdy' or else day first). Values that are
    null, empty, relative or impossible, local times of unknown sources, and unknown zones give null. Hints and
    names given twice count once. The row count of df stays the same; its columns must not be called like those
    of this function's working columns, which begin with q__.
    """
    spark = df.sparkSession
    text = F.regexp_replace(F.col(value).cast("string"), COMPACT, "$1-$2-$3T$4:$5:$6")
    parts = F.split(F.when(text.rlike(FORM), F.regexp_replace(text, FORM, "|".join(f"${i}" for i in range(1, 18)))), r"\|", -1)
    rows = df.withColumn("q__p", parts).withColumn("q__source", F.col(source) if source else F.lit(None).cast("string"))
    clean_hints = hints.where("source is not null").groupBy(F.col("source").alias("q__s")).agg(F.min(F.struct("tz_name", "day_order")).alias("q__hint"))
    rows = rows.join(small_enough(clean_hints, MAX_HINTS), F.col("q__source") == F.col("q__s"), "left")
    g = lambda i: F.nullif(F.col("q__p")[i - 1], F.lit(""))
    number = lambda c: c.try_cast("int")
    name_month = lambda c: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(c, 1, 3))).cast("int")
    month_first = F.col("q__hint.day_order") == "mdy"
    known_order = F.col("q__hint.day_order").isNotNull()
    year = F.coalesce(number(g(1)), number(g(6)), number(g(9)), number(g(12)))
    month = F.coalesce(number(g(2)), F.when(known_order, F.when(month_first, number(g(4))).otherwise(number(g(5)))), name_month(g(8)), name_month(g(10)))
    day = F.coalesce(number(g(3)), F.when(known_order, F.when(month_first, number(g(5))).otherwise(number(g(4)))), number(g(7)), number(g(11)))
    half = F.lower(F.substring(g(16), 1, 1))
    raw_hour = number(g(13))
    hour = F.when(half.isNull(), raw_hour).when(raw_hour.between(1, 12), raw_hour % 12 + F.when(half == "p", 12).otherwise(0))
    no_time = g(13).isNull()
    minute, second = number(g(14)), F.coalesce(number(g(15)), F.lit(0))
    date = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")
    date = F.when(year.isNotNull() & month.isNotNull() & day.isNotNull() & (year > 0), date)
    clock = F.when(no_time, F.lit(0)).when(hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59), hour * 3600 + minute * 60 + second)
    rows = rows.withColumn("q__local", F.datediff(date, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + clock).withColumn("q__year", F.year(date))
    zone = F.regexp_replace(g(17), r"[\[\]]", "")
    numeric = F.regexp_extract(zone, r"^([+-])(\d{2}):?(\d{2})?$", 1)
    away = number(F.regexp_extract(zone, r"^[+-](\d{2})", 1)) * 3600 + F.coalesce(number(F.nullif(F.regexp_extract(zone, r"^[+-]\d{2}:?(\d{2})$", 1), F.lit(""))), F.lit(0)) * 60
    fixed = F.when(F.lower(zone) == "z", 0).when(numeric == "+", away).when(numeric == "-", -away)
    rows = rows.withColumn("q__fixed", fixed.cast("bigint")).withColumn("q__abbr", F.when(zone.isNotNull() & fixed.isNull(), F.upper(zone)))
    abbrs = names.where("abbr is not null and offset_minutes is not null").groupBy(F.upper("abbr").alias("q__a")).agg((F.min("offset_minutes") * 60).cast("bigint").alias("q__named"))
    rows = rows.join(small_enough(abbrs, MAX_HINTS), F.col("q__abbr") == F.col("q__a"), "left")
    fixed = F.coalesce("q__fixed", "q__named")
    # IANA names are compared in lower case, as values write them in any
    tz = F.when(fixed.isNotNull(), None).when(zone.isNotNull(), F.when(zone.contains("/"), F.lower(zone))).otherwise(F.lower(F.col("q__hint.tz_name")))
    rows = rows.withColumn("q__tz", F.when(F.col("q__local").isNotNull(), tz))
    intervals = offset_intervals(spark).select(F.lower("tz_name").alias("q__z"), F.col("year").alias("q__y"), "intervals").dropDuplicates(["q__z", "q__y"])
    rows = rows.join(F.broadcast(intervals), (F.col("q__tz") == F.col("q__z")) & (F.col("q__year") == F.col("q__y")), "left")
    local = F.col("q__local")
    holding = F.filter("intervals", lambda i: (i["from"] <= local) & (local < i["until"]))
    before = F.array_max(F.transform(F.filter("intervals", lambda i: i["until"] <= local), lambda i: F.struct(i["until"], i["off"].alias("off"))))["off"]
    ruled = F.when(F.size(holding) > 0, F.array_max(F.transform(holding, lambda i: i["off"]))).otherwise(before)
    return rows.select(*df.columns, F.coalesce(_number(F.col(value).cast("string")), local - F.coalesce(fixed, ruled.cast("bigint"))).alias("utc_second"))
