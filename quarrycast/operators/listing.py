"""The ranked job listing: one filter object for listing, count and export."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrycast.operators.state import canonical_of

ISO = "%Y-%m-%dT%H:%M:%S+00:00"
COLUMNS = ["id", "company", "title", "location", "url", "source", "comp_model", "pay_min", "pay_max", "pay_currency", "auth_required", "hires_in_india", "seen"]


def like_any(c: Column, needle: str) -> Column:
    """c holds needle, whatever the case; % and _ in it are wildcards, nothing else is."""
    return F.lower(c).like("%" + needle.lower().replace("\\", "\\\\") + "%")


@dataclass(frozen=True)
class JobFilter:
    """What the listing shows; the empty filter shows all but linked duplicates."""

    company: str = ""
    title: str = ""
    india_only: bool = False
    remote_only: bool = False
    since: datetime | None = None
    include_duplicates: bool = False
    limit: int = 0  #: a feature of the report; 0 lists all

    def rows(self, jobs: DataFrame, companies: DataFrame) -> DataFrame:
        """The rows that match, unordered. jobs may lack canonical_id, which is then derived."""
        j = (jobs if "canonical_id" in jobs.columns else jobs.withColumn("canonical_id", F.lit(None).cast("bigint"))).alias("j")
        c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
        out = j.join(c, "company_id")
        if not self.include_duplicates:
            out = out.where("canonical_id is null")
        if self.company:
            out = out.where(like_any(F.col("company"), self.company))
        if self.title:
            out = out.where(like_any(F.col("title"), self.title))
        if self.india_only:
            out = out.where("hires_in_india = 1")
        if self.remote_only:
            out = out.where("remote = 1")
        seen = F.coalesce("first_seen_at", "seen_at")
        if self.since:
            out = out.where(seen >= self.since.strftime(ISO))
        return out.withColumn("seen", seen).select(*COLUMNS)

    def ranked(self, jobs: DataFrame, companies: DataFrame) -> DataFrame:
        """The listing in its order; the limit becomes a top-k."""
        out = self.rows(jobs, companies).orderBy(*order())
        return out.limit(self.limit) if self.limit else out

    def count(self, jobs: DataFrame, companies: DataFrame) -> DataFrame:
        """How many rows match, the limit left aside."""
        return replace(self, limit=0).rows(jobs, companies).agg(F.count("*").alias("n"))


def order() -> list[Column]:
    """Gated roles last, open geography first, newest first; unknown counts as no."""
    return [F.coalesce("auth_required", F.lit(0)).asc(), (F.coalesce("hires_in_india", F.lit(0)) == 1).desc(), F.col("seen").desc_nulls_last(), F.col("id").desc()]


def rank(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """df with the position of each row, by range partitions instead of one task for a global window.

    Rows are range-partitioned on the keys and numbered inside their partition; the sizes of the partitions
    before (one number each) are added.
    """
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank__p", F.spark_partition_id())
    # both uses of placed must see one partitioning: it is cut, not computed twice
    from quarrycast.runtime import cut

    placed = cut(placed)
    sizes = placed.groupBy("rank__p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("rank__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = placed.withColumn("rank__i", F.row_number().over(Window.partitionBy("rank__p").orderBy(*keys)))
    return inside.join(F.broadcast(before), "rank__p").withColumn(name, (F.col("before") + F.col("rank__i")).cast("bigint")).drop("before", "rank__i", "rank__p")


def flags(separator: str = " ", india: str = "IN", gated: str = "AUTH") -> Column:
    """The signals of a job as a short text."""
    model = F.when(~F.coalesce("comp_model", F.lit("unknown")).isin("", "unknown"), F.col("comp_model"))
    return F.concat_ws(separator, F.when(F.col("hires_in_india") == 1, india), F.when(F.col("auth_required") == 1, gated), model)


def with_canonical(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """jobs with canonical_id by the duplicate rule."""
    return canonical_of(jobs, companies)
