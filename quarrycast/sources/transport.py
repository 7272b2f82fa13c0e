"""Rules of fetching, as data: who may be fetched, when to try again, and captured responses by host.

Nothing here opens a connection; a fetcher outside writes responses into a table.
"""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# --- fixed values ---------------------------------------------------------------------------------------------
ATTEMPTS = 3
FIRST_WAIT = 1.0  #: seconds, doubled at each attempt
LONGEST_WAIT = 30.0  #: seconds that a server may ask for
# ---------------------------------------------------------------------------------------------------------------


def again(status: Column, attempt: Column) -> Column:
    """Whether a response is worth another attempt: no answer, 429, or 5xx, while attempts are left."""
    return (attempt < ATTEMPTS) & (status.isNull() | (status == 429) | status.between(500, 599))


def wait(attempt: Column, retry_after: Column) -> Column:
    """Seconds to wait after attempt 1, 2 ...: what the server asks for up to LONGEST_WAIT, else doubling; without jitter."""
    return F.coalesce(F.when(retry_after.try_cast("double").isNotNull(), F.least(retry_after.try_cast("double"), F.lit(LONGEST_WAIT))), F.lit(FIRST_WAIT) * F.pow(F.lit(2.0), attempt - 1))


def allowed(robots: Column, agent: str, url: Column) -> Column:
    """robots text lets agent fetch url; without a text all is allowed."""

    @F.pandas_udf(BooleanType())
    def rule(texts: pd.Series, urls: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}

        def one(t, u):
            if t is None or u is None:
                return u is not None
            if t not in parsers:
                parsers[t] = RobotFileParser()
                parsers[t].parse(t.splitlines())
            return parsers[t].can_fetch(agent, u)

        return pd.Series([one(t, u) for t, u in zip(texts, urls)])

    return rule(robots, url)


def by_host(requests: DataFrame, host: str, hosts_at_once: int) -> DataFrame:
    """requests in hosts_at_once partitions, all of one host in one of them, in order: one request at a time to each."""
    return requests.repartition(hosts_at_once, host).sortWithinPartitions(host)
