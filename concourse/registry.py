"""All registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Up to which size a side of a join is broadcast, by its files and as measured at run time.
FILED, MEASURED = 128 << 10, 8 << 20


def broadcast_by_size(spark: SparkSession) -> None:
    """Broadcast what is small when it is met, where the session doesn't say what is.

    The size of files says little of the rows made of them: cells dealt to the squares of a grid take three hundred
    times the room of the compressed parts that they come from, and all of that would go through the driver.
    """
    for key, most in (("spark.sql.autoBroadcastJoinThreshold", FILED), ("spark.sql.adaptive.autoBroadcastJoinThreshold", MEASURED)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query under the name of its operator, with equal SQL if there is any."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            broadcast_by_size(spark)
            return f(spark, d)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return keep


for family in ("geometry", "joins", "elements", "graphs", "buildings", "rules", "aggregates", "windows", "scalars", "sources", "streams"):
    import_module(f"concourse.plans.{family}")
