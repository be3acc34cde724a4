"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "agg15_hourly_rollup"


def query(sql: str | None = None, **types: str) -> Callable:
    """Register a function of Views under its name, with the SQL that gives the same rows.

    ``types`` casts columns of the SQL, whose sums of integers are wider than Spark's.
    """

    def register(function: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[function.__name__] = lambda spark, sf_dir: function(Views(spark, sf_dir))
        if sql:
            text = with_views(sql)
            casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in types.items())
            SQL[function.__name__] = f"SELECT * REPLACE ({casts}) FROM ({text})" if casts else text
        return function

    return register


from . import catalogs, conversations, products, requests, streams, texts  # noqa: E402, F401  they register their queries
