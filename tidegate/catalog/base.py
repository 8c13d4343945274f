"""Registry of named queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.fixtures import with_tables
from tidegate.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DAY_US = 86_400_000_000


def query(name: str, oracle: str | None = None, tables: tuple[str, ...] = (), extra: dict[str, str] | None = None):
    """Register a query; `oracle` is the body of its SQL over the derived `tables`."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(prepare(spark), folder)

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_tables(*tables, body=oracle, extra=extra) if tables or extra else oracle
        return build

    return register


def r9(column: Column | str, name: str | None = None) -> Column:
    """Nine digits: sums of doubles depend on their order in the last digits."""
    value = F.round(F.col(column) if isinstance(column, str) else column, 9)
    return value.alias(name or column)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[r9(c) if c in columns else F.col(c) for c in df.columns])
