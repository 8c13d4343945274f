"""Joins on keys that may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast, at most: a key is hot above a ten-thousandth of the rows (and LEAST of them).
MOST_HOT = 10_000
LEAST = 2_000


def hot_limit(table: DataFrame, n: str, least: int = LEAST) -> int:
    """Rows above which a key of `table` is hot; at most MOST_HOT keys are."""
    return max(least, (table.agg(F.sum(n)).first()[0] or 0) // MOST_HOT)


def matched(rows: DataFrame, table: DataFrame, keys: Sequence[str], n: str, how: str = "inner", least: int = LEAST) -> DataFrame:
    """`rows` joined with `table`, which has one row per key; `n` of the table counts the key's rows.

    Rows of hot keys stay where they are and meet a broadcast of the hot part of the table, at most
    MOST_HOT entries by the rule above; the others are joined by a shuffle, where no key has more than
    `least` rows or a ten-thousandth of all. Null keys match nothing. Both frames are read several times, so they
    should be written tables or cheap scans."""
    limit = hot_limit(table, n, least)
    hot = table.where(F.col(n) > limit)
    if hot.isEmpty():
        return rows.join(table, list(keys), how)
    mark = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    marked = rows.join(mark, list(keys), "left")
    heavy = marked.where("_hot").drop("_hot").join(F.broadcast(hot), list(keys))
    rest = marked.where("_hot is null").drop("_hot").join(table.where(F.col(n) <= limit), list(keys), how)
    return heavy.unionByName(rest)
