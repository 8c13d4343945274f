"""Helpers shared by the operators: reading tables, tables written once, Arrow mapping over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.session import scratch

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the cluster's shared folder, computed once and read from there.

    Lineage ends here: a lost executor costs a read, not the work before it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(text: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def fifth(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 5; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


#: Rows that a Python task gets at a time, at most: whole texts are long.
ROWS = 1000


def bounded(df: DataFrame) -> DataFrame:
    """The frame, after its session's Arrow batches were limited to ROWS rows, which bounds what workers hold."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS:
        conf.set(name, str(ROWS))
    return df


_kept: list = [None, None, None]


def kept(name: str, owner: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between batches for an operator and what it was sent; one such thing at a
    time, so that a worker that serves one operator after another doesn't hold the tables of all of them."""
    if _kept[0] != name or _kept[1] is not owner:
        _kept[:] = [None, None, None]
        _kept[:] = [name, owner, make()]
    return _kept[2]


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow whose function gives a dictionary of columns for each batch of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = each(batch)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

    return bounded(df).mapInArrow(run, schema)


def shared_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
