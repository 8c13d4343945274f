"""Tables stored by key, so that joins and aggregates on it need no shuffle.

A table is dealt to a fixed number of buckets when it is written: one shuffle then, none in every later join
with a table of the same key and number. A manifest beside the data names key, number and schema; any session
opens the table from its path. Meant for keys without a hot value, such as transaction ids: a bucket is read by
one task, and `write_bucketed` refuses keys of which one value would fill more than a bucket's share.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidegate.sources.sinks import AlreadyWritten

BYTES_PER_BUCKET = 512 << 20


class HotKey(ValueError):
    """One value of the key holds more rows than a bucket should."""


def buckets_for(size: int) -> int:
    """A number of buckets for so many bytes, a power of two so that tables of several sizes divide each other."""
    return 1 << max(0, (max(size, 1) - 1) // BYTES_PER_BUCKET).bit_length()


def write_bucketed(rows: DataFrame, path: str, key: str, buckets: int, most: int = 1_000_000) -> DataFrame:
    """Write `rows` in buckets of `key`, sorted inside, one file each; the result reads them.

    Refuses a path in use (AlreadyWritten) and a key of which one value, null included, has over `most` rows
    (HotKey). The manifest is written last: a write that stopped half-way can not be opened."""
    spark = rows.sparkSession
    if buckets < 1:
        raise ValueError("at least one bucket")
    largest = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) > most:
        raise HotKey(f"{key} has a value with {largest} rows")
    name = f"tidegate_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, key)  # the hash of the buckets, hence one file each
    try:
        spark.read.text(f"{path}/manifest").take(1)
    except AnalysisException:
        pass
    else:
        raise AlreadyWritten(path)
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{path}/data").saveAsTable(name)
    manifest = json.dumps({"key": key, "buckets": buckets, "schema": json.loads(rows.schema.json())}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table at `path`, known to this session as bucketed, whichever session wrote it."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    schema = T.StructType.fromJson(manifest["schema"])
    name, quoted = f"tidegate_{uuid.uuid4().hex}", manifest["key"].replace("`", "``")
    columns = ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in schema.fields)
    location = f"{path}/data".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{quoted}`) SORTED BY (`{quoted}`)"
        f" INTO {int(manifest['buckets'])} BUCKETS LOCATION '{location}'"
    )
    return spark.table(name)


def exchanges(df: DataFrame) -> int:
    """Shuffles and broadcasts in the plan as it stands before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line.split("[")[0] for line in plan.splitlines())
