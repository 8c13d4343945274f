"""Bucketed tables: joins without a shuffle, opened again from their path, refusals."""

import pytest

from pyspark.sql import functions as F

from tidegate.session import scratch
from tidegate.sources import buckets
from tidegate.sources.sinks import AlreadyWritten


def rows(spark, n=500):
    return spark.range(n).select(F.col("id").alias("txn"), (F.col("id") * 7 % 13).alias("v"))


def test_join_and_aggregate_move_no_rows(spark):
    a, b = (buckets.write_bucketed(rows(spark, n), scratch(spark, "t"), "txn", 4) for n in (500, 300))
    joined = a.hint("merge").join(b.withColumnRenamed("v", "w"), "txn")
    assert buckets.exchanges(joined) == 0 and buckets.exchanges(a.groupBy("txn").agg(F.sum("v"))) == 0
    assert joined.count() == 300 and joined.where("v = w").count() == 300
    assert buckets.exchanges(rows(spark).hint("merge").join(rows(spark), "txn")) == 2


def test_tables_whose_numbers_divide_each_other(spark):
    a, b = (buckets.write_bucketed(rows(spark), scratch(spark, "t"), "txn", n) for n in (8, 4))
    both = a.hint("merge").join(b.withColumnRenamed("v", "w"), "txn")
    assert buckets.exchanges(both) <= 1 and both.where("v = w").count() == 500
    assert [buckets.buckets_for(x) for x in (0, 1, 512 << 20, (512 << 20) + 1, 5 << 30)] == [1, 1, 1, 2, 16]


def test_opened_from_its_path(spark):
    path = scratch(spark, "t")
    written = buckets.write_bucketed(rows(spark), path, "txn", 4)
    again = buckets.open_bucketed(spark, path)
    assert again.schema == written.schema and sorted(again.collect()) == sorted(written.collect())
    other = spark.newSession()
    there = buckets.open_bucketed(other, path)
    assert buckets.exchanges(there.hint("merge").join(there.select("txn", F.col("v").alias("w")), "txn")) == 0


def test_one_file_per_bucket(spark):
    found = buckets.write_bucketed(rows(spark), scratch(spark, "t"), "txn", 4)
    assert found.select(F.input_file_name().alias("f")).distinct().count() == 4


def test_null_keys_empty_tables_and_repeats(spark):
    odd = rows(spark, 20).unionByName(rows(spark, 20)).unionByName(rows(spark, 3).withColumn("txn", F.lit(None).cast("long")))
    found = buckets.write_bucketed(odd, scratch(spark, "t"), "txn", 4)
    assert sorted(map(str, found.collect())) == sorted(map(str, odd.collect()))
    path = scratch(spark, "t")
    buckets.write_bucketed(rows(spark, 0), path, "txn", 4)
    assert buckets.open_bucketed(spark, path).count() == 0


def test_refusals(spark):
    path = scratch(spark, "t")
    buckets.write_bucketed(rows(spark), path, "txn", 4)
    with pytest.raises(AlreadyWritten):
        buckets.write_bucketed(rows(spark), path, "txn", 4)
    with pytest.raises(buckets.HotKey):
        buckets.write_bucketed(rows(spark).withColumn("txn", F.lit(1)), scratch(spark, "t"), "txn", 4, most=100)
    with pytest.raises(ValueError):
        buckets.write_bucketed(rows(spark), scratch(spark, "t"), "txn", 0)
