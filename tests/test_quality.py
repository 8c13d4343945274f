"""Sources, sinks, digests, comparisons, neighbourhoods and the text scan."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import functions as F

from tidegate import schemas
from tidegate.operators import compare, fitting, quality, scoring, spatial
from tidegate.operators.features import FEATURES
from tidegate.operators.splits import guarded
from tidegate.session import scratch
from tidegate.sources import readers, sinks


def test_write_once_and_verify(spark):
    rows, path = spark.range(100).withColumn("v", F.col("id") * 2), scratch(spark, "t")
    sinks.write_once(rows, path, source_digest="s")
    with pytest.raises(sinks.AlreadyWritten):
        sinks.write_once(rows, path)
    assert readers.verify(spark, path) == []
    assert readers.scan_derived(spark, path, "s").count() == 100
    with pytest.raises(readers.DatasetMismatch):
        readers.scan_derived(spark, path, "other")
    rows.limit(99).write.mode("overwrite").parquet(f"{path}/data")
    assert len(readers.verify(spark, path)) == 2


def test_digest_ignores_order_but_not_content(spark):
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    digest = lambda df: quality.content_hash(df).first()["digest"]
    assert digest(rows) == digest(rows.orderBy(F.desc("id")).repartition(5))
    assert digest(rows) != digest(rows.withColumn("v", F.when(F.col("id") == 5, 9).otherwise(F.col("v"))))
    assert digest(rows) != digest(rows.union(rows.limit(1)))


def test_schema_is_checked_before_execution(spark):
    with pytest.raises(schemas.SchemaMismatch):
        schemas.validate(spark.range(3), schemas.TXN_EVENT)


def test_batches_insert_each_id_once(spark):
    path = scratch(spark, "ins")
    stored = spark.createDataFrame([("a", "h1")], "id string, h string")
    batch = spark.createDataFrame(
        [(0, "a", "h1"), (1, "a", "h2"), (2, "b", "h1"), (3, "b", "h1"), (4, "b", "h3"), (5, "c", "h1")], "n long, id string, h string"
    )
    verdicts = sinks.classify_inserts(batch, stored, "id", "h", ["n"]).checkpoint()
    got = {r["n"]: r["verdict"] for r in verdicts.collect()}
    assert got == {0: "replay", 1: "conflict", 2: "new", 3: "replay", 4: "conflict", 5: "new"}
    for _ in range(2):
        sinks.insert_new(verdicts, f"{path}/batch=0")
    assert spark.read.parquet(path).count() == 2


def test_reviews_of_unknown_decisions_are_refused(spark):
    decisions = spark.createDataFrame([("t1",)], "transaction_id string")
    review = lambda t: spark.createDataFrame([(1, t, "open", None, None, "a", 1)], schemas.REVIEWS)
    path = scratch(spark, "rev")
    sinks.append_reviews(review("t1"), decisions, path)
    with pytest.raises(sinks.InvalidReview):
        sinks.append_reviews(review("t2"), decisions, path)
    assert spark.read.parquet(path).count() == 1


def test_csv_keeps_text_until_it_is_cast(spark):
    path = scratch(spark, "csv")
    spark.createDataFrame([("007", "1.50"), ("8", "x")], "a string, b string").write.option("header", True).csv(path)
    got = {r["a"]: r["b"] for r in readers.csv_source(spark, path, ["a", "b"]).collect()}
    assert got == {"007": "1.50", "8": "x"}


def test_guards_fail_inside_the_plan(spark):
    rows = spark.createDataFrame([(1,), (5,)], "decision_us long")
    assert guarded(rows, F.lit(6)).count() == 2
    with pytest.raises(PySparkException):
        guarded(rows, F.lit(5)).collect()


def test_cells_differ_as_text_and_as_numbers(spark):
    a = spark.createDataFrame([(1, "1.0", "x"), (2, "2.0", "x"), (3, None, "x")], "k long, v string, w string")
    b = spark.createDataFrame([(1, "1.00", "x"), (2, "3.0", "y"), (3, None, "x")], "k long, v string, w string")
    got = {r["column"]: (r["text_differences"], r["number_differences"]) for r in quality.cell_differences(a, b, "k", ["v", "w"]).collect()}
    assert got == {"v": (2, 1), "w": (1, 0)}
    assert tuple(compare.same_rows(a, a).first()) == (0, 0)
    assert tuple(compare.same_rows(a, a.union(a.limit(1))).first()) == (0, 1)


@pytest.mark.parametrize("cells,limit", [(1, 10**6), (4, 10**6), (2, 3)])
def test_near_counts_against_brute_force(spark, cells, limit):
    rng = np.random.default_rng(7)
    homes = pd.DataFrame(dict(id=range(300), x=rng.integers(0, 60, 300) / 2, y=rng.integers(0, 60, 300) / 2))
    shops = pd.DataFrame(dict(id=range(400), x=rng.integers(0, 60, 400) / 2, y=rng.integers(0, 60, 400) / 2))
    homes.loc[:99, ["x", "y"]] = 10.0
    shops.loc[:149, ["x", "y"]] = [12.0, 10.0]
    got = spatial.near_counts(spark.createDataFrame(homes), spark.createDataFrame(shops), "id", 2.0, cells, limit, 4).toPandas().set_index("id").near
    for r in homes.itertuples():
        assert got[r.id] == (np.hypot(shops.x - r.x, shops.y - r.y) <= 2.0).sum()


def test_calendar_flags_do_not_multiply_rows(spark):
    rows = spark.createDataFrame([("a", d) for d in range(10)] + [("b", 3)], "e string, day long")
    calendar = spark.createDataFrame([("a", 2), ("a", 3), ("a", 3)], "e string, day long")
    got = spatial.in_calendar(rows, calendar, "e", "day", 3, "hit").collect()
    assert len(got) == 11
    assert sorted(r["day"] for r in got if r["hit"]) == [2, 3, 4, 5]


TEXTS = [
    ("logs are below /home/mira.k/out", {"home_path"}),
    ("open D:\\Users\\tomas\\notes.txt", {"home_path"}),
    ("a route such as api/home/page", set()),
    ("write to mira_k@post.invalid.net today", {"email"}),
    ("write to mira_k@mail.example.net today", set()),
    ("-----BEGIN EC PRIVATE KEY-----", {"private_key"}),
    ("key AKIA" + "Q7" * 8 + " was used", {"token"}),
    ("ghs_" + "b4" * 18, {"token"}),
    ("bound to 172.20.0.9, not 172.40.0.9", {"private_ip"}),
    ("172.40.0.9 and 9.9.9.9", set()),
    ("reach printer-2.lan", {"host_name"}),
    ("DB_PASSWORD=qwertz-77", {"credential"}),
    ("password: short", set()),
    ("12345+mira-k@users.noreply.github.com.", {"github_noreply"}),
    ("push by 7+x@users.noreply.github.com and y.z@post.invalid", {"github_noreply", "email"}),
    ("key sk-" + "a1" * 10, {"token"}),
    ("sent ghp_" + "Zz9" * 10 + " and xoxb-1234567890", {"token"}),
    ("eyJ" + "hbGci" * 4 + ".c2lnbmF0dXJl", {"token"}),
    ("risk-" + "a" * 30 + " task-eyJx", set()),
    ("annas-MacBook-Pro and toms-iMac", {"host_name"}),
    ("db1.internal, api.internal.invalid", {"host_name"}),
    ("api.internal.invalid", set()),
    ("c:\\users\\bob is not, c:\\Users\\bob\\x is", {"home_path"}),
    ("PASSWORD=abc123", {"credential"}),
    ("my_apikey_2 = 'abcdef'; token:123", {"credential"}),
    ("the token was abcdef and x: abcdefg", set()),
    (".mira@post.invalid.", {"email"}),
    ("-----BEGIN PUBLIC KEY-----", set()),
    ("-----BEGIN PRIVATE KEY-----", {"private_key"}),
    (None, set()),
    ("", set()),
    ("Secret Person here", {"personal_term"}),
]


def test_text_categories(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    found = quality.sensitive_lines(df, "doc_id", "text", terms=["secret person"]).collect()
    got = {i: {r["category"] for r in found if r["doc_id"] == i} for i in range(len(TEXTS))}
    assert got == {i: want for i, (_, want) in enumerate(TEXTS)}
    long = spark.createDataFrame([(0, "x " * 30000 + "\n10.0.0.1\r\n10.0.0.2\n")], "doc_id long, text string")
    assert [(r["category"], r["lines"]) for r in quality.sensitive_lines(long, "doc_id", "text").collect()] == [("private_ip", 2)]


@pytest.mark.parametrize("piece", ["a", "a.", "a@", "1+", "eyJ", "-eyJ", "token", "token=", "/home/", "10.", "-----BEGIN ", "a@b.", "s-", "\\", "x:"])
def test_a_long_line_is_read_once(spark, piece):
    df = spark.createDataFrame([(0, piece * (200_000 // len(piece)))], "doc_id long, text string")
    quality.sensitive_lines(df.limit(0), "doc_id", "text").collect()
    started = time.perf_counter()
    quality.sensitive_lines(df, "doc_id", "text").collect()
    assert time.perf_counter() - started < 3  # a second for the scan, the rest for planning on a busy machine


def features(spark, n=400):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({f: rng.integers(0, 50, n).astype(float) for f in FEATURES})
    pdf.loc[::3, list(scoring.NULLABLE)] = None
    pdf["is_fraud"] = rng.random(n) < pdf.amount_minor / 60
    df = spark.createDataFrame(pdf)
    return df.select(*[F.nanvl(F.col(f), F.lit(None).cast("double")).alias(f) for f in FEATURES], "is_fraud").checkpoint(), pdf


def test_preprocessing_of_no_rows(spark):
    df, _ = features(spark, 3)
    prep = scoring.fit_preprocessing(df.limit(0))
    assert set(prep.means.values()) == {0.0} and set(prep.scales.values()) == {1.0}


def test_preprocessing_and_score_match_numpy(spark):
    df, pdf = features(spark)
    prep = scoring.fit_preprocessing(df)
    raw = pdf[list(FEATURES)].fillna(pdf[list(FEATURES)].median())
    for f in scoring.LOG1P:
        raw[f] = np.log1p(raw[f])
    for f in scoring.NULLABLE:
        raw[f"{f}__missing"] = pdf[f].isna().astype(float)
    assert np.allclose([prep.means[c] for c in raw], raw.mean()) and np.allclose([prep.scales[c] for c in raw], raw.std(ddof=0))
    model = fitting.fit_linear(df, c=1.0, prep=prep)
    z = ((raw - raw.mean()) / raw.std(ddof=0)) @ np.array([model.coefficients[c] for c in raw]) + model.intercept
    got = df.select(model.score().alias("s")).toPandas().s
    assert np.abs(got - 1 / (1 + np.exp(-z))).max() <= 1e-12
    assert got[pdf.is_fraud].mean() > got[~pdf.is_fraud].mean()
    assert tuple(scoring.violations(df).first()) == (0, 0)


def test_balanced_weights(spark):
    rows = spark.createDataFrame([(1.0,)] * 2 + [(0.0,)] * 8, "label double")
    weighted, total = fitting.class_weights(rows, True)
    got = {r["label"]: r["weight"] for r in weighted.collect()}
    assert got == {1.0: 2.5, 0.0: 0.625} and total == 10.0


def test_sketches_of_parts_answer_for_the_whole(spark):
    from tidegate.operators import operations

    rows = spark.range(30_000).select((F.col("id") % 10).alias("day"), (F.col("id") % 20_000).alias("v"), F.lit("a").alias("k"))
    rows = rows.unionByName(spark.createDataFrame([(1, None, "b"), (1, None, "b")], "day long, v long, k string"))
    days = operations.distinct_sketches(rows, ["k", "day"], "v")
    got = {r["k"]: r["distinct_values"] for r in operations.merged_sketches(days, ["k"]).collect()}
    assert abs(got["a"] - 20_000) <= 0.04 * 20_000 and got["b"] == 0
    assert operations.merged_sketches(days.limit(0), ["k"]).count() == 0
