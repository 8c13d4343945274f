"""Boosted trees against brute force, and the grid of linear models against single fits."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidegate.operators import boosting, fitting
from tidegate.operators.boosting import Setting, fit_boosted
from tidegate.operators.scoring import Preprocessing, fit_preprocessing

PLAIN = Preprocessing(features=("a", "b"), nullable=(), log1p=())


def data(spark, n=3000, parts=4, seed=1):
    """The label is set where exactly one of `a missing` and `b > 0` holds; an imputed value needs more cuts."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": range(n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    gone = rng.random(n) < 0.3
    pdf.loc[gone, "a"] = np.nan
    pdf["is_fraud"] = gone ^ (pdf.b > 0)
    df = spark.createDataFrame(pdf).repartition(parts)
    return df.withColumn("a", F.nanvl("a", F.lit(None).cast("double"))).checkpoint()


def errors(df, score):
    return df.select((F.col("is_fraud") != (score >= 0.5)).alias("e")).agg(F.avg(F.col("e").cast("int"))).first()[0]


def test_missing_values_are_routed_better_than_imputed_ones(spark):
    train, later = data(spark), data(spark, seed=2)
    (model,) = fit_boosted(train, [Setting(2, 2)], ("a", "b"), step=0.5, columns=1.0)
    routed = errors(later, model.score())
    prep = fit_preprocessing(train, PLAIN)
    imputed = fitting.fit_trees(train, depth=2, trees=2, step=0.5, prep=prep).apply(later)
    assert routed <= 0.02 and errors(imputed, F.col("score")) >= 5 * max(routed, 0.01)


def test_nan_and_null_are_both_missing(spark):
    train = data(spark, 500)
    (model,) = fit_boosted(train, [Setting(2, 3)], ("a", "b"), columns=1.0)
    nan = train.withColumn("a", F.coalesce("a", F.lit(float("nan"))))
    (other,) = fit_boosted(nan, [Setting(2, 3)], ("a", "b"), columns=1.0, edges=model.edges)
    a, b = (sorted((r.id, r.s) for r in df.select("id", m.score().alias("s")).collect()) for df, m in ((train, model), (nan, other)))
    assert a == b


def test_trees_do_not_depend_on_partitions_or_on_other_settings(spark):
    few, many = data(spark, 800, 1), data(spark, 800, 7)
    alone = fit_boosted(few, [Setting(2, 4, 3.0)], ("a", "b"))[0]
    grid = fit_boosted(many, [Setting(3, 2), Setting(2, 2, 3.0), Setting(2, 4, 3.0)], ("a", "b"), edges=alone.edges)
    for tree, same in zip(alone.trees, grid[2].trees, strict=True):
        for name in ("feature", "cut", "missing_left", "value"):
            assert np.array_equal(getattr(tree, name), getattr(same, name))
    assert len(grid[1].trees) == 2 and grid[1].trees[0] is grid[2].trees[0]


def test_margins_written_anew_change_nothing(spark, monkeypatch):
    train = data(spark, 400)
    usual = fit_boosted(train, [Setting(2, 5)], ("a", "b"))[0]
    monkeypatch.setattr(boosting, "REFRESH", 2)
    often = fit_boosted(train, [Setting(2, 5)], ("a", "b"))[0]
    assert all(np.array_equal(x.feature, y.feature) and np.allclose(x.value, y.value) for x, y in zip(usual.trees, often.trees, strict=True))


def test_root_cut_is_the_best_of_all(spark):
    df = data(spark, 600)
    (model,) = fit_boosted(df, [Setting(1, 1)], ("a", "b"), subsample=1.0, columns=1.0)
    pdf = df.toPandas()
    bins = boosting.binned(pdf[["a", "b"]].to_numpy(float), model.edges)
    y = pdf.is_fraud.to_numpy(float)
    p = 1 / (1 + np.exp(-model.base))
    g, h, best = p - y, np.full(len(y), p * (1 - p)), []
    for f in (0, 1):
        for cut in range(boosting.BINS):
            for left in (True, False):
                side = np.where(bins[:, f] < 0, left, bins[:, f] <= cut)
                if min(h[side].sum(), h[~side].sum()) < 1:
                    continue
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (side, ~side)) - g.sum() ** 2 / (h.sum() + 1)
                best.append((round(gain, 4), -f, -cut, left))
    tree = model.trees[0]
    top = max(best)
    assert (tree.feature[0], tree.cut[0], bool(tree.missing_left[0])) == (-top[1], -top[2], top[3])


@pytest.mark.parametrize("where, expected", [("false", 0.5), ("is_fraud", 1.0), ("not is_fraud", 0.0)])
def test_one_class_or_no_rows(spark, where, expected):
    df = data(spark, 100)
    (model,) = fit_boosted(df.where(where), [Setting()], ("a", "b"))
    assert not model.trees and {round(r.s, 9) for r in df.select(model.score().alias("s")).collect()} == {expected}
    (linear,) = fitting.fit_linear_grid(df.where(where), [(1.0, True)], fit_preprocessing(df, PLAIN))
    assert {r.s for r in df.select(linear.score().alias("s")).collect()} == {expected}


def test_null_labels_and_missing_columns(spark):
    df = data(spark, 300)
    odd = df.unionByName(df.withColumn("is_fraud", F.lit(None).cast("boolean"))).withColumn("c", F.lit(None).cast("double"))
    a = fit_boosted(df.withColumn("c", F.lit(None).cast("double")), [Setting(2, 2)], ("a", "b", "c"))[0]
    b = fit_boosted(odd, [Setting(2, 2)], ("a", "b", "c"))[0]
    assert all(np.array_equal(x.value, y.value) for x, y in zip(a.trees, b.trees, strict=True)) and a.edges[2] == ()
    with pytest.raises(ValueError):
        fit_boosted(df, [Setting(0, 1)], ("a", "b"))


def test_linear_grid_equals_single_fits(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=1500), "b": rng.exponential(size=1500)})
    pdf["is_fraud"] = rng.random(1500) < 1 / (1 + np.exp(3 - pdf.a - 0.5 * pdf.b))
    df = spark.createDataFrame(pdf).repartition(3).checkpoint()
    prep = fit_preprocessing(df, PLAIN)
    grid = [(c, b) for c in (0.01, 1.0, 100.0) for b in (False, True)]
    for (c, balanced), model in zip(grid, fitting.fit_linear_grid(df, grid, prep), strict=True):
        one = fitting.fit_linear(df, c, balanced, prep)
        assert model.version == one.version and abs(model.intercept - one.intercept) < 1e-4
        assert all(abs(model.coefficients[k] - v) < 1e-4 for k, v in one.coefficients.items())


def test_linear_grid_takes_the_passes_of_its_slowest_setting(spark, monkeypatch):
    df = data(spark, 500).fillna({"a": 0.0})
    prep, calls, inner = fit_preprocessing(df, PLAIN), [], fitting._newton_sums
    monkeypatch.setattr(fitting, "_newton_sums", lambda *args: calls.append(len(args[1])) or inner(*args))
    alone = []
    grid = [(0.001, False), (1.0, False), (1000.0, True)]
    for pair in grid:
        calls.clear()
        fitting.fit_linear_grid(df, [pair], prep)
        alone.append(len(calls))
    calls.clear()
    fitting.fit_linear_grid(df, grid, prep)
    assert len(calls) == max(alone) <= 30
