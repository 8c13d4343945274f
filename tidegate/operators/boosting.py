"""Boosted trees that learn where missing values go, grown for several settings in the same passes.

Values are binned once. A pass grows one level of the current tree of every setting: tasks sum gradients by
(setting, node, feature, bin) over their rows, the sums are added by one aggregate, and the best cut of each
node is chosen in the plan, with missing values tried on both sides. Only the chosen cuts reach the driver, one
row per node. Gradients are summed as whole numbers, so that for given bins a tree does not depend on how rows
are dealt to tasks. The bins are approximate quantiles, unless given.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators.features import FEATURES
from tidegate.session import written

BINS = 64  # bins of a feature; one more holds its missing values
REFRESH = 16  # trees after which margins are written anew, so that a pass looks at few trees
UNIT = float(1 << 24)  # gradients are summed in steps of 1 / UNIT
MAX_DEPTH = 10  # bounds the nodes of a level


@dataclass(frozen=True)
class Setting:
    depth: int = 3
    trees: int = 20
    positive_weight: float = 1.0


class Tree:
    """Nodes numbered by level from the root; `feature` is -1 at a leaf."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.feature = np.full(size, -1, np.int32)
        self.cut = np.zeros(size, np.int32)  # the last bin that goes left
        self.missing_left = np.zeros(size, bool)
        self.value = np.zeros(size)

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels."""
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            feature = self.feature[at]
            own = bins[row, np.maximum(feature, 0)]
            right = np.where(own < 0, ~self.missing_left[at], own > self.cut[at])
            at = np.where(feature >= 0, 2 * at + 1 + right, at)
        return at


@dataclass(frozen=True)
class BoostedModel:
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    trees: tuple[Tree, ...]
    depth: int
    base: float
    version: str

    def probabilities(self, bins: np.ndarray) -> np.ndarray:
        return sigmoid(self.base + sum((t.value[t.place(bins, self.depth)] for t in self.trees), np.zeros(len(bins))))

    def score(self) -> Column:
        return scores([self])[0]


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))


def binned(values: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin of each value: the number of edges below it; -1 for a missing one."""
    out = np.empty(values.shape, np.int8)
    for i, bounds in enumerate(edges):
        column = values[:, i]
        out[:, i] = np.where(np.isnan(column), -1, np.searchsorted(np.asarray(bounds, float), column, side="left"))
    return out


def scores(models: Sequence[BoostedModel]) -> Column:
    """The probabilities of models with the same inputs, as one array; rows are binned once."""
    features, edges = models[0].features, models[0].edges
    if any((m.features, m.edges) != (features, edges) for m in models):
        raise ValueError("models of one call share their features and bins")

    def each(*columns: pd.Series) -> pd.Series:
        bins = binned(np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns]), edges)
        return pd.Series(list(np.column_stack([m.probabilities(bins) for m in models])))

    each.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, "array<double>")(*[F.col(f).cast("double") for f in features])


def fit_edges(rows: DataFrame, features: Sequence[str]) -> tuple[tuple[float, ...], ...]:
    """Distinct approximate quantiles of each feature, at most BINS - 1, by one pass."""
    shares = [i / BINS for i in range(1, BINS)]
    cuts = rows.select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(list(features), shares, 1.0 / (4 * BINS))
    return tuple(tuple(sorted(set(c))) for c in cuts)


def drawn(rows: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Whether a tree learns from a row: by its hash, so that a task run again draws the same."""
    x = rows.astype(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (tree + 1) + seed) % 2**64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)).astype(float) / 2.0**53 < share


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _histograms(data, grown, columns, level, number, width, settings, seed, share) -> DataFrame:
    """(setting, node, feature, bin, g, h) of the open nodes of a level, one partial row per task."""
    base, slots = 2**level - 1, BINS + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            label, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bins, margins = _matrix(batch.column(2), width), _matrix(batch.column(3), len(settings))
            taken = drawn(rows, number, seed, share)
            label, bins, margins = label[taken], bins[taken], margins[taken]
            for k, trees in grown.items():
                margin = margins[:, k] + sum((t.value[t.place(bins, settings[k].depth)] for t in trees[:-1]), np.zeros(len(bins)))
                p, weight = sigmoid(margin), np.where(label == 1.0, settings[k].positive_weight, 1.0)
                g, h = np.rint(weight * (p - label) * UNIT), np.rint(weight * p * (1 - p) * UNIT)
                node = trees[-1].place(bins, level) - base
                here = node >= 0  # rows in a leaf of an earlier level need no sums
                for f in columns:
                    at = node[here] * slots + bins[here, f] + 1
                    held = sums.setdefault((k, f), np.zeros((2, slots * 2**level), np.int64))
                    held[0] += np.bincount(at, g[here], held.shape[1]).astype(np.int64)
                    held[1] += np.bincount(at, h[here], held.shape[1]).astype(np.int64)
        for (k, f), (g, h) in sums.items():
            at = np.nonzero((g != 0) | (h != 0))[0]
            whole = [pa.array(np.full(len(at), v, np.int32)) for v in (k, f)]
            cells = [pa.array((at // slots + base).astype(np.int32)), pa.array((at % slots - 1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*whole, *cells, pa.array(g[at]), pa.array(h[at])], ["setting", "feature", "node", "bin", "g", "h"])

    parts = data.mapInArrow(each, "setting int, feature int, node int, bin int, g long, h long")
    return parts.groupBy("setting", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_cuts(sums: DataFrame, penalty: float, least: float) -> DataFrame:
    """One row per (setting, node): its sums `g` and `h`, and the cut of highest gain as `best` (null: none).

    Ties go to the lower feature, the lower cut, and missing values to the left."""
    cells = Window.partitionBy("setting", "node", "feature")
    upto = cells.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    present = F.col("bin") >= 0
    whole = [F.sum(n).over(cells).alias(f"all_{n}") for n in "gh"]
    before = [F.sum(F.when(present, F.col(n)).otherwise(0)).over(upto).alias(f"l{n}") for n in "gh"]
    missing = [F.sum(F.when(~present, F.col(n)).otherwise(0)).over(cells).alias(f"m{n}") for n in "gh"]
    out = sums.select("*", *whole, *before, *missing)
    for n in ("all_g", "all_h", "lg", "lh", "mg", "mh"):
        out = out.withColumn(n, F.col(n) / F.lit(UNIT))
    out = out.withColumn("missing_left", F.explode(F.array(F.lit(True), F.lit(False))))
    for n in "gh":
        out = out.withColumn(f"left_{n}", F.col(f"l{n}") + F.when(F.col("missing_left"), F.col(f"m{n}")).otherwise(0.0))
        out = out.withColumn(f"right_{n}", F.col(f"all_{n}") - F.col(f"left_{n}"))
    part = lambda side: F.col(f"{side}_g") * F.col(f"{side}_g") / (F.col(f"{side}_h") + penalty)
    gain = part("left") + part("right") - part("all")
    kept = present & (F.col("left_h") >= least) & (F.col("right_h") >= least) & (F.col("right_h") > 0) & (F.col("left_h") > 0) & (gain > 1e-9)
    best = F.struct(
        gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("cut"), "missing_left", "left_g", "left_h", "right_g", "right_h"
    )
    return out.groupBy("setting", "node").agg(F.max("all_g").alias("g"), F.max("all_h").alias("h"), F.max(F.when(kept, best)).alias("best"))


def fit_boosted(
    rows: DataFrame,
    settings: Sequence[Setting] = (Setting(),),
    features: Sequence[str] = FEATURES,
    label: str = "is_fraud",
    step: float = 0.1,
    subsample: float = 0.8,
    columns: float = 0.8,
    least: float = 1.0,
    penalty: float = 1.0,
    seed: int = 0,
    edges: tuple[tuple[float, ...], ...] | None = None,
) -> list[BoostedModel]:
    """One model per setting, from depth * trees passes of the largest setting, whatever their number.

    Settings that differ only in their number of trees share them. `subsample` of the rows and `columns` of the
    features are drawn for a tree (equal rows alike); `least` is the least sum of second derivatives in a child. Null and NaN
    inputs are missing; rows with a null label are left out; without rows of both classes no tree is grown
    and every score is the share of the one class (0.5 without rows)."""
    if any(not 1 <= s.depth <= MAX_DEPTH for s in settings):
        raise ValueError(f"depths lie between 1 and {MAX_DEPTH}")
    features = tuple(features)
    clean = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f) for f in features]
    rows = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), *clean)
    rows = rows.select("label", F.xxhash64(F.lit(seed), *features).alias("row"), *features)
    rows = written(rows, "boosting-input")
    edges = edges or fit_edges(rows, features)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    p, n = counts.get(1.0, 0), counts.get(0.0, 0)
    shared = {}  # (depth, weight) -> most trees
    for s in settings:
        shared[s.depth, s.positive_weight] = max(s.trees, shared.get((s.depth, s.positive_weight), 0))
    kinds = [Setting(d, t, w) for (d, w), t in shared.items()]
    bases = [float(np.log(w * p / n)) if p and n else (0.0 if p == n else np.copysign(500.0, p - n)) for w in (k.positive_weight for k in kinds)]
    grown: list[list[Tree]] = [[] for _ in kinds]

    def first(batches):
        for batch in batches:
            values = np.column_stack([batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))])
            bins = binned(values, edges)
            whole = pa.ListArray.from_arrays(np.arange(len(bins) + 1, dtype=np.int32) * len(features), pa.array(bins.ravel()))
            margins = pa.ListArray.from_arrays(np.arange(len(bins) + 1, dtype=np.int32) * len(kinds), pa.array(np.tile(bases, len(bins))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), whole, margins], ["label", "row", "bins", "margins"])

    shape = "label double, row long, bins array<tinyint>, margins array<double>"
    data = written(rows.mapInArrow(first, shape), "boosting") if p and n else None
    done, rng = 0, np.random.default_rng(seed)
    for number in range(max((k.trees for k in kinds), default=0) if p and n else 0):
        chosen = sorted(rng.permutation(len(features))[: max(1, round(columns * len(features)))].tolist())
        active = [k for k, kind in enumerate(kinds) if number < kind.trees]
        for k in active:
            grown[k].append(Tree(kinds[k].depth))
        open_nodes = set(active)
        for level in range(max(kinds[k].depth for k in active)):
            at = {k: grown[k][done:] for k in active if k in open_nodes and kinds[k].depth > level}
            if not at:
                break
            sums = _histograms(data, at, chosen, level, number, len(features), kinds, seed, subsample)
            open_nodes = set()
            for r in best_cuts(sums, penalty, least).collect():
                tree, node, best = grown[r["setting"]][-1], r["node"], r["best"]
                if level and tree.feature[(node - 1) // 2] < 0:
                    continue
                tree.value[node] = -step * r["g"] / (r["h"] + penalty)
                if best is None:
                    continue
                open_nodes.add(r["setting"])
                tree.feature[node], tree.cut[node], tree.missing_left[node] = -best["feature"], -best["cut"], best["missing_left"]
                for child, side in ((2 * node + 1, "left"), (2 * node + 2, "right")):
                    tree.value[child] = -step * best[f"{side}_g"] / (best[f"{side}_h"] + penalty)
        if (number + 1) % REFRESH == 0:
            data, done = written(_with_margins(data, [g[done:] for g in grown], kinds, len(features), shape), "boosting"), number + 1
    models = []
    for s in settings:
        k = list(shared).index((s.depth, s.positive_weight))
        name = f"boosted-d{s.depth}-n{s.trees}-w{s.positive_weight}"
        models.append(BoostedModel(features, edges, tuple(grown[k][: s.trees]), s.depth, bases[k], name))
    return models


def _with_margins(data: DataFrame, grown: list[list[Tree]], kinds: list[Setting], width: int, shape: str) -> DataFrame:
    def each(batches):
        for batch in batches:
            bins, margins = _matrix(batch.column(2), width), _matrix(batch.column(3), len(kinds)).copy()
            for k, trees in enumerate(grown):
                for tree in trees:
                    margins[:, k] += tree.value[tree.place(bins, kinds[k].depth)]
            lists = pa.ListArray.from_arrays(np.arange(len(bins) + 1, dtype=np.int32) * len(kinds), pa.array(margins.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["label", "row", "bins", "margins"])

    return data.mapInArrow(each, shape)
