"""Linear scoring as column expressions, and the fit of its preprocessing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.scalars import or_zero, sigmoid
from tidegate.operators.features import FEATURES
from tidegate.plans.quantiles import exact_percentiles

# Fixed values of the linear model's input.
NULLABLE = (
    "cust_amount_mean_7d",
    "cust_amount_mean_30d",
    "amount_to_cust_mean_30d",
    "secs_since_prev_cust_txn",
)
LOG1P = (
    "amount_minor",
    "cust_txn_count_1h",
    "cust_txn_count_1d",
    "cust_txn_count_7d",
    "cust_txn_count_30d",
    "cust_amount_mean_7d",
    "cust_amount_mean_30d",
    "amount_to_cust_mean_30d",
    "secs_since_prev_cust_txn",
    "term_txn_count_1d",
    "term_txn_count_7d",
)


@dataclass(frozen=True)
class Preprocessing:
    """Median per feature; mean and scale per output column (features, then missing indicators)."""

    features: tuple[str, ...] = FEATURES
    nullable: tuple[str, ...] = NULLABLE
    log1p: tuple[str, ...] = LOG1P
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    def outputs(self) -> list[str]:
        return [*self.features, *[f"{name}__missing" for name in self.nullable]]

    def raw(self) -> dict[str, Column]:
        """Imputed and logged features, and the indicators, before scaling."""
        out: dict[str, Column] = {}
        for name in self.features:
            x = F.coalesce(F.col(name).cast("double"), F.lit(float(self.medians.get(name, 0.0))))
            out[name] = F.log1p(x) if name in self.log1p else x
        for name in self.nullable:
            out[f"{name}__missing"] = F.col(name).isNull().cast("double")
        return out

    def transformed(self) -> dict[str, Column]:
        return {
            name: (x - F.lit(self.means[name])) / F.lit(self.scales[name]) for name, x in self.raw().items()
        }


def violations(rows: DataFrame, prep: Preprocessing = Preprocessing()) -> DataFrame:
    """Rows the model must refuse: nulls where none may be, negatives under a logarithm."""
    required = [f for f in prep.features if f not in prep.nullable]
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    negative = F.lit(False)
    for name in prep.log1p:
        negative = negative | F.coalesce(F.col(name) < 0, F.lit(False))
    return rows.agg(F.count_if(missing).alias("missing_required"), F.count_if(negative).alias("negative_log1p"))


def checked(rows: DataFrame, prep: Preprocessing = Preprocessing()) -> DataFrame:
    """The same refusal inside the plan: scoring fails on the first such row."""
    required = [f for f in prep.features if f not in prep.nullable]
    out = rows
    for name in required:
        fail = F.raise_error(F.lit(f"missing value in {name}")).cast(rows.schema[name].dataType)
        out = out.withColumn(name, F.coalesce(F.col(name), fail))
    for name in prep.log1p:
        fail = F.raise_error(F.lit(f"negative value in {name}")).cast(rows.schema[name].dataType)
        out = out.withColumn(name, F.when(F.col(name) < 0, fail).otherwise(F.col(name)))
    return out


def fit_medians(rows: DataFrame, prep: Preprocessing = Preprocessing()) -> DataFrame:
    """One row per feature: its exact median over the present values, 0 where there is none."""
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in prep.features]
    medians = exact_percentiles(rows.select(F.inline(F.array(*cells))), F.col("x"), (0.5,), ["feature"])
    listed = rows.sparkSession.createDataFrame([(f,) for f in prep.features], "feature string")
    return listed.join(medians, "feature", "left").select("feature", F.coalesce("q0", F.lit(0.0)).alias("median"))


def fit_preprocessing(rows: DataFrame, prep: Preprocessing = Preprocessing()) -> Preprocessing:
    """Two aggregate passes over the training rows; only one number per column comes back. Without rows, zeros and ones."""
    medians = {r["feature"]: r["median"] for r in fit_medians(rows, prep).collect()}
    partial = Preprocessing(prep.features, prep.nullable, prep.log1p, medians)
    stats = rows.agg(
        *[F.avg(x).alias(f"m_{name}") for name, x in partial.raw().items()],
        *[F.stddev_pop(x).alias(f"s_{name}") for name, x in partial.raw().items()],
    ).first()
    names = partial.outputs()
    return Preprocessing(
        prep.features,
        prep.nullable,
        prep.log1p,
        medians,
        {n: stats[f"m_{n}"] or 0.0 for n in names},
        {n: stats[f"s_{n}"] or 1.0 for n in names},
    )


@dataclass(frozen=True)
class LinearModel:
    preprocessing: Preprocessing
    coefficients: dict[str, float]
    intercept: float
    version: str = "linear-0"

    def score(self) -> Column:
        """The probability as one column expression, compiled with the rest of the stage."""
        z = F.lit(float(self.intercept))
        for name, x in self.preprocessing.transformed().items():
            z = z + x * F.lit(float(self.coefficients.get(name, 0.0)))
        return sigmoid(z)


def rule_score(feature: str) -> Column:
    """A feature used as a score; missing counts as zero."""
    return or_zero(F.col(feature).cast("double"))


def indicator_reasons(has_history: Column, complete: Column) -> Column:
    """Reasons that come with a score: a customer without history, and trimmed history."""
    return F.array_compact(
        F.array(
            F.when(has_history == 0, F.lit("COLD_START_CUSTOMER")),
            F.when(~complete, F.lit("HISTORY_POSSIBLY_TRIMMED")),
        )
    )


def assemble(rows: DataFrame, prep: Preprocessing, label: str = "is_fraud", keep: Sequence[str] = ()) -> DataFrame:
    """Vector input for the learners, scaled by the fitted preprocessing."""
    from pyspark.ml.functions import array_to_vector

    vector = array_to_vector(F.array(*prep.transformed().values()))
    return rows.select(*keep, F.col(label).cast("double").alias("label"), vector.alias("features"))
