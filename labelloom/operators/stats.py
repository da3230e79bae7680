"""Tests of many models over the same folds: average ranks, Friedman, Nemenyi.

The input has one row per (fold, model); everything after the ranks has one row per model.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.operators.ordering import digest_positions
from labelloom.session import cut_lineage

MIN_FOLDS = 3
# Two-tailed critical values of the Nemenyi test for 2 to 10 models (Demsar 2006).
NEMENYI_CRITICAL = {
    0.05: (1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164),
    0.10: (1.645, 2.052, 2.291, 2.459, 2.589, 2.693, 2.780, 2.855, 2.920),
}


def fold_ranks(df: DataFrame, model: str = "model", fold: str = "fold", value: str = "value") -> DataFrame:
    """Rank of every model in its fold, best first, ties averaged (one window row per model)."""
    order = Window.partitionBy(fold).orderBy(F.desc(value))
    tied = F.count(F.lit(1)).over(Window.partitionBy(fold, value))
    return df.select(fold, model, value, (F.rank().over(order) + (tied - 1) / F.lit(2.0)).alias("rank"))


def mean_ranks(df: DataFrame, model: str = "model", fold: str = "fold", value: str = "value") -> DataFrame:
    ranks = fold_ranks(df, model, fold, value)
    return ranks.groupBy(model).agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n_folds"))


def _chi2_tail(x: float, df: float) -> float:
    """P(X > x) of a chi-square variable with whole degrees of freedom: a finite sum of positive terms.

    Half of x is h; the terms are exp(-h) h^a / Gamma(a + 1) for a = df/2 - 1, df/2 - 2, ... down to 0 or
    1/2, with erfc(sqrt(h)) below them where df is odd. Nothing is subtracted, so small tails stay exact.
    """
    if math.isnan(x) or math.isnan(df):
        return float("nan")
    if x <= 0:
        return 1.0
    h, power = x / 2, df / 2 - 1
    total = math.erfc(math.sqrt(h)) if df % 2 else 0.0
    while power > -0.5:
        total += math.exp(power * math.log(h) - h - math.lgamma(power + 1))
        power -= 1
    return min(1.0, total)


@F.pandas_udf(T.DoubleType())
def chi2_survival(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(X > x) for a chi-square variable with a whole number of degrees of freedom."""
    return pd.Series([_chi2_tail(a, b) for a, b in zip(x.astype(float), df.astype(float))], dtype="float64")


def friedman_test(df: DataFrame, model: str = "model", fold: str = "fold", value: str = "value") -> DataFrame:
    """Friedman chi-square with tie correction: `(n_folds, n_models, statistic, p_value)`.

    The statistic is null unless every model has a value in each of at least three folds.
    """
    ranks = fold_ranks(df, model, fold, value)
    per_model = ranks.groupBy(model).agg(F.sum("rank").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    sums = per_model.agg(
        F.count(F.lit(1)).alias("n_models"),
        F.max("__n").alias("n_folds"),
        F.min("__n").alias("__least"),
        F.sum(F.col("__sum") * F.col("__sum")).alias("__squares"),
    )
    ties = ranks.groupBy(fold, value).agg(F.count(F.lit(1)).alias("__t"))
    correction = ties.agg(F.sum(F.pow("__t", 3) - F.col("__t")).alias("__ties")).scalar()
    k, n = F.col("n_models").cast("double"), F.col("n_folds").cast("double")
    raw = F.lit(12.0) / (n * k * (k + 1)) * F.col("__squares") - F.lit(3.0) * n * (k + 1)
    scale = F.lit(1.0) - correction / (n * k * (k * k - 1))
    valid = (F.col("__least") == F.col("n_folds")) & (F.col("n_folds") >= MIN_FOLDS) & (F.col("n_models") >= 3)
    tested = sums.withColumn("statistic", F.when(valid, F.try_divide(raw, scale)))
    return tested.select("n_folds", "n_models", "statistic", chi2_survival(F.col("statistic"), F.col("n_models") - 1).alias("p_value"))


_GRID = np.linspace(-14.0, 14.0, 5601)
_DENSITY = np.exp(-0.5 * _GRID * _GRID) / math.sqrt(2 * math.pi)
_ERFC = np.vectorize(math.erfc, otypes=[float])


def _studentized_range_tail(q: float, k: int) -> float:
    """P(range of k standard normals > q) by the trapezoid rule.

    One minus the chance that all others lie within q above the smallest; the difference is taken inside
    the integral, where `expm1` and `log1p` keep small tails.
    """
    if math.isnan(q):
        return float("nan")
    # P(a value above the smallest at z is within q of it, given that it is above z)
    above = 0.5 * _ERFC(_GRID / math.sqrt(2))
    beyond = 0.5 * _ERFC((_GRID + q) / math.sqrt(2))
    share = np.divide(beyond, above, out=np.ones_like(above), where=above > 0)
    outside = -np.expm1((k - 1) * np.log1p(-np.minimum(share, 1 - 1e-16)))
    return float(min(1.0, max(0.0, np.trapezoid(k * _DENSITY * above ** (k - 1) * outside, _GRID))))


def _critical(alpha: float, k: int) -> float:
    """The range of k standard normals that is passed with chance alpha, over the root of two."""
    low, high = 0.0, 20.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if _studentized_range_tail(middle, k) > alpha else (low, middle)
    return low / math.sqrt(2)


@F.pandas_udf(T.DoubleType())
def studentized_range_tail(q: pd.Series, k: pd.Series) -> pd.Series:
    """Tail of the range of k standard normals; equal (q, k) of a batch are computed once."""
    pairs = list(zip(q.astype(float), k))
    known = {pair: _studentized_range_tail(pair[0], int(pair[1])) for pair in set(pairs)}
    return pd.Series([known[p] if p in known else float("nan") for p in pairs], dtype="float64")


def critical_range(alpha: float, k: Column) -> Column:
    """Critical value of the Nemenyi test for any number of models: the published ones, else computed."""
    published = NEMENYI_CRITICAL.get(alpha, ())

    @F.pandas_udf(T.DoubleType())
    def value(models: pd.Series) -> pd.Series:
        known = {n: published[n - 2] if 0 <= n - 2 < len(published) else _critical(alpha, n) for n in set(models.astype(int))}
        return models.map(known).astype(float)

    return value(k)


def nemenyi_pairs(
    df: DataFrame, model: str = "model", fold: str = "fold", value: str = "value", alpha: float = 0.05
) -> DataFrame:
    """All pairs of models: rank difference, q, p value, critical difference and significance.

    The pairs are the result, so their number is that of the pairs. Each model row is unfolded to the
    numbers of the later models and joined on the number: the pairs of one model are spread over the
    tasks like those of any other.
    """
    ranks = mean_ranks(df, model, fold, value)
    size = ranks.agg(F.count(F.lit(1)).alias("n_models"), F.max("n_folds").alias("n_folds"))
    # one row: the critical value is computed once
    size = cut_lineage(size.withColumn("__critical", critical_range(alpha, F.greatest("n_models", F.lit(2)))))
    numbered = cut_lineage(
        digest_positions(ranks.withColumn("__digest", F.md5(F.col(model).cast("string"))), "__digest").select(
            "pos", F.col(model).alias("m"), F.col("mean_rank").alias("r")
        )
    )
    n_models = size.select("n_models").scalar()
    later = F.explode(F.when(F.col("pos") + 1 < n_models, F.sequence(F.col("pos") + 1, n_models - 1)))
    left = numbered.select(F.col("m").alias("__m"), F.col("r").alias("__r"), later.alias("pos"))
    pairs = left.join(numbered, "pos").withColumns(
        {c: size.select(c).scalar() for c in ("n_models", "n_folds", "__critical")}
    )
    error = F.sqrt(F.col("n_models") * (F.col("n_models") + 1) / (F.lit(6.0) * F.col("n_folds")))
    named = pairs.select(
        F.least("__m", "m").alias("model_a"),
        F.greatest("__m", "m").alias("model_b"),
        F.abs(F.col("__r") - F.col("r")).alias("rank_diff"),
        (F.col("__critical") * error).alias("critical_diff"),
        "n_models",
        (F.abs(F.col("__r") - F.col("r")) / error).alias("q"),
    )
    # The range statistic is the rank difference over the error without the factor of two samples.
    tested = named.withColumn("p_value", studentized_range_tail(F.col("q") * F.lit(math.sqrt(2.0)), F.col("n_models")))
    return tested.withColumn("significant", F.col("p_value") < alpha).drop("n_models")


def critical_groups(
    df: DataFrame, model: str = "model", fold: str = "fold", value: str = "value", alpha: float = 0.05
) -> DataFrame:
    """Bars of a critical-difference diagram: `(group, model, mean_rank, n_models)`, one row a member.

    A group is a longest run of models, by mean rank, whose first and last differ by no more than the critical
    difference. Both ends move up together: the last model within reach of each model is a range frame, and a
    run that ends where the run before it does lies inside that one. A table of models, a row each.
    """
    ranks = mean_ranks(df, model, fold, value)
    size = ranks.agg(F.count(F.lit(1)).alias("k"), F.max("n_folds").alias("n"))
    critical = critical_range(alpha, F.greatest("k", F.lit(2)))
    reach = size.select(critical * F.sqrt(F.col("k") * (F.col("k") + 1) / (F.lit(6.0) * F.col("n")))).first()
    one = Window.partitionBy(F.lit(0))  # the few rows of the models
    placed = cut_lineage(ranks.withColumn("pos", F.row_number().over(one.orderBy("mean_rank", model))))
    last = F.expr(f"max(pos) over (partition by 0 order by mean_rank range between current row and {float(reach[0] or 0.0)!r}D following)")
    runs = placed.withColumn("last", last).withColumn("before", F.coalesce(F.lag("last").over(one.orderBy("pos")), F.lit(0)))
    runs = runs.where((F.col("last") > F.col("before")) & (F.col("last") > F.col("pos")))
    runs = runs.withColumn("group", F.row_number().over(one.orderBy("pos"))).select("group", F.explode(F.sequence("pos", "last")).alias("pos"), (F.col("last") - F.col("pos") + 1).alias("n_models"))
    return runs.join(placed, "pos").select("group", model, "mean_rank", "n_models")
