"""Summaries of result tables: one row per experiment run (model, fold, loss, flags, metrics).

Run tables grow with the number of experiments, not with the corpus; where a table may nevertheless
be large the functions aggregate and never rank a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.operators.ordering import exact_quantiles

# Fixed value: two-sided 95% quantile of the normal distribution.
Z95 = 1.959964


def filter_runs(df: DataFrame, metric: str, **equal) -> DataFrame:
    """Rows with a value of the metric and the given settings, e.g. `loss_type="BCE"`."""
    kept = df.where(F.col(metric).isNotNull())
    for column, value in equal.items():
        kept = kept.where(F.col(column) == value)
    return kept


def group_mean_metrics(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def metric_summary(df: DataFrame, by: Sequence[str], metric: str, digits: int = 3) -> DataFrame:
    """Mean, sample deviation, count and maximum, rounded."""
    return df.groupBy(*by).agg(
        F.round(F.avg(metric), digits).alias("mean"),
        F.round(F.stddev_samp(metric), digits).alias("std"),
        F.count(metric).alias("count"),
        F.round(F.max(metric), digits).alias("max"),
    )


def descriptive_ranking(df: DataFrame, model: str, metric: str) -> DataFrame:
    """Mean, population deviation, minimum, maximum and folds per model, best mean first."""
    stats = df.groupBy(model).agg(
        F.avg(metric).alias("mean"),
        F.stddev_pop(metric).alias("std"),
        F.min(metric).alias("min"),
        F.max(metric).alias("max"),
        F.count(metric).alias("n_folds"),
    )
    return stats.orderBy(F.desc("mean"), model)


def confidence_interval(df: DataFrame, by: Sequence[str], metric: str, z: float = Z95) -> DataFrame:
    """Mean and its normal interval; the error shrinks with the number of folds."""
    stats = df.groupBy(*by).agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("__sd"), F.count(metric).alias("n")
    )
    half = F.lit(z) * F.col("__sd") / F.sqrt("n")
    return stats.select(*by, "n", "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))


def median_by_model(df: DataFrame, model: str, metric: str) -> DataFrame:
    """Median per model, highest first."""
    return exact_quantiles(df, [model], metric, {"median": 0.5}).drop("n").orderBy(F.desc("median"), model)


def box_stats(df: DataFrame, by: Sequence[str], metric: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (extreme values within `reach` IQR of the box) and outlier count."""
    by = list(by)
    quartiles = exact_quantiles(df, by, metric, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    fenced = quartiles.withColumns({"__low": F.col("q1") - reach * spread, "__high": F.col("q3") + reach * spread})
    values = df.where(F.col(metric).isNotNull()).groupBy(*by, F.col(metric).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    joined = values.join(fenced, by)
    inside = F.col("__v").between(F.col("__low"), F.col("__high"))
    return joined.groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("__v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__v"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("__c"))), F.lit(0)).alias("n_outliers"),
    )


def row_mean(metrics: Sequence[str]) -> Column:
    """Mean of several metric columns of a row, nulls ignored; null if all are null."""
    values = F.array_compact(F.array(*[F.col(m).cast("double") for m in metrics]))
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(values))


def best_row_per_group(df: DataFrame, by: Sequence[str], metric: str, ties: Sequence[str]) -> DataFrame:
    """The whole row with the best metric of each group; `ties` in ascending order decide.

    A `min_by` aggregate: combined before the shuffle, where a window would move every row.
    """
    by = list(by)
    kept = df.where(F.col(metric).isNotNull())
    whole = F.struct(*[c for c in df.columns if c not in by])
    return (
        kept.groupBy(*by)
        .agg(F.min_by(whole, F.struct((-F.col(metric)).alias("__m"), *ties)).alias("__row"))
        .select(*by, "__row.*")
        .select(*df.columns)
    )


def best_config(df: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """The configuration with the best mean metric."""
    means = df.groupBy(*by).agg(F.avg(metric).alias(metric))
    return means.orderBy(F.desc(metric), *by).limit(1)


def category_ranking(df: DataFrame, category: str, metric: str) -> DataFrame:
    """Categories by mean metric with rank and lead over the next one (one row per category)."""
    means = df.groupBy(category).agg(F.avg(metric).alias("mean"))
    order = Window.orderBy(F.desc("mean"), category)
    return means.select(
        category, "mean", F.rank().over(order).alias("rank"), (F.col("mean") - F.lead("mean").over(order)).alias("gap")
    )


def best_per_category(long: DataFrame, category: str, model: str, value: str, top: int = 3) -> DataFrame:
    """Best value of every model in each category, the `top` models of each."""
    best = long.groupBy(category, model).agg(F.max(value).alias("best"))
    order = Window.partitionBy(category).orderBy(F.desc("best"), model)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ablation_delta(df: DataFrame, flag: str, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean metric with and without a setting, and the difference."""
    means = df.groupBy(*by).agg(
        F.avg(F.when(F.col(flag), F.col(metric))).alias("with"), F.avg(F.when(~F.col(flag), F.col(metric))).alias("without")
    )
    return means.withColumn("delta", F.col("with") - F.col("without"))


def best_level(df: DataFrame, column: str, metric: str) -> DataFrame:
    """The value of one setting (loss, kernel, ...) with the best mean metric."""
    return best_config(df, [column], metric)


def overall_distribution(df: DataFrame, metric: str) -> DataFrame:
    """Count, mean, population deviation, extremes and range over all runs."""
    return df.agg(
        F.count(metric).alias("n"),
        F.avg(metric).alias("mean"),
        F.stddev_pop(metric).alias("std"),
        F.min(metric).alias("min"),
        F.max(metric).alias("max"),
        (F.max(metric) - F.min(metric)).alias("range"),
    )


def complete_models(df: DataFrame, model: str, fold: str, value: str) -> DataFrame:
    """Rows of the models that have a value in every fold."""
    valued = df.where(F.col(value).isNotNull())
    n_folds = valued.agg(F.countDistinct(fold)).scalar()
    full = valued.groupBy(model).agg(F.countDistinct(fold).alias("__n")).where(F.col("__n") == n_folds)
    return valued.join(full, model, "left_semi")


def topk_models(df: DataFrame, model: str, metric: str, k: int = 5) -> DataFrame:
    """All rows of the k models with the best mean metric."""
    best = df.groupBy(model).agg(F.avg(metric).alias("__mean")).orderBy(F.desc("__mean"), model).limit(k)
    return df.join(F.broadcast(best.select(model)), model, "left_semi")  # k rows


def ranked_head_tail(df: DataFrame, by: Sequence[str], metric: str, n: int = 5) -> DataFrame:
    """The n best and the n worst configurations by mean metric."""
    means = df.groupBy(*by).agg(F.avg(metric).alias("mean"))
    head = means.orderBy(F.desc("mean"), *by).limit(n).withColumn("end", F.lit("best"))
    tail = means.orderBy(F.asc("mean"), *by).limit(n).withColumn("end", F.lit("worst"))
    return head.unionByName(tail)


def unpivot_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], prefix: str = "") -> DataFrame:
    """Wide metric columns as (keys, category, value); nulls dropped."""
    long = df.unpivot(list(keys), list(metrics), "category", "value").where("value is not null")
    return long.withColumn("category", F.regexp_replace("category", f"^{prefix}", "")) if prefix else long


def pivot_metrics(long: DataFrame, row: str, column: str, values: Sequence[str], value: str = "value") -> DataFrame:
    """Mean table row x column; the columns are given, so no extra job looks for them."""
    return long.groupBy(row).pivot(column, list(values)).agg(F.avg(value))


def minmax_normalize(df: DataFrame, metric: str, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """`(x - min) / (max - min)` per group; null where all values are equal."""
    limits = df.groupBy(*by).agg(F.min(metric).alias("__lo"), F.max(metric).alias("__hi"))
    if by:
        joined = df.join(limits, list(by))
        low, high = F.col("__lo"), F.col("__hi")
    else:
        joined, low, high = df, limits.select("__lo").scalar(), limits.select("__hi").scalar()
    return joined.withColumn(out or metric, F.try_divide(F.col(metric) - low, high - low)).drop("__lo", "__hi")
