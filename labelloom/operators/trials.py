"""Trial logs of a parameter search: `(trial, iteration or epoch, parameters..., metric)`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.operators.ordering import running_aggregates


def trial_last_value(log: DataFrame, trial: str, iteration: str, metric: str) -> DataFrame:
    """Last logged metric of every trial."""
    return log.groupBy(trial).agg(F.max_by(metric, iteration).alias(metric))


def best_trial(log: DataFrame, trial: str, iteration: str, metric: str, mode: str = "max", scope: str = "last") -> DataFrame:
    """The trial with the best metric and its parameters; the smallest id wins a tie.

    `scope` says what stands for a trial: its `last` value, or the best of `all` its values. The other
    columns of the log come along from the row whose metric it is.
    """
    if mode not in ("max", "min") or scope not in ("last", "all"):
        raise ValueError("mode is max or min, scope is last or all")
    others = [c for c in log.columns if c != trial]
    row = F.struct(*others)
    if scope == "last":
        chosen = F.max_by(row, iteration)
    else:
        # ties of the metric take the first iteration
        signed = F.col(metric) if mode == "min" else -F.col(metric)
        chosen = F.min_by(row, F.struct(signed.alias("m"), F.col(iteration).alias("i")))
    per_trial = log.groupBy(trial).agg(chosen.alias("__row")).select(trial, *[F.col("__row")[c].alias(c) for c in others])
    order = F.desc(metric) if mode == "max" else F.asc(metric)
    return per_trial.orderBy(order, trial).limit(1)


def best_and_final_epoch(series: DataFrame, trial: str, epoch: str, metric: str, mode: str = "max") -> DataFrame:
    """Final value, best value and the first epoch that reached it."""
    signed = -F.col(metric) if mode == "max" else F.col(metric)
    best = F.min_by(F.struct(F.col(epoch).alias("e"), F.col(metric).alias("v")), F.struct(signed.alias("s"), F.col(epoch).alias("e")))
    return (
        series.groupBy(trial)
        .agg(F.max_by(metric, epoch).alias("final_value"), best.alias("__best"))
        .select(trial, "final_value", F.col("__best.v").alias("best_value"), F.col("__best.e").alias("best_epoch"))
    )


def param_grid_mean(log: DataFrame, rows: str, columns: str, metric: str, values: Sequence | None = None) -> DataFrame:
    """Mean metric on a parameter grid: long, or a table over the given column values."""
    if values is None:
        return log.groupBy(rows, columns).agg(F.avg(metric).alias("mean"))
    return log.groupBy(rows).pivot(columns, list(values)).agg(F.avg(metric))


def epoch_series(train_log: DataFrame, eval_log: DataFrame, trial: str, iteration: str, epoch: str, metric: str) -> DataFrame:
    """One train and one eval value per epoch, each the first that was logged in it."""

    def first_in_epoch(log: DataFrame, name: str) -> DataFrame:
        return log.groupBy(trial, epoch).agg(F.min_by(metric, iteration).alias(name))

    return first_in_epoch(train_log, "train_value").join(first_in_epoch(eval_log, "eval_value"), [trial, epoch])


def early_stop_point(
    series: DataFrame, trial: str, epoch: str, metric: str, patience: int = 3, threshold: float = 0.01, mode: str = "max"
) -> DataFrame:
    """Epoch at which early stopping ends each trial; null if it never does.

    An evaluation improves if it beats the best of all earlier ones by more than `threshold`; the
    best itself moves with any gain. The stop comes at the first run of `patience` evaluations in
    succession without improvement. Prefix maxima replace the sequential counter; a series has one
    row per epoch.
    """
    order = Window.partitionBy(trial).orderBy(epoch)
    value = F.col(metric) if mode == "max" else -F.col(metric)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = series.select(
        trial, epoch, F.row_number().over(order).alias("__i"), value.alias("__v"), F.max(value).over(before).alias("__best")
    )
    improved = F.col("__best").isNull() | (F.col("__v") - F.col("__best") > threshold)
    waited = F.col("__i") - F.max(F.when(improved, F.col("__i"))).over(upto)
    stops = marked.select(trial, epoch, waited.alias("__waited"))
    return stops.groupBy(trial).agg(
        F.min(F.when(F.col("__waited") >= patience, F.col(epoch))).alias("stop_epoch"), F.count(F.lit(1)).alias("n_epochs")
    )


def running_best_trial(finished: DataFrame, trial: str, finished_at: str, value: str) -> DataFrame:
    """Best value so far at each completion; a trial below it can be removed.

    Completions are ordered over the whole search, so the running maximum is computed in pieces.
    """
    running = running_aggregates(finished.select(trial, finished_at, value), [], [finished_at, trial], {"best_so_far": ("max", value)})
    return running.withColumn("removable", F.col(value) < F.col("best_so_far"))
