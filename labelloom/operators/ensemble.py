"""Score ensembles: aligned by row key, never by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators import curves, metrics
from labelloom.session import null_safe_join


def _models_seen(model: str) -> Column:
    """Distinct models of a cell; the set holds at most one entry per model, so one shuffle is enough."""
    return F.size(F.collect_set(model)).cast("bigint")


def align_model_scores(scored: DataFrame, keys: Sequence[str], model: str = "model", missing: str = "error") -> DataFrame:
    """Cells with the scores of all models: `n_models`, the mean score and the label.

    A cell that some model missed, e.g. in a whole fold, is an error; `unaligned_cells` lists them.
    With `missing="drop"` such cells are left out instead.
    """
    if missing not in ("error", "drop"):
        raise ValueError(f"missing is error or drop, not {missing!r}")
    n_models = scored.agg(F.countDistinct(model)).scalar()
    means = scored.groupBy(*keys).agg(
        _models_seen(model).alias("n_models"), F.avg("score").alias("score"), F.max("y").alias("y")
    )
    whole = F.col("n_models") == n_models
    if missing == "drop":
        return means.where(whole)
    refused = F.raise_error(F.lit("a model has no score for a cell; see unaligned_cells")).cast("bigint")
    return means.withColumn("n_models", F.when(whole, F.col("n_models")).otherwise(refused))


def unaligned_cells(scored: DataFrame, keys: Sequence[str], model: str = "model") -> DataFrame:
    n_models = scored.agg(F.countDistinct(model)).scalar()
    return scored.groupBy(*keys).agg(_models_seen(model).alias("n_models")).where(F.col("n_models") < n_models)


def ensemble_mean(
    scored: DataFrame, keys: Sequence[str], model: str = "model", threshold: float = 0.5, missing: str = "error"
) -> DataFrame:
    """Mean score over all models and its decision. Scores must be on one scale, e.g. probabilities."""
    aligned = align_model_scores(scored, keys, model, missing)
    return aligned.withColumn("pred", metrics.apply_threshold("score", threshold))


def fold_model_mean(scored: DataFrame, config: Sequence[str], row_key: str, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Mean score of the fold models of each configuration, per row and label, and its decision."""
    means = scored.groupBy(*config, row_key, label).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_scores"))
    return means.withColumn("pred", metrics.apply_threshold("score", threshold))


def join_predictions_labels(scores: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores with their true labels. A score without a label or a label without a score is an error."""
    joined = scores.withColumn("__scored", F.lit(True)).join(truth, list(keys), "full")
    checked = (
        F.when(F.col("y").isNull(), F.raise_error(F.lit("score without a true label")).cast("int"))
        .when(F.col("__scored").isNull(), F.raise_error(F.lit("true label without a score")).cast("int"))
        .otherwise(F.col("y"))
    )
    return joined.withColumn("y", checked).drop("__scored")


def metric_per_fold(scored: DataFrame, model: str = "model", fold: str = "fold", label: str = "label") -> DataFrame:
    """F1, ROC-AUC and AP per model and fold, mean over the labels."""
    by = [model, fold, label]
    f1 = metrics.prf_per_label(metrics.confusion_counts(scored, by)).select(*by, "f1")
    ranking = curves.auc_and_ap(curves.ranked_counts(scored, by), by, single_class=0.5)
    joined = null_safe_join(f1, ranking, by)
    return joined.groupBy(model, fold).agg(*[F.avg(m).alias(m) for m in ("f1", "roc_auc", "ap")])
