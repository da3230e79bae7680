"""Ranking metrics of scores: running counts, AUC, AP, NDCG, curves and tuned thresholds.

All of them read one table, `ranked_counts`: per group and distinct score the positives and rows at
that score and above it. It is built in one distributed scan, for all groups at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.ordering import running_aggregates
from labelloom.session import null_safe_join

THRESHOLD_METRICS = ("f1", "accuracy", "precision", "recall", "kappa")
_RANKS_PER_CHUNK = 8192


def ranked_counts(scored: DataFrame, by: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """`(by..., score, tp_at, n_at, tp, n, pos, total)`, one row per distinct score.

    `tp` and `n` count positives and rows with a score at or above this one.
    """
    by = list(by)
    at = scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(y).cast("bigint")).alias("tp_at"), F.count(F.lit(1)).alias("n_at")
    )
    return running_aggregates(
        at,
        by,
        "score",
        {"tp": ("sum", "tp_at"), "n": ("sum", "n_at")},
        descending=True,
        totals={"pos": ("sum", "tp_at"), "total": ("sum", "n_at")},
    )


def _d(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def auc_and_ap(ranked: DataFrame, by: Sequence[str], single_class: float | None = 0.0) -> DataFrame:
    """`(by..., pos, total, roc_auc, ap)` in one aggregate.

    ROC-AUC is the trapezoid sum over tie groups, `single_class` where it is undefined; average
    precision is the sum of precision times recall step, 0 without positives.
    """
    fp_at = _d("n_at") - _d("tp_at")
    area = fp_at * (2.0 * _d("tp") - _d("tp_at"))
    step = F.try_divide(_d("tp_at") * _d("tp"), _d("pos") * _d("n"))
    sums = ranked.groupBy(*by).agg(
        F.max("pos").alias("pos"), F.max("total").alias("total"), F.sum(area).alias("__area2"), F.sum(step).alias("__ap")
    )
    cells = 2.0 * _d("pos") * (_d("total") - _d("pos"))
    auc = F.coalesce(F.try_divide("__area2", cells), F.lit(single_class).cast("double"))
    return sums.select(*by, "pos", "total", auc.alias("roc_auc"), F.coalesce("__ap", F.lit(0.0)).alias("ap"))


def roc_auc(ranked: DataFrame, by: Sequence[str], single_class: float | None = 0.0) -> DataFrame:
    return auc_and_ap(ranked, by, single_class).drop("ap")


def average_precision(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    return auc_and_ap(ranked, by).drop("roc_auc")


def rank_averages(per_label: DataFrame, by: Sequence[str], *values: str) -> DataFrame:
    """Macro mean, and mean weighted by the positives of each label, of every value column."""
    aggs = []
    for value in values:
        weighted = F.try_divide(F.sum(_d("pos") * F.col(value)), F.sum(_d("pos")))
        aggs += [F.avg(value).alias(f"{value}_macro"), F.coalesce(weighted, F.lit(0.0)).alias(f"{value}_weighted")]
    return per_label.groupBy(*by).agg(*aggs)


def ndcg(ranked: DataFrame, by: Sequence[str], sizes: DataFrame | None = None) -> DataFrame:
    """NDCG of the whole ranking per group, gain = label, discounts averaged inside tie groups.

    The discounts of a rank interval are summed in chunks of fixed length that are spread over the
    cluster, so neither a huge tie group nor a huge ideal ranking is expanded inside one row.
    `sizes(by..., pos, total)` saves a pass if the caller has it.
    """
    by = list(by)
    if sizes is None:
        sizes = ranked.groupBy(*by).agg(F.max("pos").alias("pos"), F.max("total").alias("total"))
    actual = ranked.where("tp_at > 0").select(
        *by,
        F.lit("dcg").alias("__part"),
        (F.col("n") - F.col("n_at") + 1).alias("__from"),
        F.col("n").alias("__to"),
        (_d("tp_at") / _d("n_at")).alias("__gain"),
    )
    ideal = sizes.where("pos > 0").select(
        *by,
        F.lit("ideal").alias("__part"),
        F.lit(1).cast("bigint").alias("__from"),
        F.col("pos").alias("__to"),
        F.lit(1.0).alias("__gain"),
    )
    size = _RANKS_PER_CHUNK
    chunks = (
        actual.unionByName(ideal)
        .withColumn("__chunk", F.explode(F.expr(f"sequence(__from div {size}, __to div {size})")))
        .repartition(*by, "__part", "__chunk")
    )
    ranks = F.sequence(
        F.greatest("__from", F.col("__chunk") * size), F.least("__to", F.col("__chunk") * size + (size - 1))
    )
    discounts = F.aggregate(ranks, F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1)))
    parts = chunks.groupBy(*by).agg(
        F.sum(F.when(F.col("__part") == "dcg", F.col("__gain") * discounts)).alias("__dcg"),
        F.sum(F.when(F.col("__part") == "ideal", discounts)).alias("__ideal"),
    )
    value = F.coalesce(F.try_divide("__dcg", "__ideal"), F.lit(0.0))
    return null_safe_join(sizes, parts, by, "left").select(*by, "pos", "total", value.alias("ndcg"))


def roc_curve(ranked: DataFrame, by: Sequence[str], drop_collinear: bool = False) -> DataFrame:
    """`(by..., threshold, fpr, tpr)`, with the point (0, 0) at an infinite threshold.

    `drop_collinear` keeps only the corners, as plotting needs no others.
    """
    by = list(by)
    points = _with_origin(ranked, by)
    if drop_collinear:
        # A point is a corner unless the step into it and the step out of it have the same direction.
        points = _corners(points, by)
    negatives = _d("total") - _d("pos")
    return points.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide(_d("n") - _d("tp"), negatives).alias("fpr"),
        F.try_divide(_d("tp"), _d("pos")).alias("tpr"),
    )


def _with_origin(ranked: DataFrame, by: list[str]) -> DataFrame:
    sizes = ranked.groupBy(*by).agg(F.max("pos").alias("pos"), F.max("total").alias("total"))
    zero = F.lit(0).cast("bigint")
    origin = sizes.select(
        *by,
        F.lit(float("inf")).alias("score"),
        *[zero.alias(c) for c in ("tp_at", "n_at", "tp", "n")],
        "pos",
        "total",
    )
    return ranked.select(origin.columns).unionByName(origin)


def _corners(points: DataFrame, by: list[str]) -> DataFrame:
    """Drop the inner points of straight runs.

    The step into a point is in its own row. The step out of it is the step of the next lower score,
    which starts at this point's running count: an equi-join, not a window over a whole group.
    """
    steps = points.where("n_at > 0").select(
        *by,
        (F.col("n") - F.col("n_at")).alias("n"),
        F.col("tp_at").alias("__tp_out"),
        (F.col("n_at") - F.col("tp_at")).alias("__fp_out"),
    )
    turn = F.col("tp_at") * F.col("__fp_out") - F.col("__tp_out") * (F.col("n_at") - F.col("tp_at"))
    joined = null_safe_join(points, steps, [*by, "n"], "left")
    return joined.where((F.col("n_at") == 0) | F.col("__tp_out").isNull() | (turn != 0))


def pr_curve(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    """`(by..., threshold, precision, recall)`; the end point (1, 0) has no threshold."""
    by = list(by)
    points = ranked.select(
        *by,
        F.col("score").alias("threshold"),
        (_d("tp") / _d("n")).alias("precision"),
        F.coalesce(F.try_divide(_d("tp"), _d("pos")), F.lit(1.0)).alias("recall"),
    )
    end = ranked.groupBy(*by).agg(F.max("pos")).select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def _threshold_value(metric: str, tp: Column, n: Column) -> Column:
    pos, total = _d("pos"), _d("total")
    fp, fn = n - tp, pos - tp
    tn = total - n - fn
    if metric == "f1":
        value = F.try_divide(2.0 * tp, 2.0 * tp + fp + fn)
    elif metric == "accuracy":
        value = (tp + tn) / total
    elif metric == "precision":
        value = F.try_divide(tp, n)
    elif metric == "recall":
        value = F.try_divide(tp, pos)
    elif metric == "kappa":
        value = F.try_divide(2.0 * (tp * tn - fn * fp), (tp + fp) * (fp + tn) + (tp + fn) * (fn + tn))
    else:
        raise ValueError(f"unsupported metric {metric!r}, use one of {THRESHOLD_METRICS}")
    return F.coalesce(value, F.lit(0.0))


def optimal_thresholds(ranked: DataFrame, by: Sequence[str], metrics: Sequence[str] = ("f1",)) -> DataFrame:
    """Long `(by..., metric, threshold, value)`: the score cut (`score >= threshold`) with the best value.

    Every distinct score is a candidate, and so is an infinite one that predicts nothing; ties take
    the highest cut. One aggregate over the running counts serves all metrics, where a search would
    evaluate each metric at each candidate.
    """
    by = list(by)

    def candidate(metric: str, score: Column, tp: Column, n: Column) -> Column:
        return F.struct(_threshold_value(metric, tp, n).alias("value"), score.alias("threshold"))

    best = ranked.groupBy(*by).agg(
        F.max("pos").alias("pos"),
        F.max("total").alias("total"),
        *[F.max(candidate(m, _d("score"), _d("tp"), _d("n"))).alias(f"__{m}") for m in metrics],
    )
    zero, infinite = F.lit(0.0), F.lit(float("inf"))
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.greatest(F.col(f"__{m}"), candidate(m, infinite, zero, zero)).alias("best"))
            for m in metrics
        ]
    )
    return best.select(*by, F.inline(rows)).select(
        *by, "metric", F.col("best.threshold").alias("threshold"), F.col("best.value").alias("value")
    )


def optimal_threshold(ranked: DataFrame, by: Sequence[str], metric: str = "f1") -> DataFrame:
    """`(by..., threshold, <metric>)` of one metric."""
    return optimal_thresholds(ranked, by, [metric]).select(*by, "threshold", F.col("value").alias(metric))


def pooled_auc(scored: DataFrame, model: str = "model", label: str = "label", top: int = 10) -> DataFrame:
    """AUC over the pooled folds, single-class labels dropped, mean over labels, best `top` models."""
    by = [model, label]
    per_label = roc_auc(ranked_counts(scored, by), by, single_class=None).where("roc_auc is not null")
    means = per_label.groupBy(model).agg(F.avg("roc_auc").alias("mean_auc"), F.count(F.lit(1)).alias("n_labels"))
    return means.orderBy(F.desc("mean_auc"), model).limit(top)
