"""Classification metrics from confusion counts.

Canonical input: long `scored(row_key, label, y, score, pred, model, fold, run)`. Every function takes
the grouping columns, so all models, folds and labels are evaluated in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators import curves
from labelloom.session import broadcast_if_small, cut_lineage, null_safe_join

COUNTS = ("tn", "fp", "fn", "tp")


def apply_threshold(score: Column | str, threshold: Column | float = 0.5, inclusive: bool | None = None) -> Column:
    """0/1 decision. Fixed cuts use `>`, tuned cuts (a column) use `>=` unless stated otherwise."""
    score = F.col(score) if isinstance(score, str) else score
    if inclusive is None:
        inclusive = isinstance(threshold, Column)
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (score >= cut if inclusive else score > cut).cast("int")


def confusion_counts(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """TN, FP, FN, TP per group."""
    return df.groupBy(*by).agg(
        *[
            F.count_if((F.col(y) == truth) & (F.col(pred) == guess)).alias(name)
            for name, truth, guess in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
        ]
    )


def _counts() -> tuple[Column, Column, Column, Column]:
    # Products of counts overflow bigint at scale, so all metrics are computed in double.
    return tuple(F.col(c).cast("double") for c in COUNTS)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def precision() -> Column:
    tn, fp, fn, tp = _counts()
    return _ratio(tp, tp + fp)


def recall() -> Column:
    tn, fp, fn, tp = _counts()
    return _ratio(tp, tp + fn)


def fbeta(beta: float = 1.0) -> Column:
    tn, fp, fn, tp = _counts()
    b2 = beta * beta
    return _ratio((1.0 + b2) * tp, (1.0 + b2) * tp + b2 * fn + fp)


def accuracy() -> Column:
    tn, fp, fn, tp = _counts()
    return _ratio(tp + tn, tp + tn + fp + fn)


def mcc() -> Column:
    tn, fp, fn, tp = _counts()
    return _ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))


def kappa() -> Column:
    """Cohen's kappa; 0/0 (one class only, all right) stays undefined in the literature, here 0."""
    tn, fp, fn, tp = _counts()
    return _ratio(2.0 * (tp * tn - fn * fp), (tp + fp) * (fp + tn) + (tp + fn) * (fn + tn))


def prf_per_label(counts: DataFrame) -> DataFrame:
    """Adds support, precision, recall, F1, F2 and kappa to a table of confusion counts."""
    return counts.withColumns(
        {
            "support": F.col("tp") + F.col("fn"),
            "precision": precision(),
            "recall": recall(),
            "f1": fbeta(),
            "f2": fbeta(2.0),
            "kappa": kappa(),
        }
    )


def prf_averages(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Macro, micro and support-weighted precision, recall, F1, F2 and kappa over the labels of a group."""
    per_label = prf_per_label(counts)
    weight = F.col("support").cast("double")
    aggs = [F.sum(c).alias(c) for c in COUNTS]
    for name in ("precision", "recall", "f1", "f2", "kappa"):
        aggs.append(F.avg(name).alias(f"{name}_macro"))
        aggs.append(_ratio(F.sum(weight * F.col(name)), F.sum(weight)).alias(f"{name}_weighted"))
    pooled = per_label.groupBy(*by).agg(*aggs)
    micro = {"precision_micro": precision(), "recall_micro": recall(), "f1_micro": fbeta(), "mcc": mcc()}
    return pooled.withColumns(micro).drop(*COUNTS)


def subset_accuracy(df: DataFrame, by: Sequence[str], row_key: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """Share of rows whose labels are all right."""
    rows = df.groupBy(*by, row_key).agg(F.min((F.col(y) == F.col(pred)).cast("int")).alias("__all_right"))
    return rows.groupBy(*by).agg((F.sum("__all_right") / F.count(F.lit(1))).alias("subset_accuracy"))


def rank_metrics(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """ROC-AUC, average precision and NDCG per group from one table of ranked counts."""
    ranked = curves.ranked_counts(scored, by)
    areas = cut_lineage(curves.auc_and_ap(ranked, by))
    gain = curves.ndcg(ranked, by, areas).drop("pos", "total")
    return null_safe_join(areas, gain, list(by))


def detailed_metrics(scored: DataFrame, by: Sequence[str], row_key: str, label: str = "label") -> DataFrame:
    """One entry for all: long `(by..., metric, label, value)` rows.

    A group with a single label yields the binary metric set, otherwise per-label rows plus the
    averaged rows (`label` is null there).
    """
    by = list(by)
    per = [*by, label]
    counts = prf_per_label(confusion_counts(scored, per)).withColumns({"accuracy": accuracy(), "mcc": mcc()})
    # One row per group and label; every later step reads these rows and not the scores again.
    label_rows = cut_lineage(null_safe_join(counts, rank_metrics(scored, per), per))
    wide = label_rows.withColumns({c: F.col(c).cast("double") for c in COUNTS})
    long_labels = wide.unpivot(
        per,
        [*COUNTS, "precision", "recall", "f1", "kappa", "accuracy", "mcc", "roc_auc", "ap", "ndcg"],
        "metric",
        "value",
    )
    micro = curves.auc_and_ap(curves.ranked_counts(scored, by), by).select(
        *by, F.col("roc_auc").alias("roc_auc_micro"), F.col("ap").alias("ap_micro")
    )
    several = label_rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__labels")).where("__labels > 1")
    averages = prf_averages(label_rows.select(*per, *COUNTS), by)
    for more in (
        curves.rank_averages(label_rows, by, "roc_auc", "ap"),
        label_rows.groupBy(*by).agg(F.avg("ndcg").alias("ndcg_macro")),
        subset_accuracy(scored, by, row_key),
        micro,
    ):
        averages = null_safe_join(averages, more, by)
    averages = null_safe_join(averages, several, by, "left_semi")
    names = [c for c in averages.columns if c not in by]
    long_averages = averages.unpivot(by, names, "metric", "value").withColumn(label, F.lit(None).cast("string"))
    return long_labels.unionByName(long_averages)


# The averaged columns of the published metrics table.
AVERAGED = (
    *[f"{m}_{a}" for m in ("precision", "recall", "f1", "f2", "kappa") for a in ("macro", "weighted")],
    *["precision_micro", "recall_micro", "f1_micro", "mcc", "roc_auc_macro", "roc_auc_weighted", "roc_auc_micro"],
    *["ap_macro", "ap_weighted", "ap_micro", "ndcg_macro", "subset_accuracy"],
)


def metrics_row(detailed: DataFrame, by: Sequence[str], labels: Sequence[str], label: str = "label", digits: int | None = None) -> DataFrame:
    """`detailed_metrics` as one wide row per group, ready for `append_metrics`.

    Per label the counts, F1, recall and precision, then the averaged values; counts are whole numbers.
    """
    names = F.when(F.col(label).isNull(), F.col("metric")).otherwise(F.concat_ws("_", "metric", label))
    wanted = [f"{m}_{n}" for n in labels for m in (*COUNTS, "f1", "recall", "precision")] + list(AVERAGED)
    wide = detailed.select(*by, names.alias("__name"), "value").groupBy(*by).pivot("__name", wanted).agg(F.first("value"))
    counts = {f"{m}_{n}": F.col(f"{m}_{n}").cast("bigint") for n in labels for m in COUNTS}
    others = {} if digits is None else {c: F.round(c, digits) for c in wanted if c not in counts}
    return wide.withColumns({**counts, **others})


def tuned_predictions(
    scored: DataFrame,
    by: Sequence[str],
    tune: Column,
    metric: str = "f1",
    inclusive: bool = True,
) -> DataFrame:
    """Thresholds tuned on the rows where `tune` holds, applied to the others only.

    Returns the other rows with `threshold` and `pred`; the tuning rows never see their own cut.
    """
    by = list(by)
    cuts = curves.optimal_threshold(curves.ranked_counts(scored.where(tune), by), by, metric)
    held_out = scored.where(~tune)
    joined = null_safe_join(held_out, broadcast_if_small(cuts.select(*by, "threshold")), by)
    return joined.withColumn("pred", apply_threshold("score", F.col("threshold"), inclusive))


def confusion_argmax(
    df: DataFrame, row_key: str, labels: Sequence[str], by: Sequence[str] = (), none_class: str | None = None
) -> DataFrame:
    """Label x label counts after taking the first largest entry of each 0/1 vector.

    `df` holds arrays `truth` and `guess` in label order. An all-zero vector counts as the first
    label, or as `none_class` where that is given.
    """
    names = F.array(*[F.lit(x) for x in labels])

    def pick(vector: str) -> Column:
        first = F.element_at(names, F.array_position(vector, F.array_max(vector)).cast("int"))
        if none_class is None:
            return first
        return F.when(F.array_max(vector) == 0, F.lit(none_class)).otherwise(first)

    classes = [*labels] if none_class is None else [*labels, none_class]
    marked = df.select(*by, pick("truth").alias("true_label"), pick("guess").alias("__guess"))
    counted = marked.groupBy(*by, "true_label").agg(
        *[F.count_if(F.col("__guess") == name).alias(f"pred_{name}") for name in classes]
    )
    return counted


def class_distribution(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Positives, negatives and their percent shares per label, in one scan."""
    sums = df.agg(F.count(F.lit(1)).alias("total"), *[F.sum(F.col(c).cast("bigint")).alias(c) for c in labels])
    long = sums.unpivot(["total"], list(labels), "label", "n_pos")
    return long.select(
        "label",
        F.coalesce("n_pos", F.lit(0)).cast("bigint").alias("n_pos"),
        (F.col("total") - F.coalesce("n_pos", F.lit(0))).alias("n_neg"),
        F.try_divide(100.0 * F.col("n_pos"), F.col("total")).alias("pct_pos"),
        F.try_divide(100.0 * (F.col("total") - F.col("n_pos")), F.col("total")).alias("pct_neg"),
    )


def pos_weights(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Negatives per positive of each label; null without positives."""
    return class_distribution(df, labels).select(
        "label", "n_pos", "n_neg", F.try_divide(F.col("n_neg").cast("double"), "n_pos").alias("pos_weight")
    )


def default_pos_weight(df: DataFrame, labels: Sequence[str], given: float | Sequence[float] | None = None) -> DataFrame:
    """Weight table of a loss: derived from the data, one value for all labels, or one per label."""
    if given is None:
        return pos_weights(df, labels).select("label", "pos_weight")
    values = [float(given)] * len(labels) if isinstance(given, (int, float)) else [float(v) for v in given]
    if len(values) != len(labels):
        raise ValueError(f"{len(values)} weights for {len(labels)} labels")
    pairs = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(v).alias("pos_weight")) for n, v in zip(labels, values)])
    return df.sparkSession.range(1).select(F.inline(pairs))


def labelset_distribution(splits: DataFrame, by: Sequence[str] = ("run", "fold", "split")) -> DataFrame:
    """Share of every label combination inside each split; at most 2^labels rows per split."""
    by = list(by)
    counts = splits.groupBy(*by, "labelset").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("__total"))
    return null_safe_join(counts, sizes, by).select(*by, "labelset", "n", (F.col("n") / F.col("__total")).alias("share"))
