"""The registered learners go over all runs and folds; `test_registry` runs them against their SQL."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from labelloom.operators import metrics
from suite import learning


def test_full_size():
    assert (learning.N_RUNS, learning.N_FOLDS, learning.TRIALS, learning.MAX_FEATURES) == (5, 5, 30, 10_000)


def test_learners_have_sql():
    names = {"linear_svm", "weighted_logistic", "embedding_classifier", "rf_grid", "param_search", "cross_validate"}
    assert names <= set(entry.queries()) & set(entry.oracle_sql())
    for name in names:
        assert "run" in entry.oracle_sql()[name] and "fold" in entry.oracle_sql()[name]


def test_agreement_below_chance_is_in_range(spark):
    counts = spark.createDataFrame([("m", 0, 0, "a", 1, 3, 3, 1), ("m", 0, 1, "a", 4, 0, 0, 4)], "model string, run int, fold int, label string, tn long, fp long, fn long, tp long")
    found = metrics.prf_averages(counts, ["model", "run", "fold"])
    assert min(r.mcc for r in found.collect()) < 0 and min(r.kappa_macro for r in found.collect()) < 0
    assert [r.ok for r in found.select(learning._metrics_in_range(found).alias("ok")).collect()] == [True, True]
    for name, value in (("mcc", -1.5), ("f1_macro", -0.1), ("kappa_macro", float("nan")), ("recall_micro", None)):
        wrong = found.withColumn(name, F.lit(value).cast("double"))
        assert [r.ok for r in wrong.select(learning._metrics_in_range(wrong).alias("ok")).collect()] == [False, False]
