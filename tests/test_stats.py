import math
import random

import pytest
from pyspark.sql import functions as F

from labelloom.operators import runs, stats, trials


def test_chi2_survival(spark):
    # Known points of the distribution, and the exact forms for 1 and 2 degrees of freedom.
    points = [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (0.0, 4, 1.0), (9.0, 1, math.erfc(3 / 2**0.5)), (120.0, 2, math.exp(-60))]
    df = spark.createDataFrame([(x, d) for x, d, _ in points], "x double, d long")
    got = [r.p for r in df.select(stats.chi2_survival(F.col("x"), F.col("d")).alias("p")).collect()]
    assert got == [pytest.approx(p, abs=1e-7) for *_, p in points]


def test_friedman_by_hand(spark):
    # Ranks 1, 2, 3 in each of four folds: the largest statistic, n (k - 1) = 8.
    rows = [(f, m, float(v)) for f in range(4) for m, v in (("a", 3), ("b", 2), ("c", 1))]
    got = stats.friedman_test(spark.createDataFrame(rows, "fold int, model string, value double")).first()
    assert got.statistic == pytest.approx(8.0) and got.p_value == pytest.approx(math.exp(-4))


def test_friedman_needs_equal_folds(spark):
    rows = [(f, m, float(f + len(m))) for f in range(4) for m in ("a", "bb", "ccc") if (f, m) != (0, "a")]
    assert stats.friedman_test(spark.createDataFrame(rows, "fold int, model string, value double")).first().statistic is None


def test_tied_ranks(spark):
    df = spark.createDataFrame([(0, "a", 2.0), (0, "b", 2.0), (0, "c", 1.0)], "fold int, model string, value double")
    assert {r.model: r.rank for r in stats.fold_ranks(df).collect()} == {"a": 1.5, "b": 1.5, "c": 3.0}


def test_studentized_range():
    # Published critical values of the studentized range with infinite degrees of freedom.
    for k, q in ((2, 2.772), (3, 3.314), (5, 3.858), (10, 4.474)):
        assert stats._studentized_range_tail(q, k) == pytest.approx(0.05, abs=2e-4)


def test_nemenyi_agrees_with_critical_difference(spark):
    rng = random.Random(1)
    rows = [(f, f"m{m}", m * 0.3 + rng.random()) for f in range(9) for m in range(6)]
    pairs = stats.nemenyi_pairs(spark.createDataFrame(rows, "fold int, model string, value double")).collect()
    assert len(pairs) == 15
    assert all(r.significant == (r.rank_diff > r.critical_diff) for r in pairs)
    assert any(r.significant for r in pairs) and not all(r.significant for r in pairs)


@pytest.mark.parametrize("patience,threshold", [(3, 0.01), (2, 0.001), (1, 0.2)])
def test_early_stop_equals_sequential_counter(spark, patience, threshold):
    rng = random.Random(2)
    logs = {t: [round(rng.random(), 3) for _ in range(rng.randint(1, 15))] for t in range(25)}
    df = spark.createDataFrame([(t, e, v) for t, vs in logs.items() for e, v in enumerate(vs)], "t int, e int, v double")
    got = {r.t: r.stop_epoch for r in trials.early_stop_point(df, "t", "e", "v", patience, threshold).collect()}
    for t, values in logs.items():
        best, waited, stop = None, 0, None
        for e, v in enumerate(values):
            if best is None or (v > best and abs(v - best) > threshold):
                waited = 0
            else:
                waited += 1
            best = v if best is None else max(best, v)
            if waited >= patience:
                stop = e
                break
        assert got[t] == stop


def test_best_trial_scopes(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.2), (2, 1, 0.1), (2, 2, 0.5), (3, 2, 0.5)], "t int, i int, v double")
    assert trials.best_trial(df, "t", "i", "v").select("t", "v").first() == (2, 0.5)
    assert trials.best_trial(df, "t", "i", "v", scope="all").select("t", "v").first() == (1, 0.9)
    assert trials.best_trial(df, "t", "i", "v", mode="min").select("t", "v").first() == (1, 0.2)
    with pytest.raises(ValueError):
        trials.best_trial(df, "t", "i", "v", mode="best")


def test_row_mean_ignores_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r.m for r in df.select(runs.row_mean(["a", "b", "c"]).alias("m")).collect()] == [2.0, None]


def test_best_row_ties(spark):
    df = spark.createDataFrame([("g", "b", 1.0, 7), ("g", "a", 1.0, 8), ("g", "c", None, 9)], "g string, m string, v double, x int")
    assert tuple(runs.best_row_per_group(df, ["g"], "v", ["m"]).first()) == ("g", "a", 1.0, 8)
