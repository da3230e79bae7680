"""No caps and no silent losses: null groups, missing cells, many models and labels, small tails."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelloom import session
from labelloom.functions import text
from labelloom.operators import corpus, curves, ensemble, folds, metrics, ordering, stats, trials
from labelloom.plans import learning


def cells(spark, rows):
    return spark.createDataFrame(rows, "k int, model string, label string, y int, score double")


def test_null_groups_keep_their_rows(spark):
    rows = spark.createDataFrame([(None, 0.9, 1), (None, 0.2, 0), ("a", 0.8, 1), ("a", 0.1, 0)], "g string, score double, y int")
    ranked = curves.ranked_counts(rows, ["g"])
    assert ranked.count() == 4
    assert {r.g: r.roc_auc for r in curves.roc_auc(ranked, ["g"]).collect()} == {None: 1.0, "a": 1.0}
    assert {r.g for r in curves.ndcg(ranked, ["g"]).collect()} == {None, "a"}
    placed = ordering.digest_positions(rows.withColumn("d", F.md5(F.col("score").cast("string"))), "d", ["g"])
    assert sorted((r.g or "", r.pos) for r in placed.collect()) == [("", 0), ("", 1), ("a", 0), ("a", 1)]
    quantiles = ordering.exact_quantiles(rows, ["g"], "score", {"q": 0.5})
    assert {r.g: round(r.q, 3) for r in quantiles.collect()} == {None: 0.55, "a": 0.45}
    frame = rows.withColumns({"label": F.lit("x"), "fold": F.lit(0), "model": F.col("g"), "pred": (F.col("score") > 0.5).cast("int")})
    assert ensemble.metric_per_fold(frame).count() == 2


def test_null_groups_in_detailed_metrics(spark):
    rows = [(g, k, label, k % 2, 0.1 * k + (label == "a") * 0.05, int(k > 2)) for g in (None, "m") for k in range(6) for label in "ab"]
    frame = spark.createDataFrame(rows, "g string, k int, label string, y int, score double, pred int")
    detailed = metrics.detailed_metrics(frame, ["g"], "k")
    per_group = {r.g: r["count"] for r in detailed.groupBy("g").count().collect()}
    assert per_group[None] == per_group["m"]
    wide = {r.g: r for r in metrics.metrics_row(detailed, ["g"], ["a", "b"]).collect()}
    assert wide[None].tp_a + wide[None].fn_a == 3 and wide[None].f1_macro == wide["m"].f1_macro


def test_a_missing_cell_is_an_error(spark):
    whole = [(k, m, "a", 1, 0.5) for k in range(4) for m in ("x", "y")]
    assert ensemble.ensemble_mean(cells(spark, whole), ["k", "label"]).count() == 4
    for lost in (whole[:-1], [r for r in whole if not (r[1] == "y" and r[0] > 1)]):  # a cell, a whole fold
        with pytest.raises(PySparkException, match="unaligned_cells"):
            ensemble.ensemble_mean(cells(spark, lost), ["k", "label"]).collect()
        dropped = ensemble.align_model_scores(cells(spark, lost), ["k", "label"], missing="drop")
        assert dropped.count() + ensemble.unaligned_cells(cells(spark, lost), ["k", "label"]).count() == 4


def test_scores_and_labels_must_match_on_both_sides(spark):
    scores = spark.createDataFrame([(1, 0.5)], "k int, score double")
    for truth in ([(1, 1), (2, 0)], [(2, 0)], []):
        with pytest.raises(PySparkException, match="without"):
            ensemble.join_predictions_labels(scores, spark.createDataFrame(truth, "k int, y int"), ["k"]).collect()


def test_mean_of_margins_is_refused_and_calibrated_margins_are_averaged(spark):
    rows = [(k, m, "a", k % 2, (4.0 if k % 2 else -3.0) + 0.3 * (k % 5) if m == "svm" else 0.2 + 0.5 * (k % 2)) for k in range(60) for m in ("svm", "lr")]
    frame = cells(spark, rows).withColumns({"split": F.when(F.col("k") < 30, "dev").otherwise("test"), "run": F.lit(0), "fold": F.lit(0)})
    frame = frame.withColumn("pred", F.lit(0))
    with pytest.raises(PySparkException, match="probabilities"):
        learning.evaluate_with_ensemble(frame, "k").collect()
    svm = learning.platt_scores(frame.where("model = 'svm'"), F.col("split") == "dev", ["a"])
    scored = {r.k: r.score for r in svm.collect()}
    assert all(0 <= s <= 1 for s in scored.values()) and all((scored[k] > 0.5) == (k % 2 == 1) for k in range(60))
    mean = ensemble.align_model_scores(frame.where("model = 'lr'").unionByName(svm), ["k", "label"])
    for r in mean.collect():
        assert abs(r.score - (scored[r.k] + 0.2 + 0.5 * (r.k % 2)) / 2) < 1e-12
    assert {r.model for r in learning.evaluate_with_ensemble(frame.where("model = 'lr'").unionByName(svm), "k").collect()} == {"svm", "lr", "Ensemble"}


def test_eleven_models_and_more(spark):
    rows = [(f, f"m{m:02d}", float((m * 7 + f * 3) % 11) + m) for f in range(5) for m in range(11)]
    pairs = stats.nemenyi_pairs(spark.createDataFrame(rows, "fold int, model string, value double"))
    got = pairs.collect()
    assert len(got) == 55 and all(r.critical_diff > 0 and r.model_a < r.model_b for r in got)
    assert all((r.rank_diff > r.critical_diff) == r.significant for r in got)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("alpha", [0.05, 0.10])
def test_computed_critical_values_agree_with_the_published_ones(alpha):
    for k, known in enumerate(stats.NEMENYI_CRITICAL[alpha], 2):
        assert abs(stats._critical(alpha, k) - known) < 2e-3


@pytest.mark.parametrize(("x", "df", "tail"), [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (14.067140449340167, 7, 0.05)])
def test_published_tails(x, df, tail):
    assert abs(stats._chi2_tail(x, df) - tail) < 1e-12


def test_small_tails_are_no_noise():
    assert math.isclose(stats._chi2_tail(100.0, 2), math.exp(-50), rel_tol=1e-12)
    assert math.isclose(stats._chi2_tail(100.0, 1), math.erfc(math.sqrt(50)), rel_tol=1e-12)
    assert math.isclose(stats._chi2_tail(100.0, 4), math.exp(-50) * 51, rel_tol=1e-12)
    # two normals: the range is the absolute value of a normal with variance two
    assert math.isclose(stats._studentized_range_tail(12.0, 2), math.erfc(6.0), rel_tol=1e-6)


def test_seventeen_labels(spark):
    labels = [f"l{i}" for i in range(17)]
    rows = [(k, *[int(k % (i + 2) == 0) for i in range(17)]) for k in range(60)]
    frame = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} int" for n in labels))
    assert folds.stratified_kfold(frame, "k", labels, 3).count() == 60


def test_broadcast_only_below_both_bounds(spark):
    frame = spark.createDataFrame([("x" * 100,)] * 20, "t string")

    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    assert hinted(session.broadcast_if_small(frame))
    assert not hinted(session.broadcast_if_small(frame, max_rows=19))
    assert not hinted(session.broadcast_if_small(frame, max_bytes=1000))
    assert hinted(session.broadcast_if_small(frame.select(F.array("t").alias("a"))))


def test_best_trial_brings_its_parameters(spark):
    log = spark.createDataFrame([(1, 0, 0.1, 0.5), (1, 1, 0.1, 0.7), (2, 0, 0.9, 0.8), (2, 1, 0.9, 0.6)], "t int, i int, alpha double, m double")
    assert trials.best_trial(log, "t", "i", "m").first().asDict() == {"t": 1, "i": 1, "alpha": 0.1, "m": 0.7}
    assert trials.best_trial(log, "t", "i", "m", scope="all").first().asDict() == {"t": 2, "i": 0, "alpha": 0.9, "m": 0.8}


def test_templates_are_the_callers(spark):
    frame = spark.createDataFrame([("a", "b")], "x string, y string")
    assert frame.select(text.prompt_text("On {topic}: {text}!", "x", "y")).first()[0] == "On b: a!"


def test_samples_read_their_input_twice_and_keep_texts_in_place(spark, tmp_path):
    rows = [(k, "text " * 20, int(k % 9 == 0)) for k in range(200)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "k int, body string, a int").write.parquet(path)
    frame = spark.read.parquet(path)
    sample = corpus.undersample_negatives(frame, "k", ["a"], 2)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert sample.count() == 23 * 3 and plan.count("Scan parquet") == 1
    assert all("body" not in line for line in plan.splitlines() if "Exchange" in line)
    assert corpus.undersample_negatives(frame, "k", ["a"], 50).count() == 200
    assert corpus.shuffle_positions(frame, "k").columns == ["k", "shuffle_pos"]
    listed = spark.createDataFrame([("text " * 20,)], "t string")
    assert corpus.anti_join_positives(frame, listed, {"body": "t"}).count() == 0
