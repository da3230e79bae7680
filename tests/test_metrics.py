import math
import random

import pytest
from pyspark.sql import functions as F

from labelloom.functions import losses
from labelloom.operators import curves, ensemble, metrics


def brute_auc(rows):
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total, ap, tp, n = sum(y for y, _ in rows), 0.0, 0, 0
    for score in sorted({s for _, s in rows}, reverse=True):
        at = [y for y, s in rows if s == score]
        tp, n = tp + sum(at), n + len(at)
        ap += sum(at) / total * tp / n
    return ap


def brute_ndcg(rows):
    rank, dcg = 0, 0.0
    for score in sorted({s for _, s in rows}, reverse=True):
        at = [y for y, s in rows if s == score]
        mean = sum(at) / len(at)
        for _ in at:
            rank += 1
            dcg += mean / math.log2(rank + 1)
    ideal = sum(1 / math.log2(i + 2) for i in range(sum(y for y, _ in rows)))
    return dcg / ideal


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    data = []
    for i in range(900):
        group = "hot" if rng.random() < 0.7 else "small"
        y = int(rng.random() < 0.3)
        data.append((i, group, y, round(min(0.99, max(0.01, rng.gauss(0.4 + 0.2 * y, 0.2))), 2)))
    return data


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, label string, y int, score double")


def of(rows, label):
    return [(r[2], r[3]) for r in rows if r[1] == label]


def test_rank_metrics_equal_brute_force(frame, rows):
    got = {r.label: r for r in metrics.rank_metrics(frame, ["label"]).collect()}
    for label in ("hot", "small"):
        assert got[label].roc_auc == pytest.approx(brute_auc(of(rows, label)))
        assert got[label].ap == pytest.approx(brute_ap(of(rows, label)))
        assert got[label].ndcg == pytest.approx(brute_ndcg(of(rows, label)))


def test_ndcg_over_several_chunks(frame, rows, monkeypatch):
    monkeypatch.setattr(curves, "_RANKS_PER_CHUNK", 7)
    got = {r.label: r.ndcg for r in curves.ndcg(curves.ranked_counts(frame, ["label"]), ["label"]).collect()}
    assert got["hot"] == pytest.approx(brute_ndcg(of(rows, "hot")))


def test_auc_of_reversed_scores(frame):
    up = curves.roc_auc(curves.ranked_counts(frame, ["label"]), ["label"]).collect()
    turned = frame.withColumn("score", -F.col("score"))
    down = {r.label: r.roc_auc for r in curves.roc_auc(curves.ranked_counts(turned, ["label"]), ["label"]).collect()}
    for r in up:
        assert r.roc_auc == pytest.approx(1 - down[r.label])


def test_single_class(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.7), ("b", 0, 0.1)], "label string, y int, score double")
    ranked = curves.ranked_counts(df, ["label"])
    assert {r.roc_auc for r in curves.roc_auc(ranked, ["label"]).collect()} == {0.0}
    assert {r.roc_auc for r in curves.roc_auc(ranked, ["label"], 0.5).collect()} == {0.5}
    assert {r.label: r.ap for r in curves.average_precision(ranked, ["label"]).collect()} == {"a": 1.0, "b": 0.0}
    assert {r.label: r.ndcg for r in curves.ndcg(ranked, ["label"]).collect()} == {"a": 1.0, "b": 0.0}


def test_thresholds_equal_search(frame, rows):
    ranked = curves.ranked_counts(frame, ["label"])
    got = {(r.label, r.metric): (r.threshold, r.value) for r in curves.optimal_thresholds(ranked, ["label"], curves.THRESHOLD_METRICS).collect()}
    for label in ("hot", "small"):
        data = of(rows, label)
        for metric in ("f1", "accuracy", "precision", "recall"):
            best = (-1.0, None)
            for cut in [math.inf, *sorted({s for _, s in data}, reverse=True)]:
                tp = sum(1 for y, s in data if y and s >= cut)
                fp = sum(1 for y, s in data if not y and s >= cut)
                fn = sum(1 for y, s in data if y and s < cut)
                tn = len(data) - tp - fp - fn
                value = {
                    "f1": 2 * tp / (2 * tp + fp + fn) if tp else 0.0,
                    "accuracy": (tp + tn) / len(data),
                    "precision": tp / (tp + fp) if tp + fp else 0.0,
                    "recall": tp / (tp + fn),
                }[metric]
                if value > best[0] + 1e-12:
                    best = (value, cut)
            assert got[label, metric][0] == best[1]
            assert got[label, metric][1] == pytest.approx(best[0])


def test_infinite_threshold_wins_for_accuracy(spark):
    df = spark.createDataFrame([("a", 0, 0.9), ("a", 0, 0.5), ("a", 1, 0.1)], "label string, y int, score double")
    best = curves.optimal_threshold(curves.ranked_counts(df, ["label"]), ["label"], "accuracy").first()
    assert best.threshold == math.inf and best.accuracy == pytest.approx(2 / 3)


def test_unknown_threshold_metric(frame):
    with pytest.raises(ValueError):
        curves.optimal_threshold(curves.ranked_counts(frame, ["label"]), ["label"], "speed")


# Published counts of one test fold (three labels) and the metrics published with them.
PUBLISHED = [("first", 590, 31, 19, 539), ("second", 783, 81, 22, 293), ("third", 843, 8, 113, 215)]


def test_published_fold(spark):
    counts = spark.createDataFrame(PUBLISHED, "label string, tn long, fp long, fn long, tp long")
    per = {r.label: r for r in metrics.prf_per_label(counts).collect()}
    assert per["first"].f1 == pytest.approx(0.9556737588652482)
    assert per["second"].precision == pytest.approx(0.7834224598930482)
    assert per["third"].recall == pytest.approx(0.6554878048780488)
    mean = metrics.prf_averages(counts, []).first()
    assert mean.f1_macro == pytest.approx(0.862193671831963)
    assert mean.f1_micro == pytest.approx(0.8842905405405406)
    assert mean.f1_weighted == pytest.approx(0.880222259657014)
    assert mean.recall_weighted == pytest.approx(0.8717735220649458)
    assert mean.precision_macro == pytest.approx(0.8977206851729614)
    assert mean.mcc == pytest.approx(0.8262774690639314)


def test_zero_division(spark):
    counts = spark.createDataFrame([("a", 5, 0, 0, 0), ("b", 0, 0, 4, 0)], "label string, tn long, fp long, fn long, tp long")
    for r in metrics.prf_per_label(counts).collect():
        assert (r.precision, r.recall, r.f1, r.kappa) == (0.0, 0.0, 0.0, 0.0)


def test_confusion_argmax_none_class(spark):
    df = spark.createDataFrame([(1, [0, 0], [0, 1]), (2, [1, 1], [1, 0])], "k long, truth array<int>, guess array<int>")
    plain = {r.true_label: (r.pred_a, r.pred_b) for r in metrics.confusion_argmax(df, "k", ["a", "b"]).collect()}
    assert plain == {"a": (1, 1)}
    marked = {r.true_label: (r.pred_a, r.pred_b, r.pred_none) for r in metrics.confusion_argmax(df, "k", ["a", "b"], none_class="none").collect()}
    assert marked == {"none": (0, 1, 0), "a": (1, 0, 0)}


def test_binary_group_has_no_averages(frame):
    one = metrics.detailed_metrics(frame.where("label = 'small'").withColumns({"pred": F.lit(1), "fold": F.lit(0)}), ["fold"], "k")
    assert one.where("label is null").count() == 0
    assert one.where("metric = 'recall'").first().value == 1.0


def test_weights(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "a int, b int")
    assert {r.label: r.pos_weight for r in metrics.pos_weights(df, ["a", "b"]).collect()} == {"a": 0.5, "b": None}
    assert {r.label: r.pos_weight for r in metrics.default_pos_weight(df, ["a", "b"], 2).collect()} == {"a": 2.0, "b": 2.0}
    assert {r.label: r.pos_weight for r in metrics.default_pos_weight(df, ["a", "b"], [1, 3]).collect()} == {"a": 1.0, "b": 3.0}
    with pytest.raises(ValueError):
        metrics.default_pos_weight(df, ["a", "b"], [1.0])


def test_losses_are_stable(spark):
    df = spark.createDataFrame([(800.0, 1), (-800.0, 1), (0.0, 0)], "x double, y int")
    bce = [r.v for r in df.select(losses.bce(F.col("x"), F.col("y"), 2.0).alias("v")).collect()]
    assert bce == [pytest.approx(0.0), pytest.approx(1600.0), pytest.approx(math.log(2))]
    focal = df.where("x = 0").select(losses.focal(F.col("x"), F.col("y")).alias("v")).first().v
    assert focal == pytest.approx(0.75 * 0.25 * math.log(2))


def test_scores_without_labels_are_an_error(spark):
    scores = spark.createDataFrame([(1, 0.5), (2, 0.5)], "k long, score double")
    truth = spark.createDataFrame([(1, 1)], "k long, y int")
    with pytest.raises(Exception, match="without a true label"):
        ensemble.join_predictions_labels(scores, truth, ["k"]).collect()
