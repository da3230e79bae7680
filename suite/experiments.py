"""Ensembles, run tables, rank tests, trial logs and terms."""

from pyspark.sql import functions as F

from labelloom.operators import corpus, curves, ensemble, runs, stats, terms, trials
from suite import adapters as A
from suite.adapters import FOLD_RUNS, LABELS, RUNS, SCORED, SCORED_MODELS, TRIALS, table, texts, with_
from suite.evaluation import AP, AUC_OR, F1, ranked_sql
from suite.registry import query, r8, rounded

# --- ensembles -------------------------------------------------------------------------------------

MEANS = """means AS (SELECT doc_id, fold, label, max(y) AS y, avg(score) AS score, count(DISTINCT model) AS n_models FROM scored_models GROUP BY doc_id, fold, label)"""
# Means of three binary fractions: a hair of slack keeps both engines on the same side of the cut.
SLACK = 0.5 + 1e-9


@query("ensemble_mean", with_(SCORED_MODELS, MEANS) + "SELECT doc_id, label, y, round(score, 8) AS score, CASE WHEN score > 0.500000001e0 THEN 1 ELSE 0 END AS pred FROM means WHERE n_models = 3")
def _(spark, sf):
    result = ensemble.ensemble_mean(A.scored_models(spark, sf), ["doc_id", "fold", "label"], threshold=SLACK)
    return rounded(result.select("doc_id", "label", "y", "score", "pred"), "score")


def _gaps(spark, sf):
    """Model gamma has scored only the labelled documents."""
    labelled = table(spark, sf, "labels").select("doc_id")
    data = A.scored_models(spark, sf)
    return data.where("model <> 'gamma'").unionByName(data.where("model = 'gamma'").join(labelled, "doc_id", "left_semi"))


@query(
    "align_model_scores",
    with_(SCORED_MODELS, MEANS)
    + "SELECT m.doc_id, m.label, CAST(3 AS BIGINT) AS n_models, round(score, 8) AS score FROM means m JOIN labels l ON m.doc_id = l.doc_id",
)
def _(spark, sf):
    aligned = ensemble.align_model_scores(_gaps(spark, sf), ["doc_id", "label"], missing="drop")
    return rounded(aligned.select("doc_id", "label", "n_models", "score"), "score")


@query(
    "unaligned_cells",
    "SELECT doc_id, label, CAST(2 AS BIGINT) AS n_models FROM documents, (VALUES ('quality'), ('toxic')) v(label) WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(spark, sf):
    return ensemble.unaligned_cells(_gaps(spark, sf), ["doc_id", "label"])


@query(
    "fold_model_mean",
    with_(SCORED_MODELS) + "SELECT doc_id, label, round(avg(score), 8) AS score, count(*) AS n_scores, CASE WHEN avg(score) > 0.500000001e0 THEN 1 ELSE 0 END AS pred FROM scored_models GROUP BY doc_id, label",
)
def _(spark, sf):
    # The three models stand for the fold models of one configuration.
    data = A.scored_models(spark, sf).withColumn("config", F.lit("base"))
    result = ensemble.fold_model_mean(data, ["config"], "doc_id", threshold=SLACK).drop("config")
    return rounded(result, "score")


@query(
    "join_predictions_labels",
    with_(SCORED) + "SELECT s.doc_id, s.label, round(score, 8) AS score, CASE WHEN s.label = 'quality' THEN quality ELSE toxic END AS y FROM scored s JOIN labels l ON s.doc_id = l.doc_id",
)
def _(spark, sf):
    truth = table(spark, sf, "labels").unpivot(["doc_id"], list(LABELS), "label", "y")
    scores = A.scored(spark, sf).select("doc_id", "label", "score").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return rounded(ensemble.join_predictions_labels(scores, truth, ["doc_id", "label"]), "score").select("doc_id", "label", "score", "y")


@query(
    "metric_per_fold",
    with_(SCORED_MODELS, ranked_sql("scored_models", ["model", "fold", "label"]))
    + f""", counted AS (SELECT model, fold, label, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn,
        count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM scored_models GROUP BY 1, 2, 3),
    f AS (SELECT model, fold, avg({F1}) AS f1 FROM counted GROUP BY 1, 2),
    r AS (SELECT model, fold, label, {AUC_OR.format("0.5e0")} AS auc, {AP} AS ap FROM ranked GROUP BY 1, 2, 3),
    g AS (SELECT model, fold, avg(auc) AS auc, avg(ap) AS ap FROM r GROUP BY 1, 2)
    SELECT f.model, f.fold, round(f1, 8) AS f1, round(auc, 8) AS roc_auc, round(ap, 8) AS ap FROM f JOIN g ON f.model = g.model AND f.fold = g.fold""",
)
def _(spark, sf):
    return rounded(ensemble.metric_per_fold(A.scored_models(spark, sf)), "f1", "roc_auc", "ap")


@query(
    "pooled_auc",
    with_(SCORED_MODELS, ranked_sql("scored_models", ["model", "label"]))
    + f"""SELECT model, round(avg(auc), 8) AS mean_auc, count(*) AS n_labels FROM (SELECT model, label, {AUC_OR.format("NULL")} AS auc FROM ranked GROUP BY 1, 2) WHERE auc IS NOT NULL GROUP BY model
    ORDER BY avg(auc) DESC LIMIT 10""",
)
def _(spark, sf):
    return rounded(curves.pooled_auc(A.scored_models(spark, sf)), "mean_auc")


# --- run tables ------------------------------------------------------------------------------------

M3 = ["m_mean", "m_high", "m_low"]


@query("filter_runs", with_(RUNS) + "SELECT model, fold, round(m_mean, 8) AS m_mean FROM runs WHERE loss_type = 'BCE' AND with_title")
def _(spark, sf):
    kept = runs.filter_runs(A.runs(spark, sf), "m_mean", loss_type="BCE", with_title=True)
    return rounded(kept.select("model", "fold", "m_mean"), "m_mean")


@query(
    "group_mean_metrics",
    with_(RUNS) + "SELECT model, loss_type, " + ", ".join(r8(f"avg({m})", m) for m in M3) + " FROM runs GROUP BY model, loss_type",
)
def _(spark, sf):
    return rounded(runs.group_mean_metrics(A.runs(spark, sf), ["model", "loss_type"], M3), *M3)


@query(
    "metric_summary",
    with_(RUNS) + "SELECT model, round(avg(m_mean), 5) AS mean, round(stddev_samp(m_mean), 5) AS std, count(m_mean) AS count, round(max(m_mean), 5) AS max FROM runs GROUP BY model",
)
def _(spark, sf):
    return runs.metric_summary(A.runs(spark, sf), ["model"], "m_mean", digits=5)


@query(
    "descriptive_ranking",
    with_(FOLD_RUNS) + "SELECT model, " + ", ".join([r8("avg(value)", "mean"), r8("stddev_pop(value)", "std"), r8("min(value)", "min"), r8("max(value)", "max")]) + ", count(*) AS n_folds FROM fold_runs GROUP BY model",
)
def _(spark, sf):
    return rounded(runs.descriptive_ranking(A.fold_runs(spark, sf), "model", "value"), "mean", "std", "min", "max")


@query(
    "confidence_interval",
    with_(FOLD_RUNS)
    + "SELECT model, count(*) AS n, "
    + ", ".join([r8("avg(value)", "mean"), r8("avg(value) - 1.959964e0 * stddev_samp(value) / sqrt(count(*))", "lower"), r8("avg(value) + 1.959964e0 * stddev_samp(value) / sqrt(count(*))", "upper")])
    + " FROM fold_runs GROUP BY model",
)
def _(spark, sf):
    return rounded(runs.confidence_interval(A.fold_runs(spark, sf), ["model"], "value"), "mean", "lower", "upper")


@query("median_by_model", "SELECT event_type AS model, round(quantile_cont(value, 0.5), 8) AS median FROM events GROUP BY event_type")
def _(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_type").alias("model"), "value")
    return rounded(runs.median_by_model(events, "model", "value"), "median")


@query(
    "box_stats",
    """WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
    SELECT q.event_type AS model, n, round(q1, 8) AS q1, round(median, 8) AS median, round(q3, 8) AS q3,
      round(min(value) FILTER (WHERE value BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)), 8) AS whisker_low,
      round(max(value) FILTER (WHERE value BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)), 8) AS whisker_high,
      count(*) FILTER (WHERE value NOT BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)) AS n_outliers
    FROM events e JOIN q ON e.event_type = q.event_type GROUP BY q.event_type, n, q1, median, q3""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_type").alias("model"), "value")
    return rounded(runs.box_stats(events, ["model"], "value"), "q1", "median", "q3", "whisker_low", "whisker_high")


@query(
    "row_mean_of_metrics",
    with_(RUNS)
    + """SELECT model, fold, loss_type, with_title, round((m_mean + m_high + CASE WHEN model = 'click' THEN 0 ELSE m_low END) / CASE WHEN model = 'click' THEN 2 ELSE 3 END, 8) AS row_mean FROM runs""",
)
def _(spark, sf):
    data = A.runs(spark, sf).withColumn("m_low", F.when(F.col("model") != "click", F.col("m_low")))
    return rounded(data.select("model", "fold", "loss_type", "with_title", runs.row_mean(M3).alias("row_mean")), "row_mean")


@query(
    "best_row_per_group",
    with_(RUNS) + "SELECT model, fold, loss_type, with_title, n_events FROM runs QUALIFY row_number() OVER (PARTITION BY fold ORDER BY m_mean DESC, model, loss_type, with_title) = 1",
)
def _(spark, sf):
    best = runs.best_row_per_group(A.runs(spark, sf), ["fold"], "m_mean", ["model", "loss_type", "with_title"])
    return best.select("model", "fold", "loss_type", "with_title", "n_events")


@query("best_config", with_(RUNS) + "SELECT model, with_title, round(avg(m_high), 8) AS m_high FROM runs GROUP BY 1, 2 ORDER BY avg(m_high) DESC, 1, 2 LIMIT 1")
def _(spark, sf):
    return rounded(runs.best_config(A.runs(spark, sf), ["model", "with_title"], "m_high"), "m_high")


@query(
    "category_ranking",
    with_(RUNS)
    + """, m AS (SELECT model, avg(m_mean) AS mean FROM runs GROUP BY model)
    SELECT model, round(mean, 8) AS mean, CAST(rank() OVER w AS INTEGER) AS rank, round(mean - lead(mean) OVER w, 8) AS gap FROM m WINDOW w AS (ORDER BY mean DESC, model)""",
)
def _(spark, sf):
    return rounded(runs.category_ranking(A.runs(spark, sf), "model", "m_mean"), "mean", "gap")


LONG = """long AS (SELECT model, 'mean' AS category, m_mean AS value FROM runs UNION ALL SELECT model, 'high', m_high FROM runs UNION ALL SELECT model, 'low', m_low FROM runs)"""


@query(
    "best_per_category",
    with_(RUNS, LONG)
    + """, b AS (SELECT category, model, max(value) AS best FROM long GROUP BY 1, 2)
    SELECT category, model, round(best, 8) AS best, CAST(row_number() OVER (PARTITION BY category ORDER BY best DESC, model) AS INTEGER) AS rank FROM b QUALIFY rank <= 3""",
)
def _(spark, sf):
    long = runs.unpivot_metrics(A.runs(spark, sf), ["model"], M3, "m_")
    return rounded(runs.best_per_category(long, "category", "model", "value"), "best")


@query(
    "ablation_delta",
    with_(RUNS)
    + """SELECT model, round(avg(m_high) FILTER (WHERE with_title), 8) AS "with", round(avg(m_high) FILTER (WHERE NOT with_title), 8) AS without,
    round(avg(m_high) FILTER (WHERE with_title) - avg(m_high) FILTER (WHERE NOT with_title), 8) AS delta FROM runs GROUP BY model""",
)
def _(spark, sf):
    return rounded(runs.ablation_delta(A.runs(spark, sf), "with_title", "m_high", ["model"]), "with", "without", "delta")


@query("best_level", with_(RUNS) + "SELECT loss_type, round(avg(m_mean), 8) AS m_mean FROM runs GROUP BY 1 ORDER BY avg(m_mean) DESC, 1 LIMIT 1")
def _(spark, sf):
    return rounded(runs.best_level(A.runs(spark, sf), "loss_type", "m_mean"), "m_mean")


@query(
    "overall_distribution",
    with_(RUNS)
    + "SELECT count(*) AS n, "
    + ", ".join([r8("avg(m_mean)", "mean"), r8("stddev_pop(m_mean)", "std"), r8("min(m_mean)", "min"), r8("max(m_mean)", "max"), r8("max(m_mean) - min(m_mean)", "range")])
    + " FROM runs",
)
def _(spark, sf):
    return rounded(runs.overall_distribution(A.runs(spark, sf), "m_mean"), "mean", "std", "min", "max", "range")


@query("complete_models", with_(FOLD_RUNS) + "SELECT model, fold FROM fold_runs WHERE model <> 'click'")
def _(spark, sf):
    gap = (F.col("model") == "click") & (F.col("fold") == 2)
    data = A.fold_runs(spark, sf).withColumn("value", F.when(~gap, F.col("value")))
    return runs.complete_models(data, "model", "fold", "value").select("model", "fold")


@query(
    "topk_models",
    with_(RUNS) + "SELECT model, fold, loss_type, with_title FROM runs WHERE model IN (SELECT model FROM runs GROUP BY model ORDER BY avg(m_mean) DESC LIMIT 3)",
)
def _(spark, sf):
    return runs.topk_models(A.runs(spark, sf), "model", "m_mean", 3).select("model", "fold", "loss_type", "with_title")


@query(
    "ranked_head_tail",
    with_(RUNS)
    + """, m AS (SELECT model, loss_type, with_title, avg(m_mean) AS mean FROM runs GROUP BY 1, 2, 3)
    SELECT *, 'best' AS "end" FROM (SELECT model, loss_type, with_title, round(mean, 8) AS mean FROM m ORDER BY m.mean DESC, 1, 2, 3 LIMIT 5)
    UNION ALL SELECT *, 'worst' FROM (SELECT model, loss_type, with_title, round(mean, 8) AS mean FROM m ORDER BY m.mean, 1, 2, 3 LIMIT 5)""",
)
def _(spark, sf):
    return rounded(runs.ranked_head_tail(A.runs(spark, sf), ["model", "loss_type", "with_title"], "m_mean"), "mean")


@query("unpivot_metrics", with_(RUNS, LONG) + "SELECT model, category, round(value, 8) AS value FROM long")
def _(spark, sf):
    return rounded(runs.unpivot_metrics(A.runs(spark, sf), ["model"], M3, "m_"), "value")


@query(
    "pivot_metrics",
    with_(RUNS) + "SELECT model, " + ", ".join([r8("avg(m_mean)", "mean"), r8("avg(m_high)", "high"), r8("avg(m_low)", "low")]) + " FROM runs GROUP BY model",
)
def _(spark, sf):
    long = runs.unpivot_metrics(A.runs(spark, sf), ["model"], M3, "m_")
    return rounded(runs.pivot_metrics(long, "model", "category", ["mean", "high", "low"]), "mean", "high", "low")


@query(
    "minmax_normalize",
    with_(FOLD_RUNS)
    + """SELECT model, fold, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 8) AS norm_all,
    round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 8) AS norm_fold FROM fold_runs WINDOW w AS (PARTITION BY fold)""",
)
def _(spark, sf):
    data = runs.minmax_normalize(A.fold_runs(spark, sf), "value", out="norm_all")
    data = runs.minmax_normalize(data, "value", ["fold"], "norm_fold")
    return rounded(data.select("model", "fold", "norm_all", "norm_fold"), "norm_all", "norm_fold")


# --- rank tests ------------------------------------------------------------------------------------

# Rounded values, so that models tie in some folds.
TIED = """tied_runs AS (SELECT model, fold, round(value, 2) AS value FROM fold_runs),
ranks AS (SELECT fold, model, value, rank() OVER (PARTITION BY fold ORDER BY value DESC) + (count(*) OVER (PARTITION BY fold, value) - 1) / 2.0e0 AS rank FROM tied_runs),
size AS (SELECT CAST(count(DISTINCT model) AS DOUBLE) AS k, CAST(count(DISTINCT fold) AS DOUBLE) AS n FROM tied_runs)"""


def _tied(spark, sf):
    return A.fold_runs(spark, sf).withColumn("value", F.round("value", 2))


@query("fold_ranks", with_(FOLD_RUNS, TIED) + "SELECT fold, model, value, rank FROM ranks")
def _(spark, sf):
    return stats.fold_ranks(_tied(spark, sf))


@query("mean_ranks", with_(FOLD_RUNS, TIED) + "SELECT model, round(avg(rank), 8) AS mean_rank, count(*) AS n_folds FROM ranks GROUP BY model")
def _(spark, sf):
    return rounded(stats.mean_ranks(_tied(spark, sf)), "mean_rank")


@query(
    "friedman_test",
    with_(FOLD_RUNS, TIED)
    + """, s AS (SELECT sum(r * r) AS sq FROM (SELECT sum(rank) AS r FROM ranks GROUP BY model)),
    t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM ranks GROUP BY fold, value)),
    f AS (SELECT n, k, (12 / (n * k * (k + 1)) * sq - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS x FROM s, t, size)
    SELECT CAST(n AS BIGINT) AS n_folds, CAST(k AS BIGINT) AS n_models, round(x, 8) AS statistic, round(exp(-x / 2) * (1 + x / 2), 8) AS p_value FROM f""",
)
def _(spark, sf):
    # Five models: the oracle's closed form holds for four degrees of freedom.
    return rounded(stats.friedman_test(_tied(spark, sf)), "statistic", "p_value")


@query(
    "nemenyi_pairs",
    with_(FOLD_RUNS, TIED)
    + """, m AS (SELECT model, avg(rank) AS r FROM ranks GROUP BY model),
    qs AS (SELECT a.model AS model_a, b.model AS model_b, k, abs(a.r - b.r) / sqrt(k * (k + 1) / (6 * n)) AS q FROM m a JOIN m b ON a.model < b.model, size),
    grid AS (SELECT *, -9 + i * 0.002e0 AS z, q * sqrt(2.0e0) AS w FROM qs, (SELECT unnest(range(0, 9001)) AS i)),
    below AS (
        SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) AS f,
            sum(exp(-z * z / 2)) OVER o / sqrt(2 * pi()) * 0.002e0 - exp(-z * z / 2) / sqrt(2 * pi()) * 0.001e0 AS c,
            sum(exp(-(z - w) * (z - w) / 2)) OVER o / sqrt(2 * pi()) * 0.002e0 - exp(-(z - w) * (z - w) / 2) / sqrt(2 * pi()) * 0.001e0 AS d
        FROM grid WINDOW o AS (PARTITION BY model_a, model_b ORDER BY i)
    ), tails AS (SELECT model_a, model_b, any_value(q) AS q, 1 - sum(k * f * (c - d) ** (k - 1)) * 0.002e0 AS p FROM below GROUP BY model_a, model_b)
    SELECT a.model AS model_a, b.model AS model_b, round(abs(a.r - b.r), 8) AS rank_diff, round(2.728e0 * sqrt(k * (k + 1) / (6 * n)), 8) AS critical_diff,
      round(q, 8) AS q, abs(a.r - b.r) > 2.728e0 * sqrt(k * (k + 1) / (6 * n)) AS significant, round(p, 6) AS p_value
    FROM m a JOIN m b ON a.model < b.model JOIN tails ON model_a = a.model AND model_b = b.model, size""",
)
def _(spark, sf):
    pairs = rounded(stats.nemenyi_pairs(_tied(spark, sf)), "rank_diff", "critical_diff", "q")
    return rounded(pairs, "p_value", digits=6)


@query(
    "critical_groups",
    with_(FOLD_RUNS, TIED)
    + """, m AS (SELECT model, avg(rank) AS r FROM ranks GROUP BY model),
    p AS (SELECT model, r, row_number() OVER (ORDER BY r, model) AS pos FROM m),
    e AS (SELECT a.pos, max(b.pos) AS last FROM p a JOIN p b ON b.r >= a.r AND b.r <= a.r + (SELECT 2.728e0 * sqrt(k * (k + 1) / (6 * n)) FROM size) GROUP BY a.pos),
    g AS (
        SELECT pos, last, row_number() OVER (ORDER BY pos) AS grp FROM e
        WHERE last > pos AND NOT EXISTS (SELECT 1 FROM e o WHERE o.pos < e.pos AND o.last >= e.last)
    )
    SELECT CAST(grp AS INTEGER) AS "group", model, round(r, 8) AS mean_rank, CAST(last - g.pos + 1 AS INTEGER) AS n_models FROM g JOIN p ON p.pos BETWEEN g.pos AND last""",
)
def _(spark, sf):
    return rounded(stats.critical_groups(_tied(spark, sf)), "mean_rank")


# --- trial logs ------------------------------------------------------------------------------------


@query("trial_last_value", with_(TRIALS) + "SELECT trial_id, arg_max(metric, iteration) AS metric FROM trials GROUP BY trial_id")
def _(spark, sf):
    return trials.trial_last_value(A.trials(spark, sf), "trial_id", "iteration", "metric")


@query(
    "best_trial",
    with_(TRIALS)
    + """, l AS (SELECT trial_id, arg_max(metric, iteration) AS metric FROM trials GROUP BY trial_id)
    SELECT 'last' AS scope, * FROM (SELECT trial_id, metric FROM l ORDER BY metric DESC, trial_id LIMIT 1)
    UNION ALL SELECT 'all', * FROM (SELECT trial_id, max(metric) AS metric FROM trials GROUP BY trial_id ORDER BY 2 DESC, 1 LIMIT 1)""",
)
def _(spark, sf):
    log = A.trials(spark, sf)
    scopes = [trials.best_trial(log, "trial_id", "iteration", "metric", scope=s).select(F.lit(s).alias("scope"), "trial_id", "metric") for s in ("last", "all")]
    return corpus.union_sets(*scopes)


SERIES = """train_log AS (SELECT * FROM trials WHERE kind IN ('click', 'view')), eval_log AS (SELECT * FROM trials WHERE kind NOT IN ('click', 'view')),
series AS (SELECT t.trial_id, t.epoch, train_value, eval_value FROM (SELECT trial_id, epoch, arg_min(metric, iteration) AS train_value FROM train_log GROUP BY 1, 2) t
  JOIN (SELECT trial_id, epoch, arg_min(metric, iteration) AS eval_value FROM eval_log GROUP BY 1, 2) e ON t.trial_id = e.trial_id AND t.epoch = e.epoch)"""


def _series(spark, sf):
    log = A.trials(spark, sf)
    train = F.col("kind").isin("click", "view")
    return trials.epoch_series(log.where(train), log.where(~train), "trial_id", "iteration", "epoch", "metric")


@query("epoch_series", with_(TRIALS, SERIES) + "SELECT trial_id, epoch, train_value, eval_value FROM series")
def _(spark, sf):
    return _series(spark, sf)


@query(
    "best_and_final_epoch",
    with_(TRIALS, SERIES)
    + """SELECT trial_id, arg_max(eval_value, epoch) AS final_value, max(eval_value) AS best_value,
    CAST(arg_min(epoch, {'v': -eval_value, 'e': epoch}) AS INTEGER) AS best_epoch FROM series GROUP BY trial_id""",
)
def _(spark, sf):
    return trials.best_and_final_epoch(_series(spark, sf), "trial_id", "epoch", "eval_value")


@query(
    "early_stop_point",
    with_(TRIALS, SERIES).replace("WITH", "WITH RECURSIVE", 1)
    + """, seq AS (SELECT trial_id, epoch, eval_value AS v, row_number() OVER (PARTITION BY trial_id ORDER BY epoch) AS i FROM series),
    step(trial_id, i, epoch, best, waited) AS (
      SELECT trial_id, i, epoch, v, 0 FROM seq WHERE i = 1
      UNION ALL SELECT s.trial_id, s.i, s.epoch, greatest(p.best, s.v), CASE WHEN s.v - p.best > 0.5e0 THEN 0 ELSE p.waited + 1 END
      FROM step p JOIN seq s ON s.trial_id = p.trial_id AND s.i = p.i + 1)
    SELECT trial_id, CAST(min(epoch) FILTER (WHERE waited >= 3) AS INTEGER) AS stop_epoch, count(*) AS n_epochs FROM step GROUP BY trial_id""",
)
def _(spark, sf):
    return trials.early_stop_point(_series(spark, sf), "trial_id", "epoch", "eval_value", patience=3, threshold=0.5)


@query(
    "running_best_trial",
    with_(TRIALS)
    + """, f AS (SELECT trial_id, max(iteration) AS finished_at, max(metric) AS best FROM trials GROUP BY trial_id),
    r AS (SELECT *, max(best) OVER (ORDER BY finished_at, trial_id) AS best_so_far FROM f) SELECT *, best < best_so_far AS removable FROM r""",
)
def _(spark, sf):
    finished = A.trials(spark, sf).groupBy("trial_id").agg(F.max("iteration").alias("finished_at"), F.max("metric").alias("best"))
    return trials.running_best_trial(finished, "trial_id", "finished_at", "best")


@query("param_grid_mean", with_(TRIALS) + "SELECT alpha, gamma, round(avg(metric), 8) AS mean FROM trials GROUP BY alpha, gamma")
def _(spark, sf):
    return rounded(trials.param_grid_mean(A.trials(spark, sf), "alpha", "gamma", "metric"), "mean")


# --- terms -----------------------------------------------------------------------------------------

STOP_WORDS = ("the", "of", "and", "in", "to", "is", "for", "on", "with", "that", "de", "la", "le", "les", "et", "der", "die", "und", "el", "que")
IN_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
TOKENS = r"""tokens AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda w: w NOT IN """ + IN_STOP + """) AS w FROM documents)"""
COUNTS = """grams AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tokens),
counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY 1, 2)"""
VOCAB = """vocab AS (SELECT term, df, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM (
  SELECT term, sum(tf) AS cf, count(*) AS df FROM counts GROUP BY term ORDER BY cf DESC, term LIMIT 10000))"""


@query("token_features", with_(TOKENS, COUNTS) + "SELECT doc_id, term, tf FROM counts")
def _(spark, sf):
    return terms.term_counts(texts(spark, sf), "doc_id", "text", STOP_WORDS)


@query("tfidf_vocabulary", with_(TOKENS, COUNTS, VOCAB) + "SELECT term, row_number() OVER (ORDER BY term) - 1 AS index, df, round(idf, 8) AS idf FROM vocab")
def _(spark, sf):
    docs = texts(spark, sf)
    vocabulary = terms.fit_vocabulary(terms.term_counts(docs, "doc_id", "text", STOP_WORDS), docs, 10_000)
    return rounded(vocabulary.select("term", F.col("index").cast("bigint").alias("index"), "df", "idf"), "idf")


@query(
    "tfidf",
    with_(TOKENS, COUNTS, VOCAB)
    + """, w AS (SELECT doc_id, term, tf * idf AS x FROM counts JOIN vocab USING (term))
    SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 8) AS weight FROM w""",
)
def _(spark, sf):
    counted = terms.counted_documents(texts(spark, sf), "doc_id", "text", STOP_WORDS)
    counts = terms.unfolded_terms(counted, "doc_id")
    return rounded(terms.tfidf(counts, terms.fit_vocabulary(counts, counted, 10_000), "doc_id"), "weight")


@query("max_sequence_length", r"SELECT CAST(max(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'))) AS INTEGER) AS max_tokens FROM documents")
def _(spark, sf):
    return terms.max_sequence_length(texts(spark, sf), "text")
