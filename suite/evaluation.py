"""Folds, counts, ranking metrics, thresholds, losses and ensembles."""

from pyspark.sql import functions as F

from labelloom.functions import losses
from labelloom.operators import curves, folds, metrics
from labelloom.session import cut_lineage
from suite.adapters import (
    LABELS, PUBS, SCORED, SCORED_MODELS, pubs, scored, scored_models, table, with_,
)
from suite.registry import query, r8, rounded

# --- folds -----------------------------------------------------------------------------------------

FOLDS = """keyed AS (
  SELECT doc_id, run, concat(quality, '|', toxic) AS labelset, md5(concat('42-', run, '-', doc_id)) AS dig
  FROM pubs, (VALUES (0), (1)) r(run)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY run, labelset ORDER BY dig) - 1 AS set_pos,
         count(*) OVER (PARTITION BY run, labelset) AS set_n
  FROM keyed),
folds AS (
  SELECT doc_id, run, labelset, dig, set_pos,
         CAST((row_number() OVER (PARTITION BY run ORDER BY set_n, labelset, dig) - 1) % 5 AS INTEGER) AS fold
  FROM placed),
ranked_out AS (
  SELECT f.doc_id, f.run, k.fold, f.labelset,
         row_number() OVER (PARTITION BY f.run, k.fold, f.labelset ORDER BY f.dig) - 1 AS q
  FROM folds f, (VALUES (0), (1), (2), (3), (4)) k(fold) WHERE f.fold <> k.fold),
splits AS (
  SELECT doc_id, run, fold, labelset,
         CASE WHEN ((q + 1) * 30) // 100 > (q * 30) // 100 THEN 'dev' ELSE 'train' END AS split
  FROM ranked_out
  UNION ALL SELECT doc_id, run, fold, labelset, 'test' FROM folds)"""


def _splits(spark, sf):
    return folds.train_dev_test(pubs(spark, sf), "doc_id", LABELS, n_folds=5, n_runs=2, seed=42)


@query("stratified_kfold", with_(PUBS, FOLDS) + "SELECT doc_id, run, labelset, fold FROM folds")
def _(spark, sf):
    return folds.stratified_kfold(pubs(spark, sf), "doc_id", LABELS, 5, 2, 42).select("doc_id", "run", "labelset", "fold")


TAGS = [f"src{k}" for k in range(20)] + ["quality", "toxic"]
TAGGED = "tagged AS (SELECT p.doc_id, " + ", ".join(
    [f"CASE WHEN p.doc_id * 7919 % 1009 % {7 + k} = 0 THEN 1 ELSE 0 END AS src{k}" for k in range(20)] + ["quality", "toxic"]
) + " FROM pubs p)"


@query(
    "quota_folds",
    with_(PUBS, TAGGED)
    + "SELECT run, label, n_pos, TRUE AS balanced, TRUE AS close_to_share FROM (VALUES (0), (1)) r(run) CROSS JOIN ("
    + " UNION ALL ".join(f"SELECT '{t}' AS label, CAST(sum({t}) AS BIGINT) AS n_pos FROM tagged" for t in TAGS)
    + ")",
)
def _(spark, sf):
    """22 labels, nearly as many label sets as rows: fold counts of every label."""
    marks = [F.when(F.col("doc_id") * 7919 % 1009 % (7 + k) == 0, 1).otherwise(0).alias(f"src{k}") for k in range(20)]
    data = pubs(spark, sf).select("doc_id", *marks, "quality", "toxic")
    found = folds.label_balance(folds.quota_kfold(data, "doc_id", TAGS, 5, 2), TAGS, 5)
    share = F.col("n_pos") / 5
    close = (F.col("least") > share - 3) & (F.col("most") < share + 3)
    return found.select("run", "label", "n_pos", (F.col("most") - F.col("least") <= 3).alias("balanced"), close.alias("close_to_share"))


@query("train_dev_split", with_(PUBS, FOLDS) + "SELECT doc_id, run, fold, split FROM splits")
def _(spark, sf):
    return _splits(spark, sf).select("doc_id", "run", "fold", "split")


@query(
    "run_seeds",
    with_(PUBS, FOLDS) + "SELECT run, concat('42-', run) AS seed, min(dig) AS first_digest FROM keyed GROUP BY run",
)
def _(spark, sf):
    seeds = folds.run_seeds(42, 2)
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("run"), F.lit(s).alias("seed")) for i, s in enumerate(seeds)]))
    keyed = pubs(spark, sf).select("doc_id", named.alias("r")).select("doc_id", "r.*")
    digest = F.md5(F.concat_ws("-", "seed", "doc_id").cast("binary"))
    return keyed.groupBy("run", "seed").agg(F.min(digest).alias("first_digest"))


@query(
    "fold_report",
    with_(PUBS, FOLDS)
    + """SELECT run, fold, split, count(*) AS n,
         CAST(sum(CAST(split_part(labelset, '|', 1) AS INTEGER)) AS BIGINT) AS n_quality,
         CAST(sum(CAST(split_part(labelset, '|', 2) AS INTEGER)) AS BIGINT) AS n_toxic
    FROM splits GROUP BY run, fold, split""",
)
def _(spark, sf):
    return folds.fold_report(_splits(spark, sf), "doc_id", LABELS)


@query(
    "fold_overlap",
    with_(PUBS, FOLDS)
    + """SELECT run, fold, count(*) FILTER (WHERE c > 1) AS repeated, CAST(sum(t) AS BIGINT) AS n_test, count(*) AS n_keys
    FROM (SELECT run, fold, doc_id, count(*) AS c, count(*) FILTER (WHERE split = 'test') AS t FROM splits GROUP BY 1, 2, 3)
    GROUP BY run, fold""",
)
def _(spark, sf):
    return folds.overlap_report(_splits(spark, sf), "doc_id")


@query(
    "labelset_distribution",
    with_(PUBS, FOLDS)
    + "SELECT run, fold, split, labelset, count(*) AS n, "
    + r8("count(*) / CAST(sum(count(*)) OVER (PARTITION BY run, fold, split) AS DOUBLE)", "share")
    + " FROM splits GROUP BY run, fold, split, labelset",
)
def _(spark, sf):
    return rounded(metrics.labelset_distribution(_splits(spark, sf)), "share")


@query(
    "fold_select",
    with_(PUBS, FOLDS)
    + "SELECT p.doc_id, p.doi, p.quality, p.toxic FROM pubs p JOIN splits s ON p.doc_id = s.doc_id "
    + "WHERE s.run = 1 AND s.fold = 2 AND s.split = 'dev'",
)
def _(spark, sf):
    data = pubs(spark, sf).select("doc_id", "doi", "quality", "toxic")
    return folds.fold_select(data, _splits(spark, sf), "doc_id", run=1, fold=2, split="dev")


# --- counts and threshold metrics ------------------------------------------------------------------

COUNTED = """counted AS (
  SELECT fold, label, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
         count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp
  FROM scored GROUP BY fold, label)"""
D = "CAST({} AS DOUBLE)".format
P = "coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0)"
R = "coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0)"
F1 = "coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0)"
F2 = "coalesce(5 * tp / nullif(CAST(5 * tp + 4 * fn + fp AS DOUBLE), 0), 0)"
KAPPA = (
    "coalesce(2.0e0 * (CAST(tp AS DOUBLE) * tn - CAST(fn AS DOUBLE) * fp) / nullif(CAST(tp + fp AS DOUBLE) * (fp + tn)"
    " + CAST(tp + fn AS DOUBLE) * (fn + tn), 0), 0)"
)
MCC = (
    "coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE)) * sqrt(CAST(tp + fn AS DOUBLE))"
    " * sqrt(CAST(tn + fp AS DOUBLE)) * sqrt(CAST(tn + fn AS DOUBLE)), 0), 0)"
)
ACC = "(tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE)"


@query(
    "confusion_binary",
    with_(SCORED, COUNTED)
    + "SELECT label, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, "
    + "CAST(sum(tp) AS BIGINT) AS tp FROM counted WHERE label = 'quality' GROUP BY label",
)
def _(spark, sf):
    return metrics.confusion_counts(scored(spark, sf).where("label = 'quality'"), ["label"])


@query("confusion_per_label", with_(SCORED, COUNTED) + "SELECT fold, label, tn, fp, fn, tp FROM counted")
def _(spark, sf):
    return metrics.confusion_counts(scored(spark, sf), ["fold", "label"])


@query(
    "confusion_argmax",
    with_(SCORED)
    + """, wide AS (
      SELECT doc_id, max(CASE WHEN label = 'quality' THEN y END) AS yq, max(CASE WHEN label = 'toxic' THEN y END) AS yt,
             max(CASE WHEN label = 'quality' THEN pred END) AS pq, max(CASE WHEN label = 'toxic' THEN pred END) AS pt
      FROM scored GROUP BY doc_id),
    picked AS (SELECT CASE WHEN yq >= yt THEN 'quality' ELSE 'toxic' END AS true_label,
                      CASE WHEN pq >= pt THEN 'quality' ELSE 'toxic' END AS guess FROM wide)
    SELECT true_label, count(*) FILTER (WHERE guess = 'quality') AS pred_quality,
           count(*) FILTER (WHERE guess = 'toxic') AS pred_toxic FROM picked GROUP BY true_label""",
)
def _(spark, sf):
    wide = scored(spark, sf).groupBy("doc_id").agg(
        F.array(*[F.max(F.when(F.col("label") == n, F.col("y"))) for n in LABELS]).alias("truth"),
        F.array(*[F.max(F.when(F.col("label") == n, F.col("pred"))) for n in LABELS]).alias("guess"),
    )
    return metrics.confusion_argmax(wide, "doc_id", LABELS)


@query(
    "prf_per_label",
    with_(SCORED, COUNTED)
    + "SELECT fold, label, tp + fn AS support, "
    + ", ".join([r8(P, "precision"), r8(R, "recall"), r8(F1, "f1")])
    + " FROM counted",
)
def _(spark, sf):
    counts = metrics.confusion_counts(scored(spark, sf), ["fold", "label"])
    result = metrics.prf_per_label(counts).select("fold", "label", "support", "precision", "recall", "f1")
    return rounded(result, "precision", "recall", "f1")


def _averages(names):
    each = {"precision": P, "recall": R, "f1": F1, "f2": F2, "kappa": KAPPA}
    parts = []
    for n in names:
        parts.append(r8(f"avg({each[n]})", f"{n}_macro"))
        parts.append(r8(f"sum((tp + fn) * {each[n]}) / nullif(CAST(sum(tp + fn) AS DOUBLE), 0)", f"{n}_weighted"))
    return ", ".join(parts)


SUMMED = """summed AS (
  SELECT fold, CAST(sum(tn) AS DOUBLE) AS tn, CAST(sum(fp) AS DOUBLE) AS fp, CAST(sum(fn) AS DOUBLE) AS fn,
         CAST(sum(tp) AS DOUBLE) AS tp FROM counted GROUP BY fold)"""


@query(
    "prf_averages",
    with_(SCORED, COUNTED, SUMMED)
    + f"""SELECT a.*, m.* EXCLUDE (fold) FROM
      (SELECT fold, {_averages(["precision", "recall", "f1"])} FROM counted GROUP BY fold) a JOIN
      (SELECT fold, {r8(P, "precision_micro")}, {r8(R, "recall_micro")}, {r8(F1, "f1_micro")} FROM summed) m ON a.fold = m.fold""",
)
def _(spark, sf):
    counts = metrics.confusion_counts(scored(spark, sf), ["fold", "label"])
    names = [f"{m}_{a}" for m in ("precision", "recall", "f1") for a in ("macro", "weighted", "micro")]
    return rounded(metrics.prf_averages(counts, ["fold"]).select("fold", *names), *names)


@query("fbeta", with_(SCORED, COUNTED) + f"SELECT fold, {_averages(['f2'])} FROM counted GROUP BY fold")
def _(spark, sf):
    counts = metrics.confusion_counts(scored(spark, sf), ["fold", "label"])
    return rounded(metrics.prf_averages(counts, ["fold"]).select("fold", "f2_macro", "f2_weighted"), "f2_macro", "f2_weighted")


@query("accuracy_binary", with_(SCORED, COUNTED) + f"SELECT fold, label, {r8(ACC, 'accuracy')} FROM counted")
def _(spark, sf):
    counts = metrics.confusion_counts(scored(spark, sf), ["fold", "label"])
    return rounded(counts.select("fold", "label", metrics.accuracy().alias("accuracy")), "accuracy")


@query(
    "subset_accuracy",
    with_(SCORED)
    + f"""SELECT fold, {r8("avg(CASE WHEN ok THEN 1.0e0 ELSE 0.0e0 END)", "subset_accuracy")}
    FROM (SELECT fold, doc_id, bool_and(y = pred) AS ok FROM scored GROUP BY fold, doc_id) GROUP BY fold""",
)
def _(spark, sf):
    return rounded(metrics.subset_accuracy(scored(spark, sf), ["fold"], "doc_id"), "subset_accuracy")


@query(
    "mcc",
    with_(SCORED, COUNTED, SUMMED)
    + f"""SELECT fold, label, {r8(MCC, "mcc")} FROM counted
    UNION ALL SELECT fold, 'all' AS label, {r8(MCC, "mcc")} FROM summed""",
)
def _(spark, sf):
    counts = metrics.confusion_counts(scored(spark, sf), ["fold", "label"])
    flat = metrics.confusion_counts(scored(spark, sf), ["fold"]).withColumn("label", F.lit("all"))
    return rounded(counts.unionByName(flat).select("fold", "label", metrics.mcc().alias("mcc")), "mcc")


@query(
    "kappa",
    with_(SCORED, COUNTED)
    + f"SELECT fold, {r8(f'max(CASE WHEN label = $$quality$$ THEN {KAPPA} END)', 'kappa_quality')}, {_averages(['kappa'])} FROM counted GROUP BY fold",
)
def _(spark, sf):
    counts = metrics.confusion_counts(scored(spark, sf), ["fold", "label"])
    quality = counts.where("label = 'quality'").select("fold", metrics.kappa().alias("kappa_quality"))
    both = metrics.prf_averages(counts, ["fold"]).select("fold", "kappa_macro", "kappa_weighted").join(quality, "fold")
    return rounded(both, "kappa_quality", "kappa_macro", "kappa_weighted")


@query(
    "class_distribution",
    """SELECT label, n_pos, total - n_pos AS n_neg, round(100.0e0 * n_pos / total, 8) AS pct_pos,
       round(100.0e0 * (total - n_pos) / total, 8) AS pct_neg FROM (
      SELECT 'quality' AS label, CAST(sum(quality) AS BIGINT) AS n_pos, count(*) AS total FROM labels
      UNION ALL SELECT 'toxic', CAST(sum(toxic) AS BIGINT), count(*) FROM labels)""",
)
def _(spark, sf):
    result = metrics.class_distribution(table(spark, sf, "labels"), LABELS)
    return rounded(result, "pct_pos", "pct_neg").select("label", "n_pos", "n_neg", "pct_pos", "pct_neg")


POS_WEIGHTS = """weights AS (
  SELECT 'quality' AS label, sum(1 - quality) / CAST(sum(quality) AS DOUBLE) AS pos_weight, CAST(sum(quality) AS BIGINT) AS n_pos,
         CAST(sum(1 - quality) AS BIGINT) AS n_neg FROM {0}
  UNION ALL SELECT 'toxic', sum(1 - toxic) / CAST(sum(toxic) AS DOUBLE), CAST(sum(toxic) AS BIGINT), CAST(sum(1 - toxic) AS BIGINT) FROM {0})"""


@query("pos_weights", with_(POS_WEIGHTS.format("labels")) + "SELECT label, n_pos, n_neg, round(pos_weight, 8) AS pos_weight FROM weights")
def _(spark, sf):
    return rounded(metrics.pos_weights(table(spark, sf, "labels"), LABELS), "pos_weight")


@query("default_pos_weight", with_(PUBS, POS_WEIGHTS.format("pubs")) + "SELECT label, round(pos_weight, 8) AS pos_weight FROM weights")
def _(spark, sf):
    return rounded(metrics.default_pos_weight(pubs(spark, sf), LABELS, None), "pos_weight")


# --- ranking metrics -------------------------------------------------------------------------------


def ranked_sql(source, keys):
    cols = ", ".join(keys)
    on = f"PARTITION BY {cols} " if keys else ""
    group = f"GROUP BY {cols + ', ' if keys else ''}score"
    lead = f"{cols}, " if keys else ""
    return f"""tied AS (SELECT {lead}score, CAST(sum(y) AS BIGINT) AS tp_at, count(*) AS n_at FROM {source} {group}),
ranked AS (SELECT *, CAST(sum(tp_at) OVER ({on}ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(n_at) OVER ({on}ORDER BY score DESC) AS BIGINT) AS n,
       CAST(sum(tp_at) OVER ({on}) AS BIGINT) AS pos, CAST(sum(n_at) OVER ({on}) AS BIGINT) AS total FROM tied)"""


AUC_OR = "coalesce(sum((n_at - tp_at) * (2.0e0 * tp - tp_at)) / nullif(2.0e0 * max(pos) * (max(total) - max(pos)), 0), {})"
AUC = AUC_OR.format("0")
AP = "coalesce(sum(CAST(tp_at AS DOUBLE) * tp / nullif(CAST(pos AS DOUBLE) * n, 0)), 0)"


@query("roc_auc", with_(SCORED, ranked_sql("scored", ["fold", "label"])) + f"SELECT fold, label, {r8(AUC, 'roc_auc')} FROM ranked GROUP BY fold, label")
def _(spark, sf):
    by = ["fold", "label"]
    result = curves.roc_auc(curves.ranked_counts(scored(spark, sf), by), by)
    return rounded(result.select(*by, "roc_auc"), "roc_auc")


@query(
    "roc_auc_averages",
    with_(SCORED, ranked_sql("scored", ["fold", "label"]))
    + f""", each AS (SELECT fold, label, max(pos) AS pos, {AUC} AS auc FROM ranked GROUP BY fold, label),
    m AS (SELECT a.fold, count(*) FILTER (WHERE a.score > b.score) + 0.5e0 * count(*) FILTER (WHERE a.score = b.score) AS wins, count(*) AS pairs
          FROM scored a JOIN scored b ON a.fold = b.fold AND a.y = 1 AND b.y = 0 GROUP BY a.fold)
    SELECT e.fold, {r8("avg(auc)", "roc_auc_macro")}, {r8("sum(pos * auc) / sum(pos)", "roc_auc_weighted")}, {r8("max(wins / pairs)", "roc_auc_micro")}
    FROM each e JOIN m ON e.fold = m.fold GROUP BY e.fold""",
)
def _(spark, sf):
    data = scored(spark, sf)
    per = curves.roc_auc(curves.ranked_counts(data, ["fold", "label"]), ["fold", "label"])
    micro = curves.roc_auc(curves.ranked_counts(data, ["fold"]), ["fold"]).select("fold", F.col("roc_auc").alias("roc_auc_micro"))
    both = curves.rank_averages(per, ["fold"], "roc_auc").join(micro, "fold")
    return rounded(both, "roc_auc_macro", "roc_auc_weighted", "roc_auc_micro")


@query("average_precision", with_(SCORED, ranked_sql("scored", ["fold", "label"])) + f"SELECT fold, label, {r8(AP, 'ap')} FROM ranked GROUP BY fold, label")
def _(spark, sf):
    by = ["fold", "label"]
    return rounded(curves.average_precision(curves.ranked_counts(scored(spark, sf), by), by).select(*by, "ap"), "ap")


@query(
    "average_precision_averages",
    with_(SCORED, ranked_sql("scored", ["fold", "label"]))
    + f""", each AS (SELECT fold, label, max(pos) AS pos, {AP} AS ap FROM ranked GROUP BY fold, label),
    t2 AS (SELECT fold, score, CAST(sum(y) AS DOUBLE) AS g, count(*) AS c FROM scored GROUP BY fold, score),
    r2 AS (SELECT fold, g, sum(g) OVER w AS tp, sum(c) OVER w AS n, sum(g) OVER (PARTITION BY fold) AS pos FROM t2
           WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
    m AS (SELECT fold, sum(g / pos * tp / n) AS ap_micro FROM r2 GROUP BY fold)
    SELECT e.fold, {r8("avg(ap)", "ap_macro")}, {r8("sum(pos * ap) / sum(pos)", "ap_weighted")}, {r8("max(ap_micro)", "ap_micro")}
    FROM each e JOIN m ON e.fold = m.fold GROUP BY e.fold""",
)
def _(spark, sf):
    data = scored(spark, sf)
    per = curves.average_precision(curves.ranked_counts(data, ["fold", "label"]), ["fold", "label"])
    micro = curves.average_precision(curves.ranked_counts(data, ["fold"]), ["fold"]).select("fold", F.col("ap").alias("ap_micro"))
    return rounded(curves.rank_averages(per, ["fold"], "ap").join(micro, "fold"), "ap_macro", "ap_weighted", "ap_micro")


@query(
    "support_weighted_ap",
    with_(SCORED, ranked_sql("scored", ["label"]))
    + f"""SELECT {r8("avg(ap)", "ap_macro")}, {r8("sum(pos * ap) / sum(pos)", "ap_weighted")}, count(*) AS n_labels FROM
    (SELECT label, max(pos) AS pos, {AP} AS ap FROM ranked GROUP BY label)""",
)
def _(spark, sf):
    per = curves.average_precision(curves.ranked_counts(scored(spark, sf), ["label"]), ["label"])
    result = curves.rank_averages(per, [], "ap").withColumn("n_labels", F.lit(len(LABELS)).cast("bigint"))
    return rounded(result, "ap_macro", "ap_weighted")


@query(
    "ndcg",
    with_(SCORED)
    + """, pos AS (SELECT fold, label, y, score, row_number() OVER (PARTITION BY fold, label ORDER BY score DESC, doc_id) AS rk,
                 row_number() OVER (PARTITION BY fold, label ORDER BY y DESC, doc_id) AS best FROM scored),
    tie AS (SELECT fold, label, score, avg(CAST(y AS DOUBLE)) * sum(1.0e0 / log2(rk + 1)) AS d FROM pos GROUP BY 1, 2, 3),
    ideal AS (SELECT fold, label, sum(y / log2(best + 1)) AS i FROM pos GROUP BY 1, 2)
    SELECT i.fold, i.label, round(coalesce(sum(d) / nullif(max(i), 0), 0), 8) AS ndcg
    FROM tie t JOIN ideal i ON t.fold = i.fold AND t.label = i.label GROUP BY i.fold, i.label""",
)
def _(spark, sf):
    by = ["fold", "label"]
    return rounded(curves.ndcg(curves.ranked_counts(scored(spark, sf), by), by).select(*by, "ndcg"), "ndcg")


@query(
    "roc_curve",
    with_(SCORED, ranked_sql("scored", ["label"]))
    + """SELECT label, round(score, 8) AS threshold, round((n - tp) / CAST(total - pos AS DOUBLE), 8) AS fpr, round(tp / CAST(pos AS DOUBLE), 8) AS tpr FROM ranked
    UNION ALL SELECT DISTINCT label, CAST('inf' AS DOUBLE), 0.0e0, 0.0e0 FROM ranked""",
)
def _(spark, sf):
    points = curves.roc_curve(curves.ranked_counts(scored(spark, sf), ["label"]), ["label"])
    finite = F.when(F.col("threshold") == float("inf"), F.col("threshold")).otherwise(F.round("threshold", 8))
    return rounded(points.withColumn("threshold", finite), "fpr", "tpr")


@query(
    "roc_curve_corners",
    with_(SCORED, ranked_sql("scored", ["label"]))
    + """, pts AS (SELECT label, score, tp, n, tp_at, n_at - tp_at AS fp_at, lead(tp_at) OVER w AS tp_out, lead(n_at - tp_at) OVER w AS fp_out, pos, total
               FROM ranked WINDOW w AS (PARTITION BY label ORDER BY score DESC))
    SELECT label, round((n - tp) / CAST(total - pos AS DOUBLE), 8) AS fpr, round(tp / CAST(pos AS DOUBLE), 8) AS tpr FROM pts
    WHERE tp_out IS NULL OR tp_at * fp_out <> tp_out * fp_at
    UNION ALL SELECT DISTINCT label, 0.0e0, 0.0e0 FROM ranked""",
)
def _(spark, sf):
    points = curves.roc_curve(curves.ranked_counts(scored(spark, sf), ["label"]), ["label"], drop_collinear=True)
    return rounded(points.drop("threshold"), "fpr", "tpr")


@query(
    "pr_curve",
    with_(SCORED, ranked_sql("scored", ["label"]))
    + """SELECT label, round(score, 8) AS threshold, round(tp / CAST(n AS DOUBLE), 8) AS precision, round(tp / CAST(pos AS DOUBLE), 8) AS recall FROM ranked
    UNION ALL SELECT DISTINCT label, CAST(NULL AS DOUBLE), 1.0e0, 0.0e0 FROM ranked""",
)
def _(spark, sf):
    return rounded(curves.pr_curve(curves.ranked_counts(scored(spark, sf), ["label"]), ["label"]), "threshold", "precision", "recall")


@query(
    "cumulative_counts",
    with_(SCORED, ranked_sql("scored", ["label"])) + "SELECT label, round(score, 8) AS score, tp, n - tp AS fp, n FROM ranked",
)
def _(spark, sf):
    ranked = curves.ranked_counts(scored(spark, sf), ["label"])
    return rounded(ranked.select("label", "score", "tp", (F.col("n") - F.col("tp")).alias("fp"), "n"), "score")


THRESHOLD_SQL = {
    "f1": "2.0e0 * tp / nullif(2.0e0 * tp + (n - tp) + (pos - tp), 0)",
    "accuracy": "(tp + (total - n - (pos - tp))) / CAST(total AS DOUBLE)",
    "precision": "tp / nullif(CAST(n AS DOUBLE), 0)",
    "recall": "tp / nullif(CAST(pos AS DOUBLE), 0)",
    "kappa": "2.0e0 * (CAST(tp AS DOUBLE) * (total - n - (pos - tp)) - CAST(pos - tp AS DOUBLE) * (n - tp)) / "
    "nullif(CAST(n AS DOUBLE) * (total - pos) + CAST(pos AS DOUBLE) * (total - n), 0)",
}


def best_sql(keys, metric):
    """Best threshold per group, an infinite one included, from `ranked`."""
    cols = ", ".join(keys)
    return f"""cand AS (SELECT {cols}, score, tp, n, pos, total FROM ranked
      UNION ALL SELECT DISTINCT {cols}, CAST('inf' AS DOUBLE), 0, 0, pos, total FROM ranked),
    best AS (SELECT {cols}, score AS threshold, v FROM (
      SELECT {cols}, score, coalesce({THRESHOLD_SQL[metric]}, 0) AS v FROM cand)
      QUALIFY row_number() OVER (PARTITION BY {cols} ORDER BY v DESC, score DESC) = 1)"""


def _all_thresholds():
    parts = []
    for i, m in enumerate(THRESHOLD_SQL):
        views = best_sql(["fold", "label"], m).replace("cand", f"cand{i}").replace("best AS", f"best{i} AS")
        parts.append(views)
    selects = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, fold, label, CASE WHEN isinf(threshold) THEN threshold ELSE round(threshold, 8) END AS threshold, round(v, 8) AS value FROM best{i}"
        for i, m in enumerate(THRESHOLD_SQL)
    )
    return with_(SCORED, ranked_sql("scored", ["fold", "label"]), *parts) + selects


@query("optimal_threshold", _all_thresholds())
def _(spark, sf):
    by = ["fold", "label"]
    result = curves.optimal_thresholds(curves.ranked_counts(scored(spark, sf), by), by, curves.THRESHOLD_METRICS)
    finite = F.when(F.col("threshold") == float("inf"), F.col("threshold")).otherwise(F.round("threshold", 8))
    return rounded(result.withColumn("threshold", finite), "value")


TRANSFER = (
    with_(PUBS, FOLDS, SCORED)
    + """, parts AS (SELECT s.doc_id, s.label, s.y, s.score, p.split FROM scored s JOIN splits p ON s.doc_id = p.doc_id
                 WHERE p.run = 0 AND p.fold = 0 AND p.split <> 'train'),
    dev AS (SELECT label, y, score FROM parts WHERE split = 'dev'),
    """
    + ranked_sql("dev", ["label"])
    + ", "
    + best_sql(["label"], "f1")
    + """, counted AS (SELECT t.label, max(threshold) AS threshold, count(*) FILTER (WHERE y = 0 AND score < threshold) AS tn,
        count(*) FILTER (WHERE y = 0 AND score >= threshold) AS fp, count(*) FILTER (WHERE y = 1 AND score < threshold) AS fn,
        count(*) FILTER (WHERE y = 1 AND score >= threshold) AS tp
      FROM parts t JOIN best b ON t.label = b.label WHERE t.split = 'test' GROUP BY t.label)
    SELECT label, round(threshold, 8) AS threshold, tn, fp, fn, tp, """
    + ", ".join([r8(P, "precision"), r8(R, "recall"), r8(F1, "f1")])
    + " FROM counted"
)


@query("threshold_transfer", TRANSFER)
def threshold_transfer(spark, sf):
    """Thresholds tuned on the dev split of fold 0 and judged on its test split."""
    splits = _splits(spark, sf).where("run = 0 and fold = 0 and split <> 'train'").select("doc_id", "split")
    # Both the tuning and the judging read these narrow rows.
    data = cut_lineage(scored(spark, sf).drop("pred", "fold").join(splits, "doc_id"))
    predicted = metrics.tuned_predictions(data, ["label"], F.col("split") == "dev")
    counts = metrics.confusion_counts(predicted, ["label", "threshold"])
    result = metrics.prf_per_label(counts).select("label", "threshold", "tn", "fp", "fn", "tp", "precision", "recall", "f1")
    return rounded(result, "threshold", "precision", "recall", "f1")


@query(
    "apply_threshold",
    with_(SCORED)
    + """SELECT doc_id, label, CASE WHEN score > 0.5e0 THEN 1 ELSE 0 END AS fixed_pred,
       CASE WHEN score >= CASE WHEN label = 'quality' THEN 40 / 123.0e0 ELSE 60 / 123.0e0 END THEN 1 ELSE 0 END AS label_pred FROM scored""",
)
def _(spark, sf):
    cut = F.when(F.col("label") == "quality", F.lit(40) / F.lit(123.0)).otherwise(F.lit(60) / F.lit(123.0))
    return scored(spark, sf).select(
        "doc_id",
        "label",
        metrics.apply_threshold("score", 0.5).alias("fixed_pred"),
        metrics.apply_threshold("score", cut).alias("label_pred"),
    )


def _detail_sql():
    per = {"precision": P, "recall": R, "f1": F1, "kappa": KAPPA, "accuracy": ACC, "mcc": MCC}
    rows = [f"SELECT fold, label, '{m}' AS metric, {e} AS value FROM counted" for m, e in per.items()]
    rows += [f"SELECT fold, label, '{c}', CAST({c} AS DOUBLE) FROM counted" for c in ("tn", "fp", "fn", "tp")]
    rows.append(f"SELECT fold, label, 'roc_auc', {AUC} FROM ranked GROUP BY fold, label")
    rows.append(f"SELECT fold, label, 'ap', {AP} FROM ranked GROUP BY fold, label")
    rows.append("SELECT i.fold, i.label, 'ndcg', coalesce(sum(d) / nullif(max(i), 0), 0) FROM tie t JOIN ideal i ON t.fold = i.fold AND t.label = i.label GROUP BY i.fold, i.label")
    return " UNION ALL ".join(rows)


PLACES = """pos AS (SELECT fold, label, y, score, row_number() OVER (PARTITION BY fold, label ORDER BY score DESC, doc_id) AS rk,
    row_number() OVER (PARTITION BY fold, label ORDER BY y DESC, doc_id) AS best FROM scored),
tie AS (SELECT fold, label, score, avg(CAST(y AS DOUBLE)) * sum(1.0e0 / log2(rk + 1)) AS d FROM pos GROUP BY 1, 2, 3),
ideal AS (SELECT fold, label, sum(y / log2(best + 1)) AS i FROM pos GROUP BY 1, 2)"""


@query(
    "metrics_dispatch",
    with_(SCORED, COUNTED, ranked_sql("scored", ["fold", "label"]), PLACES)
    + f"SELECT fold, label, metric, round(value, 8) AS value FROM ({_detail_sql()})",
)
def _(spark, sf):
    """The rows per label; `metrics_row` checks the averaged ones."""
    result = metrics.detailed_metrics(scored(spark, sf), ["fold"], "doc_id")
    return rounded(result.where("label is not null").select("fold", "label", "metric", "value"), "value")


def _metrics_row_sql():
    """Counts per label and all averaged values of every model and fold, one wide row each."""
    by, per = "model, fold", "model, fold, label"
    counted = COUNTED.replace("fold, label", per).replace("FROM scored ", "FROM scored_models ")
    summed = SUMMED.replace("SELECT fold,", f"SELECT {by},").replace("GROUP BY fold", f"GROUP BY {by}")
    micro = ranked_sql("scored_models", ["model", "fold"]).replace("tied", "tied_all").replace("ranked AS", "ranked_all AS")
    averaged = _averages(["precision", "recall", "f1", "f2", "kappa"])
    label_columns = [
        f"CAST(max(CASE WHEN label = '{n}' THEN {c} END) AS BIGINT) AS {c}_{n}" for n in LABELS for c in ("tn", "fp", "fn", "tp")
    ] + [r8(f"max(CASE WHEN label = '{n}' THEN {e} END)", f"{m}_{n}") for n in LABELS for m, e in (("f1", F1), ("recall", R), ("precision", P))]
    return with_(SCORED_MODELS, counted, summed, ranked_sql("scored_models", ["model", "fold", "label"]), micro) + f""",
    areas AS (SELECT {per}, max(pos) AS pos, {AUC} AS auc, {AP} AS ap FROM ranked GROUP BY {per}),
    area_means AS (SELECT {by}, {r8("avg(auc)", "roc_auc_macro")}, {r8("sum(pos * auc) / sum(pos)", "roc_auc_weighted")},
        {r8("avg(ap)", "ap_macro")}, {r8("sum(pos * ap) / sum(pos)", "ap_weighted")} FROM areas GROUP BY {by}),
    micro AS (SELECT {by}, {r8(AUC, "roc_auc_micro")}, {r8(AP, "ap_micro")} FROM ranked_all GROUP BY {by}),
    places AS (SELECT {per}, y, score, row_number() OVER (PARTITION BY {per} ORDER BY score DESC, doc_id) AS rk,
        row_number() OVER (PARTITION BY {per} ORDER BY y DESC, doc_id) AS best FROM scored_models),
    dcg AS (SELECT {per}, sum(d) AS d FROM (SELECT {per}, score, avg(CAST(y AS DOUBLE)) * sum(1.0e0 / log2(rk + 1)) AS d FROM places GROUP BY {per}, score) GROUP BY {per}),
    ideal AS (SELECT {per}, sum(y / log2(best + 1)) AS i FROM places GROUP BY {per}),
    gains AS (SELECT {by}, {r8("avg(coalesce(d / nullif(i, 0), 0))", "ndcg_macro")} FROM dcg JOIN ideal USING ({per}) GROUP BY {by}),
    whole AS (SELECT {by}, {r8("avg(CASE WHEN ok THEN 1.0e0 ELSE 0.0e0 END)", "subset_accuracy")}
        FROM (SELECT {by}, doc_id, bool_and(y = pred) AS ok FROM scored_models GROUP BY {by}, doc_id) GROUP BY {by}),
    labels_wide AS (SELECT {by}, {", ".join(label_columns)}, {averaged} FROM counted GROUP BY {by}),
    pooled AS (SELECT {by}, {r8(P, "precision_micro")}, {r8(R, "recall_micro")}, {r8(F1, "f1_micro")}, {r8(MCC, "mcc")} FROM summed)
    SELECT * FROM labels_wide JOIN pooled USING ({by}) JOIN area_means USING ({by}) JOIN micro USING ({by}) JOIN gains USING ({by}) JOIN whole USING ({by})"""


@query("metrics_row", _metrics_row_sql())
def _(spark, sf):
    """The published row: counts and scores per label and the averaged metric set of every model and fold."""
    return metrics.metrics_row(metrics.detailed_metrics(scored_models(spark, sf), ["model", "fold"], "doc_id"), ["model", "fold"], LABELS, digits=8)


# --- losses ----------------------------------------------------------------------------------------

CLIPPED = """clipped AS (SELECT label, y, 0.005e0 + 0.99e0 * score AS p FROM scored)"""


def _clipped(spark, sf):
    return scored(spark, sf).withColumn("p", F.lit(0.005) + F.lit(0.99) * F.col("score"))


@query(
    "sigmoid_scores",
    with_(SCORED) + "SELECT doc_id, label, round(1.0e0 / (1.0e0 + exp(-(8.0e0 * score - 4.0e0))), 8) AS prob FROM scored",
)
def _(spark, sf):
    data = scored(spark, sf).withColumn("logit", 8.0 * F.col("score") - 4.0)
    return rounded(data.select("doc_id", "label", losses.sigmoid("logit").alias("prob")), "prob")


@query(
    "bce_loss",
    with_(SCORED, CLIPPED, PUBS, POS_WEIGHTS.format("pubs"))
    + f"SELECT c.label, {r8('avg(-(pos_weight * y * ln(p) + (1 - y) * ln(1 - p)))', 'bce')} FROM clipped c JOIN weights w ON c.label = w.label GROUP BY c.label",
)
def _(spark, sf):
    weights = metrics.default_pos_weight(pubs(spark, sf), LABELS)
    data = _clipped(spark, sf).withColumn("logit", losses.logit("p")).join(F.broadcast(weights), "label")  # one row per label
    loss = losses.bce(F.col("logit"), F.col("y"), F.col("pos_weight"))
    return rounded(data.groupBy("label").agg(F.avg(loss).alias("bce")), "bce")


@query(
    "focal_loss",
    with_(SCORED, CLIPPED)
    + f"SELECT label, {r8('avg(CASE WHEN y = 1 THEN -0.25e0 * pow(1 - p, 2) * ln(p) ELSE -0.75e0 * pow(p, 2) * ln(1 - p) END)', 'focal')} FROM clipped GROUP BY label",
)
def _(spark, sf):
    data = _clipped(spark, sf).withColumn("logit", losses.logit("p"))
    return rounded(data.groupBy("label").agg(F.avg(losses.focal(F.col("logit"), F.col("y"))).alias("focal")), "focal")
