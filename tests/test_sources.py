import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelloom.plans import dataset, learning
from labelloom.session import cut_lineage, shared_dir, staging_path
from labelloom.operators import folds
from labelloom.sources import readers, records, writers

SF = "/root/testdata/sf0.001"


def test_shared_dir_follows_the_session(spark):
    assert spark.sparkContext.getCheckpointDir() is None or shared_dir(spark)
    assert shared_dir(spark) == shared_dir(spark)
    assert "checkpoint" not in cut_lineage(spark.range(3)).columns


def test_fold_reads_prune_partitions(spark):
    path = staging_path(spark, "folds")
    df = spark.range(100).withColumn("a", (F.col("id") % 3 == 0).cast("int"))
    writers.write_folds(folds.train_dev_test(df, "id", ["a"], 5, 2), path)
    one = readers.read_folds(spark, path, run=1, fold=4)
    assert one.count() == 100
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan


def test_filters_and_columns_reach_the_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = docs.where("lang = 'en'").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "text" not in plan.split("ReadSchema")[1]


def test_positive_lists(spark, tmp_path):
    for name, rows in {"SET A": [("d1", "2020")], "SET B": [("d2", "x"), ("d3", None)], "other": [("d4", "1")]}.items():
        folder = tmp_path / name
        folder.mkdir()
        frame = pd.DataFrame([{c: None for c in readers.POSITIVE_COLUMNS} | {"DOI": d, "Publication Year": y, "Title": 'a "q",\nb'} for d, y in rows])
        frame.to_csv(folder / "list.csv", index=False)
    (tmp_path / "SET C").mkdir()
    lists = readers.scan_positive_csv(spark, str(tmp_path), "SET")
    assert {(r.label, r.DOI) for r in lists.collect()} == {("A", "d1"), ("B", "d2"), ("B", "d3")}
    assert {r.Title for r in lists.collect()} == {'a "q",\nb'}
    good, bad = readers.cast_year(lists)
    assert {(r.DOI, r["Publication Year"]) for r in good.collect()} == {("d1", 2020), ("d3", None)}
    assert [r.DOI for r in bad.collect()] == ["d2"]


def test_records_with_gaps(spark):
    rows = ['{"message": {}}', "{}", "broken", '{"message": {"title": [], "abstract": "", "language": ""}}', '{"message": {"title": ["T", "U"], "abstract": "<jats:p>x</jats:p>"}}']
    df = spark.createDataFrame([(r,) for r in rows], "payload string")
    got = [tuple(r) for r in records.parse_api_record(df, "payload").collect()]
    assert got == [(None,) * 4] * 4 + [("x", None, None, "T")]


def test_request_batches_cover_every_id_once(spark):
    ids = spark.createDataFrame([(f"https://openalex.org/W{i}",) for i in range(123)] + [("",), (None,)], "id string")
    batches = records.request_batches(ids, "id", 50).collect()
    assert sorted(b.n_ids for b in batches) == [23, 50, 50]
    assert {w for b in batches for w in b.ids.split("|")} == {f"W{i}" for i in range(123)}


def test_skip_and_overwrite(spark):
    store = spark.createDataFrame([(1, "old")], "k long, v string")
    new = spark.createDataFrame([(1, "new"), (2, "new")], "k long, v string")
    assert [r.k for r in records.skip_existing(new, store, "k").collect()] == [2]
    assert {tuple(r) for r in records.latest_wins(store, new, "k").collect()} == {(1, "new"), (2, "new")}


def test_dataset_build(spark):
    from suite.adapters import LABELS, corpus
    from suite.landing import _positive_dirs

    lists = readers.scan_positive_csv(spark, _positive_dirs(spark, SF), "LIST")
    settings = dataset.BuildSettings(labels=LABELS, n_folds=3, n_runs=1)
    clean, splits = dataset.build_dataset(lists, corpus(spark, SF), settings)
    rows = clean.collect()
    assert len({r.abstract for r in rows}) == len({r.doi for r in rows}) == len({r.row_key for r in rows}) == len(rows) > 0
    # Negatives survive the build, and every row is in one split of each fold.
    assert any(r.quality == 0 and r.toxic == 0 for r in rows) and any(r.quality == 1 for r in rows)
    assert all(r.repeated == 0 and r.n_keys == len(rows) for r in folds.overlap_report(splits, "row_key").collect())


def test_dataset_build_cleans_texts_once(spark, monkeypatch):
    """The lists' files and the joins of texts are behind the conflicts and the cleaning, not in each of their passes."""
    from suite.adapters import LABELS, corpus
    from suite.landing import _positive_dirs

    plans, conflicts, clean_corpus = {}, dataset.corpus.delete_conflicts, dataset.corpus.clean_corpus
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(dataset.corpus, "delete_conflicts", lambda raw, lists, **k: plans.setdefault("lists", plan(lists)) and conflicts(raw, lists, **k))
    monkeypatch.setattr(dataset.corpus, "clean_corpus", lambda df, *a: plans.setdefault("unified", plan(df)) and clean_corpus(df, *a))
    lists = readers.scan_positive_csv(spark, _positive_dirs(spark, SF), "LIST")
    dataset.build_dataset(lists, corpus(spark, SF), dataset.BuildSettings(labels=LABELS, n_folds=3, n_runs=1))
    assert all(" csv" not in p and "Join" not in p and "regexp" not in p.lower() for p in plans.values()) and len(plans) == 2


def test_learners_beat_chance(spark):
    rows = [(i, [float(i % 2), float((i * 7) % 5)], i % 2) for i in range(200)]
    df = learning.embedding_features(spark.createDataFrame(rows, "k long, v array<double>, a int"), "v")
    for learner in (learning.linear_svm(), learning.random_forest(5, "log_loss", 4), learning.weighted_logistic(None)):
        scored = learning.score_per_label(df, learning.fit_per_label(df, ["a"], learner), "k")
        assert scored.where("y = pred").count() == 200


def test_config_samples():
    space = {"a": ("uniform", 0.5, 2.0), "b": ("loguniform", 1e-6, 1e-1)}
    configs = learning.sample_configs(space, 20, 1)
    assert configs == learning.sample_configs(space, 20, 1)
    assert all(0.5 <= c["a"] <= 2 and 1e-6 <= c["b"] <= 1e-1 for c in configs)
    with pytest.raises(ValueError):
        learning.sample_configs({"a": ("normal", 0, 1)}, 1)


def test_prediction_files_and_directories(spark, tmp_path):
    frame = pd.DataFrame({"k": [1, 2], "score": [0.5, 0.25]})
    frame.to_csv(tmp_path / "fold_0_net-v1.1_BCE_with_title_run-3_opt_neg-500.csv", index=False)
    frame.to_csv(tmp_path / "fold_4_net_focal.csv", index=False)
    folder = tmp_path / "fold_2_a+b_BCE_run-1.csv"
    spark.createDataFrame(frame).write.option("header", "true").csv(str(folder))
    schema = spark.createDataFrame(frame).schema
    got = readers.scan_predictions(spark, f"{tmp_path}/*", schema)
    names = {(r.model, r.loss_type, r.with_title, r.fold, r.run) for r in got.collect()}
    assert names == {("net-v1.1", "BCE", True, 0, 3), ("net", "focal", False, 4, None), ("a+b", "BCE", False, 2, 1)}
    assert got.count() == 6


def test_metrics_table_grows(spark):
    path = staging_path(spark, "metrics")
    writers.append_metrics(spark.createDataFrame([("m", 0.5)], "model string, f1 double"), path)
    writers.append_metrics(spark.createDataFrame([("n", 0.6, 0.7)], "model string, f1 double, ap double"), path)
    assert {tuple(r) for r in readers.read_metrics(spark, path).select("model", "f1", "ap").collect()} == {("m", 0.5, None), ("n", 0.6, 0.7)}


def test_ensemble_of_cross_validation(spark):
    rows = [(k, lab, split, 0, f, m, int((k + i) % 3 == 0), ((k + i) % 3 == 0) * 0.5 + ((k * 7 + j) % 10) / 20)
            for k in range(60) for i, lab in enumerate("ab") for f in range(2) for j, m in enumerate(("u", "v"))
            for split in [("dev" if k % 2 else "test")]]
    df = spark.createDataFrame(rows, "k long, label string, split string, run int, fold int, model string, y int, score double")
    result = learning.evaluate_with_ensemble(df.withColumn("pred", F.lit(0)), "k").collect()
    assert {(r.model, r.fold) for r in result} == {(m, f) for m in ("u", "v", "Ensemble") for f in range(2)}
    assert all(0.8 < r.f1_macro <= 1.0 for r in result)
