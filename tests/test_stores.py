"""Partition commits, the key index, observed counts, label quotas and critical groups."""

import random

import pytest
from pyspark.sql import functions as F

from labelloom.operators import corpus, folds, stats
from labelloom.sources import key_index, writers

BY = ["run", "fold"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("id", *BY).collect())


def test_rerun_replaces_just_its_partitions(spark, tmp_path):
    path = f"{tmp_path}/predictions"
    data = spark.range(60).select("id", (F.col("id") % 2).cast("int").alias("run"), (F.col("id") % 3).cast("int").alias("fold"))
    writers.commit_partitions(data, path, BY)
    writers.commit_partitions(data.where("fold = 1"), path, BY)
    assert rows_of(writers.committed(spark, path, BY)) == rows_of(data)
    fewer = data.where("fold = 1 and run = 0 and id < 20")
    writers.commit_partitions(fewer, path, BY)
    assert rows_of(writers.committed(spark, path, BY)) == rows_of(data.where("not (fold = 1 and run = 0)").union(fewer))
    sizes = spark.read.parquet(f"{path}.commits").orderBy(*BY).collect()
    assert sum(r.n_rows for r in sizes) == 60 - 10 + fewer.count()


def test_partitions_without_a_commit_are_not_read(spark, tmp_path):
    path = f"{tmp_path}/metrics"
    data = spark.range(12).select("id", F.lit(0).alias("run"), (F.col("id") % 3).cast("int").alias("fold"))
    writers.commit_partitions(data, path, BY)
    # a writer that stopped between its data and its commit rows
    late = data.where("fold = 2").withColumn("n_rows", F.lit(-1).cast("bigint")).select(*BY, "n_rows").distinct()
    late.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BY).parquet(f"{path}.commits")
    assert rows_of(writers.committed(spark, path, BY)) == rows_of(data.where("fold <> 2"))
    writers.commit_partitions(data.where("fold = 2"), path, BY)
    assert rows_of(writers.committed(spark, path, BY)) == rows_of(data)


def test_new_columns_of_a_later_run(spark, tmp_path):
    path = f"{tmp_path}/metrics"
    writers.append_metrics(spark.createDataFrame([(0, 0.5)], "fold int, f1 double"), path, ["fold"])
    writers.append_metrics(spark.createDataFrame([(1, 0.6, 0.7)], "fold int, f1 double, auc double"), path, ["fold"])
    assert sorted((r.fold, r.f1, r.auc) for r in writers.committed(spark, path, ["fold"]).collect()) == [(0, 0.5, None), (1, 0.6, 0.7)]


# --- key index -------------------------------------------------------------------------------------


@pytest.fixture
def store(spark, tmp_path):
    path = f"{tmp_path}/store"
    spark.range(0, 40_000, 2).repartitionByRange(200, "id").write.parquet(path)
    return path


def test_few_files_are_opened(spark, store):
    index = key_index.refresh(spark, store, "id")
    assert index.count() == 200
    files = key_index.candidate_files(index, spark.createDataFrame([(10,), (12,), (30_000,), (30_001,), (99_999,)], "id bigint"), "id")
    assert 1 <= len(files) <= 4
    # keys of every range that are not stored: ranges cannot tell, the filters can
    absent = spark.range(1, 40_000, 400).select(F.col("id"))
    assert len(key_index.candidate_files(index, absent, "id")) <= 40


def test_lookup_equals_anti_join(spark, store):
    incoming = spark.range(0, 500).union(spark.range(39_990, 40_020))
    got = key_index.not_stored(incoming, store, "id")
    want = incoming.join(spark.read.parquet(store), "id", "left_anti")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_large_lookups_read_the_store(spark, store, monkeypatch):
    monkeypatch.setattr(key_index, "LOOKUP_KEYS", 10)
    assert key_index.candidate_files(key_index.refresh(spark, store, "id"), spark.range(100), "id") is None
    assert sorted(r.id for r in key_index.not_stored(spark.range(21), store, "id").collect()) == list(range(1, 21, 2))


def test_replays_add_nothing(spark, tmp_path):
    path = f"{tmp_path}/store"
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "pmid string, v int")
    key_index.append_new(batch, path, "pmid")
    key_index.append_new(batch.where("pmid is not null"), path, "pmid")
    key_index.append_new(spark.createDataFrame([("b", 9), ("c", 5)], "pmid string, v int"), path, "pmid")
    stored = spark.read.parquet(path).where("pmid is not null")
    assert sorted(r.pmid for r in stored.collect()) == ["a", "b", "c"]


def test_files_without_index_rows_are_found(spark, store):
    key_index.refresh(spark, store, "id")
    spark.range(50_000, 50_010).write.mode("append").parquet(store)  # a writer that was cut short before its index rows
    assert key_index.not_stored(spark.range(50_005, 50_012), store, "id").count() == 2
    assert key_index.not_stored(spark.range(3), f"{store}-none", "id").count() == 3


# --- counts, quotas, groups ------------------------------------------------------------------------


def test_counts_come_from_the_build_job(spark, tmp_path):
    seen = corpus.StageCounts()
    rows = seen.mark("all", spark.range(1_000))
    rows = seen.mark("even", rows.where("id % 2 = 0"))
    rows = seen.mark("small", rows.where("id < 100"))
    spark.sparkContext.setJobGroup("build", "build")
    rows.write.parquet(f"{tmp_path}/built")
    counted = {r.stage: r.n_rows for r in seen.counts(spark).collect()}
    spark.sparkContext.setJobGroup("tests", "tests")
    assert counted == {"all": 1_000, "even": 500, "small": 50}
    with pytest.raises(ValueError, match="twice"):
        seen.mark("all", rows)


@pytest.mark.parametrize("n_labels", [3, 20])
def test_every_label_is_even_over_folds(spark, n_labels):
    rng = random.Random(n_labels)
    shares = [rng.uniform(0.02, 0.4) for _ in range(n_labels)]
    names = [f"l{k}" for k in range(n_labels)]
    rows = [(k, *(int(rng.random() < s) for s in shares)) for k in range(600)]
    data = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{n} int" for n in names))
    assigned = folds.quota_kfold(data, "id", names, 5, 2)
    balance = folds.label_balance(assigned, names, 5).collect()
    assert len(balance) == 2 * n_labels
    assert max(r.most - r.least for r in balance) <= (1 if n_labels == 3 else 3)
    sizes = assigned.groupBy("run", "fold").count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 3
    assert assigned.groupBy("run", "id").count().where("count <> 1").count() == 0


def test_quotas_add_up():
    sets = [((1, 0), 7), ((0, 1), 3), ((1, 1), 1), ((0, 0), 22)]
    quotas = folds.set_quotas(sets, 5)
    assert [sum(q) for q in quotas] == [7, 3, 1, 22]
    assert folds.set_quotas([], 3) == []
    for label in (0, 1):
        per_fold = [sum(q[f] for (bits, _), q in zip(sets, quotas, strict=True) if bits[label]) for f in range(5)]
        assert max(per_fold) - min(per_fold) <= 1


def test_groups_of_models(spark):
    # ranks 1, 2, 3, 4, 5 in each of 20 folds: the critical difference is 2.728 * sqrt(30 / 120) = 1.364
    rows = [(m, f, float(-k)) for k, m in enumerate("abcde") for f in range(20)]
    found = stats.critical_groups(spark.createDataFrame(rows, "model string, fold int, value double")).collect()
    groups: dict = {}
    for r in found:
        groups.setdefault(r["group"], []).append(r.model)
    assert sorted(map(sorted, groups.values())) == [["a", "b"], ["b", "c"], ["c", "d"], ["d", "e"]]
    # in few folds everything is within reach: one bar, its parts are not reported
    few = stats.critical_groups(spark.createDataFrame([r for r in rows if r[1] < 2], "model string, fold int, value double")).collect()
    assert {r["group"] for r in few} == {1} and len(few) == 5 and few[0].n_models == 5
