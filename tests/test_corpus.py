import random

import pytest
from pyspark.sql import functions as F

from labelloom.operators import corpus, folds


def sequential(rows):
    texts, dois, kept = set(), set(), []
    for key, text, doi in sorted(rows):
        if text in texts or doi in dois:
            continue
        texts.add(text)
        dois.add(doi)
        kept.append(key)
    return kept


@pytest.mark.parametrize("n,texts,dois", [(400, 90, 90), (400, 30, 300), (120, 119, 119), (300, 1, 50)])
def test_dedup_is_the_sequential_scan(spark, n, texts, dois):
    rng = random.Random(n + texts)
    # One text holds a third of the rows.
    rows = [(i, "hot" if rng.random() < 0.33 else f"t{rng.randrange(texts)}", f"d{rng.randrange(dois)}") for i in range(n)]
    df = spark.createDataFrame(rows, "k long, abstract string, doi string").repartition(5)
    assert sorted(r.k for r in corpus.dedup_text_doi(df, "k").collect()) == sequential(rows)


def test_dedup_chain(spark):
    # Each row shares its DOI with the one before and its text with the one after.
    rows = [(i, f"t{(i + 1) // 2}", f"d{i // 2}") for i in range(24)]
    df = spark.createDataFrame(rows, "k long, abstract string, doi string")
    assert sorted(r.k for r in corpus.dedup_text_doi(df, "k").collect()) == sequential(rows)


def test_dedup_of_nothing(spark):
    df = spark.createDataFrame([], "k long, abstract string, doi string")
    assert corpus.dedup_text_doi(df, "k").count() == 0


def test_suffix_join_equals_endswith(spark):
    listed = ["10.1/ab", "b", None, " 10.2/x ", ""]
    dois = ["https://doi.org/10.1/ab", "10.1/abc", "xb", "10.2/x", None, "", "ab", " zb "]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(dois)], "id long, doi string")
    pos = spark.createDataFrame([(d,) for d in listed], "doi string")
    clean = [p.strip() for p in listed if p and p.strip()]
    hit = {i for i, d in enumerate(dois) if d and any(d.strip().endswith(p) for p in clean)}
    assert {r.id for r in corpus.doi_suffix_semi_join(rows, pos, "id").collect()} == hit
    rest = {i for i, d in enumerate(dois) if d is not None and i not in hit}
    assert {r.id for r in corpus.doi_suffix_anti_join(rows, pos, "id").collect()} == rest


def test_null_doi_belongs_to_no_list(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, doi string")
    lists = spark.createDataFrame([("a", "x"), (None, "y"), ("a", "x")], "doi string, label string")
    got = {r.k: (r.x, r.y) for r in corpus.label_membership(rows, lists, ["x", "y"]).collect()}
    assert got == {1: (1, 0), 2: (0, 0)}


def test_enrichment_never_overwrites(spark):
    rows = spark.createDataFrame(
        [(1, " d1 ", "own", None), (2, "d1", "", ""), (3, None, None, "x"), (4, "d9", None, None), (5, "d1", "t", "a")],
        "k long, doi string, title string, abstract string",
    )
    found = spark.createDataFrame([("d1", "T", "A"), ("d1", None, "Z"), (None, "N", "N")], "doi string, title string, abstract string")
    got = {r.k: (r.title, r.abstract, sorted(r.updated_fields)) for r in corpus.enrich_metadata(rows, found).collect()}
    assert got == {
        1: ("own", "A", ["abstract"]),
        2: ("T", "A", ["abstract", "title"]),
        3: (None, "x", []),
        4: (None, None, []),
        5: ("t", "a", []),
    }


def test_undersample(spark):
    rows = [(i, int(i < 20), 0) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, a int, b int")
    one = sorted(r.k for r in corpus.undersample_negatives(df.repartition(3), "k", ["a", "b"], 5).collect())
    two = sorted(r.k for r in corpus.undersample_negatives(df.repartition(11), "k", ["a", "b"], 5).collect())
    assert one == two and len(one) == 120 and set(range(20)) <= set(one)
    every = corpus.undersample_negatives(df, "k", ["a", "b"], 50)
    assert every.count() == 500
    assert corpus.undersample_negatives(df.where("a = 0"), "k", ["a", "b"], 5).count() == 0


@pytest.mark.parametrize("n_folds,dev", [(5, 30), (3, 50), (2, 10)])
def test_folds_are_disjoint_complete_and_balanced(spark, n_folds, dev):
    rng = random.Random(3)
    rows = [(i, int(rng.random() < 0.05), int(rng.random() < 0.3)) for i in range(1003)]
    df = spark.createDataFrame(rows, "k long, a int, b int")
    splits = folds.train_dev_test(df, "k", ["a", "b"], n_folds, 2, 7, dev).cache()
    report = folds.overlap_report(splits, "k").collect()
    assert len(report) == 2 * n_folds
    assert all(r.repeated == 0 and r.n_keys == 1003 for r in report)
    assert splits.where("split = 'test'").select("run", "k").distinct().count() == 2006
    sizes = [r.n_test for r in report]
    assert max(sizes) - min(sizes) <= 1
    per_set = splits.groupBy("run", "fold", "labelset").pivot("split", ["train", "dev", "test"]).count().na.fill(0).collect()
    for r in per_set:
        outside = r.train + r.dev
        assert abs(r.dev - outside * dev / 100) <= 1
    tests = splits.where("split = 'test'").groupBy("run", "labelset", "fold").count()
    spread = tests.groupBy("run", "labelset").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 1 for r in spread)
    runs = splits.where("split = 'test' and fold = 0").groupBy("run").agg(F.sum("k").alias("s")).collect()
    assert runs[0].s != runs[1].s


def test_cycle_sample(spark):
    got = corpus.cycle_sample(spark.range(7).withColumnRenamed("id", "k"), "k", 3).collect()
    assert sorted(r.sample_id for r in got) == list(range(21))
    assert all(len({r.k for r in got if r.sample_id % 7 == p}) == 1 for p in range(7))


def test_clean_corpus_equals_the_scan(spark):
    rng = random.Random(11)
    rows = []
    for i in range(500):
        text = None if rng.random() < 0.05 else f"t{rng.randrange(150)}"
        doi = None if rng.random() < 0.05 else f"d{rng.randrange(200)}"
        title = None if rng.random() < 0.05 else "x"
        rows.append((i, title, text, doi, int(rng.random() < 0.15), int(rng.random() < 0.1)))
    df = spark.createDataFrame(rows, "k long, title string, abstract string, doi string, a int, b int")
    positive = {r[2] for r in rows if r[4] or r[5]}
    negative = {r[2] for r in rows if not (r[4] or r[5])}
    left = [(r[0], r[2], r[3]) for r in rows if None not in r[1:4] and not (r[2] in positive and r[2] in negative)]
    assert sorted(r.k for r in corpus.clean_corpus(df.repartition(4), "k", ["a", "b"]).collect()) == sequential(left)


def test_repeated_keys_are_reported(spark):
    corpus.check_unique(spark.range(3), "id")
    with pytest.raises(ValueError, match="not unique"):
        corpus.check_unique(spark.createDataFrame([(1,), (1,)], "id int"), "id")
