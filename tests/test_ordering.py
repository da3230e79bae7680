import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators.ordering import digest_positions, exact_quantiles, running_aggregates, seeded_digest


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(7)
    return [(i, "hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randint(0, 400) / 8, rng.randint(0, 5)) for i in range(6000)]


def test_digest_positions(spark, skewed):
    df = spark.createDataFrame([(r[0], r[1]) for r in skewed], "k long, g string").repartition(7)
    placed = digest_positions(df.withColumn("d", seeded_digest(3, "k")), "d", ["g"], "p", prefix=1)
    got = {(r.g, r.k): r.p for r in placed.collect()}
    for g in {r[1] for r in skewed}:
        order = sorted((hashlib.md5(f"3-{r[0]}".encode()).hexdigest(), r[0]) for r in skewed if r[1] == g)
        assert [got[g, k] for _, k in order] == list(range(len(order)))


@pytest.mark.parametrize("descending", [False, True])
def test_running_aggregates(spark, skewed, descending):
    df = spark.createDataFrame([r[1:] + (r[0],) for r in skewed], "g string, v double, w long, k long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep the groups cut into pieces
    try:
        result = running_aggregates(
            df, ["g"], ["v", "k"], {"s": ("sum", "w"), "hi": ("max", "w"), "lo": ("min", "w")}, descending, {"n": ("sum", "w")}
        ).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = {r.k: (r.s, r.hi, r.lo, r.n) for r in result}
    assert len(got) == len(skewed)
    for g in {r[1] for r in skewed}:
        rows = sorted(((r[2], r[0], r[3]) for r in skewed if r[1] == g), reverse=descending)
        w = np.array([r[2] for r in rows])
        for i, (_, k, _) in enumerate(rows):
            assert got[k] == (w[: i + 1].sum(), w[: i + 1].max(), w[: i + 1].min(), w.sum())


def test_exact_quantiles(spark, skewed):
    df = spark.createDataFrame([(r[1], r[2]) for r in skewed] + [("a", None)], "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    for g in {r[1] for r in skewed}:
        v = [r[2] for r in skewed if r[1] == g]
        assert np.allclose([got[g].a, got[g].b, got[g].c], np.quantile(v, [0.25, 0.5, 0.9]))
    whole = exact_quantiles(df, [], "v", {"m": 0.5}).collect()
    assert len(whole) == 1 and whole[0].m == pytest.approx(np.median([r[2] for r in skewed]))


def test_order_is_independent_of_partitions(spark):
    df = spark.range(500).withColumn("d", seeded_digest(1, F.col("id")))
    one = {tuple(r) for r in digest_positions(df.repartition(1), "d").select("id", "pos").collect()}
    many = {tuple(r) for r in digest_positions(df.repartition(13), "d").select("id", "pos").collect()}
    assert one == many
