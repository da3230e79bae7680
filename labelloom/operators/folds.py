"""Leak-free stratified folds, keyed by row key and never by row position."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.operators.ordering import digest_positions, seeded_digest
from labelloom.session import broadcast_if_small


def labelset(labels: Sequence[str]) -> Column:
    """The label combination of a row as text, e.g. `1|0|1`."""
    return F.concat_ws("|", *[F.coalesce(F.col(name), F.lit(0)).cast("string") for name in labels])


def stratified_kfold(
    df: DataFrame,
    key: str,
    labels: Sequence[str],
    n_folds: int = 5,
    n_runs: int = 1,
    seed: int = 42,
) -> DataFrame:
    """Test fold of every row and run: `(key, run, labelset, set_pos, set_offset, fold)`.

    Rows with equal label sets are interchangeable, so each label set, rarest first, is dealt to the
    folds in turn in a seeded shuffle order. Every fold gets the same number of rows of a label set
    to within one, and the folds differ in total size by at most one. `n_runs` shuffles are derived
    from the base seed.
    """
    runs = F.explode(F.array(*[F.lit(r) for r in range(n_runs)]))
    keyed = df.select(key, labelset(labels).alias("labelset")).withColumn("run", runs)
    keyed = keyed.withColumn("__digest", seeded_digest(seed, "run", key))
    placed = digest_positions(keyed, "__digest", ["run", "labelset"], "set_pos").drop("__digest")
    # One row per run and label set that occurs from here on.
    rarest_first = (
        Window.partitionBy("run").orderBy("__n", "labelset").rowsBetween(Window.unboundedPreceding, -1)
    )
    sets = (
        keyed.groupBy("run", "labelset")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("run", "labelset", F.coalesce(F.sum("__n").over(rarest_first), F.lit(0)).alias("set_offset"))
    )
    return placed.join(broadcast_if_small(sets), ["run", "labelset"]).select(
        key,
        "run",
        "labelset",
        "set_pos",
        "set_offset",
        F.expr(f"cast((set_offset + set_pos) % {n_folds} as int)").alias("fold"),
    )


#: Label sets whose quotas are worked out on the driver; there are at most 2^labels of them.
MAX_SETS = 2_000_000


def set_quotas(sets: Sequence[tuple[tuple[int, ...], int]], n_folds: int) -> list[list[int]]:
    """Rows of every label set `(bits, rows)` for every fold.

    Every fold gets the whole part of an equal share of each set. The rows that are left go one by one, those with
    the rarest label first, to the fold that lacks most of all their labels together, the room left in the fold
    among them; ties go to the lowest fold. Counts of a label in two folds then differ by 1 for few labels,
    by 2 to 3 for 20 to 30 labels on nearly as many label sets as rows (measured; there is no bound for every table).
    """
    quotas = [[n // n_folds] * n_folds for _, n in sets]
    left = [n % n_folds for _, n in sets]
    labels_of = [[x for x, bit in enumerate(bits) if bit] for bits, _ in sets]
    open_rows = [0] * (len(sets[0][0]) if sets else 0)
    for k, of in enumerate(labels_of):
        for x in of:
            open_rows[x] += left[k]
    lacks = [[rows / n_folds] * n_folds for rows in open_rows]
    room = [sum(left) / n_folds] * n_folds
    rarest = [min((open_rows[x] for x in of), default=sum(left)) for of in labels_of]
    for k in sorted(range(len(sets)), key=lambda k: (rarest[k], -len(labels_of[k]), k)):
        of = labels_of[k]
        for _ in range(left[k]):
            fold = max(range(n_folds), key=lambda f: (sum(lacks[x][f] for x in of) + 0.5 * room[f], -f))
            quotas[k][fold] += 1
            room[fold] -= 1
            for x in of:
                lacks[x][fold] -= 1
    return quotas


def quota_kfold(df: DataFrame, key: str, labels: Sequence[str], n_folds: int = 5, n_runs: int = 1, seed: int = 42) -> DataFrame:
    """Test fold of every row and run `(key, run, labelset, fold)`, balanced by single labels.

    `stratified_kfold` keeps every label set even, which says little of a label once there are nearly as many sets as rows.
    Here each set has a quota for each fold (`set_quotas`), worked out on the table of label sets, and takes
    its rows in a seeded order; rows stay distributed. The order of the folds turns with the run.
    """
    keyed = df.select(key, labelset(labels).alias("labelset"))
    counted = keyed.groupBy("labelset").agg(F.count(F.lit(1)).alias("n")).orderBy("labelset").limit(MAX_SETS + 1).collect()
    if len(counted) > MAX_SETS:
        raise ValueError(f"more than {MAX_SETS} label sets")
    quotas = set_quotas([(tuple(int(b) for b in r.labelset.split("|")), r.n) for r in counted], n_folds)
    ends = [(r.labelset, np.cumsum(q).tolist()) for r, q in zip(counted, quotas, strict=True)]
    table = df.sparkSession.createDataFrame(ends, "labelset string, ends array<bigint>")
    runs = F.explode(F.array(*[F.lit(r) for r in range(n_runs)]))
    placed = keyed.withColumn("run", runs).withColumn("__digest", seeded_digest(seed, "run", key))
    placed = digest_positions(placed, "__digest", ["run", "labelset"], "__pos")
    # the fold whose rows end beyond the position
    passed = F.size(F.filter("ends", lambda e: e <= F.col("__pos")))
    fold = F.pmod(passed + F.col("run"), F.lit(n_folds)).cast("int")
    return placed.join(broadcast_if_small(table), "labelset").select(key, "run", "labelset", fold.alias("fold"))


def label_balance(assigned: DataFrame, labels: Sequence[str], n_folds: int) -> DataFrame:
    """Per run and label: rows, and the smallest and largest count in a fold."""
    bits = F.split("labelset", r"\|")
    cells = F.array(*[F.struct(F.lit(name).alias("label"), F.get(bits, i).cast("int").alias("y")) for i, name in enumerate(labels)])
    folds_of = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("f")
    counts = assigned.select("run", "fold", F.inline(cells)).groupBy("run", "label", "fold").agg(F.sum("y").alias("n"))
    grid = counts.select("run", "label").distinct().select("run", "label", folds_of)
    full = grid.join(counts.withColumnRenamed("fold", "f"), ["run", "label", "f"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.groupBy("run", "label").agg(F.sum("n").alias("n_pos"), F.min("n").alias("least"), F.max("n").alias("most"))


def fold_splits(folds: DataFrame, key: str, n_folds: int = 5, dev_percent: int = 30) -> DataFrame:
    """One row per (key, run, fold) with its split: test, dev or train.

    The rows of a label set outside the test fold keep their shuffle order; their rank follows from
    `set_pos` by arithmetic, and every rank at which `rank * dev_percent / 100` passes a whole number
    goes to dev. No further shuffle and no window is needed.
    """
    held = folds.withColumnRenamed("fold", "__test").withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    )
    # Number of positions below x that are dealt to the fold.
    dealt = "({x} + " + str(n_folds - 1) + " - fold) div " + str(n_folds)
    in_fold = dealt.format(x="(set_offset + set_pos)") + " - " + dealt.format(x="set_offset")
    rank = f"(set_pos - ({in_fold}))"
    is_dev = f"(({rank} + 1) * {dev_percent}) div 100 > ({rank} * {dev_percent}) div 100"
    return held.select(
        key,
        "run",
        "fold",
        "labelset",
        F.expr(f"case when fold = __test then 'test' when {is_dev} then 'dev' else 'train' end").alias("split"),
    )


def train_dev_test(
    df: DataFrame,
    key: str,
    labels: Sequence[str],
    n_folds: int = 5,
    n_runs: int = 1,
    seed: int = 42,
    dev_percent: int = 30,
) -> DataFrame:
    """Stratified folds and their train/dev/test splits in one call."""
    return fold_splits(stratified_kfold(df, key, labels, n_folds, n_runs, seed), key, n_folds, dev_percent)


def fold_select(data: DataFrame, splits: DataFrame, key: str, run: int, fold: int, split: str) -> DataFrame:
    """Rows of one run, fold and split; the filters reach the partitions of a written split table."""
    wanted = splits.where((F.col("run") == run) & (F.col("fold") == fold) & (F.col("split") == split))
    return data.join(broadcast_if_small(wanted.select(key)), key, "left_semi")


def fold_report(splits: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """Size and positives per label of every (run, fold, split)."""
    bits = F.split("labelset", r"\|")
    return splits.groupBy("run", "fold", "split").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.get(bits, i).cast("int")).alias(f"n_{name}") for i, name in enumerate(labels)],
    )


def overlap_report(splits: DataFrame, key: str) -> DataFrame:
    """Rows that a (run, fold) holds in more than one split or not at all; both must be zero."""
    per_key = splits.groupBy("run", "fold", key).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.count_if(F.col("split") == "test").alias("__test"),
    )
    return per_key.groupBy("run", "fold").agg(
        F.count_if(F.col("__rows") > 1).alias("repeated"),
        F.sum("__test").alias("n_test"),
        F.count(F.lit(1)).alias("n_keys"),
    )


def run_seeds(base_seed: int, n_runs: int) -> list[str]:
    """The seed text of every run, as it enters the shuffle digest."""
    return [f"{base_seed}-{run}" for run in range(n_runs)]


def test_folds(data: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Union of all test folds: the data rows with the run and fold that tests them."""
    tests = splits.where(F.col("split") == "test").select(key, "run", "fold")
    return data.join(tests, key)


test_folds.__test__ = False
