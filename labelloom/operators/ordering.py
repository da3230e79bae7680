"""Numbering and running aggregates over groups of any size.

A plain `row_number() over (partition by label ...)` puts a whole label into one task. Here a group is
cut into pieces, each piece is numbered on its own, and small per-piece totals give the offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.session import cut_lineage, null_safe_join

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def seeded_digest(seed, *keys) -> Column:
    """md5 of `seed-key[-key]`: a shuffle order that does not depend on partitioning."""
    parts = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("-", *parts).cast("binary"))


def digest_positions(
    df: DataFrame,
    digest: str,
    groups: Sequence[str] = (),
    out: str = "pos",
    prefix: int = 4,
) -> DataFrame:
    """0-based position of every row inside its group, in the order of an md5 column.

    The first hex digits of a digest spread rows evenly and keep the order, so a group is cut into 16^prefix
    pieces and the offset of a piece is the count of the rows in earlier pieces. Null groups are groups.
    """
    groups = list(groups)
    piece = [*groups, "__piece"]
    keyed = df.withColumn("__piece", F.substring(digest, 1, prefix))
    before = Window.partitionBy(*groups).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*piece)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*piece, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    local = F.row_number().over(Window.partitionBy(*piece).orderBy(digest)) - 1
    return (
        null_safe_join(keyed.withColumn("__local", local), offsets, piece)
        .withColumn(out, (F.col("__offset") + F.col("__local")).cast("bigint"))
        .drop("__piece", "__local", "__offset")
    )


def running_aggregates(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str] | str,
    aggregates: Mapping[str, tuple[str, str]],
    descending: bool = False,
    totals: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Running sum/max/min (including the current row) of `{out: (op, column)}` inside each group.

    Rows are range-partitioned on (group, order), so a large group spans as many partitions as it
    needs. The partition number is pinned by a checkpoint before it is used in two branches. Totals
    of the whole group come from the same small table as the offsets.
    """
    groups = list(groups)
    totals = dict(totals or {})
    order = [order] if isinstance(order, str) else list(order)
    direction = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    ranged = df.repartitionByRange(*[F.col(g) for g in groups], *direction)
    staged = cut_lineage(ranged.withColumn("__piece", F.spark_partition_id()))

    piece = [*groups, "__piece"]
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    wanted = {**{f"__o_{o}": (spec, before) for o, spec in aggregates.items()}, **{o: (spec, whole) for o, spec in totals.items()}}
    per_piece = staged.groupBy(*piece).agg(
        *[_COMBINE[op](column).alias(f"__t_{out}") for out, ((op, column), _) in wanted.items()]
    )
    offsets = per_piece.select(
        *piece, *[_COMBINE[op](f"__t_{out}").over(frame).alias(out) for out, ((op, _), frame) in wanted.items()]
    )
    upto = (
        Window.partitionBy(*piece).orderBy(*direction).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = staged.select(
        *staged.columns,
        *[_COMBINE[op](column).over(upto).alias(f"__l_{out}") for out, (op, column) in aggregates.items()],
    )
    joined = null_safe_join(local, offsets, piece)
    merged = [_merge(op, F.col(f"__o_{out}"), F.col(f"__l_{out}")).alias(out) for out, (op, _) in aggregates.items()]
    return joined.select(*df.columns, *merged, *totals)


def _merge(op: str, offset: Column, local: Column) -> Column:
    if op == "sum":
        return F.coalesce(offset, F.lit(0)) + F.coalesce(local, F.lit(0))
    return F.greatest(offset, local) if op == "max" else F.least(offset, local)


def value_counts_running(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Distinct values of each group with their count `n`, the running count `n_upto` and the group `size`."""
    counts = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    return running_aggregates(counts, groups, value, {"n_upto": ("sum", "n")}, totals={"size": ("sum", "n")})


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles (pandas/NumPy default) without collecting a group.

    Running counts over the distinct values give the two order statistics around each rank.
    """
    groups = list(groups)
    if not groups:
        return exact_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, quantiles).drop("__all")
    counted = value_counts_running(df.where(F.col(value).isNotNull()), groups, value)
    aggs = []
    for name, q in quantiles.items():
        rank = (F.col("size") - 1) * F.lit(float(q))
        for side, target in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            holds = (F.col("n_upto") - F.col("n") <= target) & (target < F.col("n_upto"))
            aggs.append(F.max(F.when(holds, F.col(value))).alias(f"__{side}_{name}"))
        aggs.append(F.max(rank - F.floor(rank)).alias(f"__f_{name}"))
    picked = counted.groupBy(*groups).agg(F.max("size").alias("n"), *aggs)
    return picked.select(
        *groups,
        "n",
        *[
            (F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * F.col(f"__f_{name}")).alias(name)
            for name in quantiles
        ],
    )
