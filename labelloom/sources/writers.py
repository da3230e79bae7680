"""Sinks. Partitioned writes rebalance first, so a large partition is written by several tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.session import null_safe_join, stage_table


def write_shards(df: DataFrame, path: str, shards: int | None = None) -> None:
    """Files of the advised size, or a set number of them (four in small local sets)."""
    parts = df.repartition(shards) if shards else df.hint("rebalance")
    parts.write.mode("overwrite").parquet(path)


def write_cleaned(df: DataFrame, path: str, as_csv: bool = False) -> None:
    """The cleaned set, as Parquet or as CSV with quoting that survives line breaks."""
    writer = df.write.mode("overwrite")
    if as_csv:
        writer.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def commit_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the partitions that `df` has rows of, and no others; a repeated call changes nothing.

    Commit rows (partition, rows) beside the table are withdrawn before the data are replaced and written
    after it, so a partition whose write was cut short has none and is not read (`committed`).
    """
    by = list(by)
    staged = stage_table(df, "partitions")
    size = staged.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    commits = f"{path.rstrip('/')}.commits"

    def replace(rows: DataFrame, to: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(to)

    replace(size.withColumn("n_rows", F.lit(-1).cast("bigint")), commits)
    replace(staged.hint("rebalance", *by), path)
    replace(size, commits)


def committed(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """The rows of `path` in committed partitions; columns that only some files have are filled up."""
    commits = spark.read.parquet(f"{path.rstrip('/')}.commits").where("n_rows >= 0").select(*by)
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    return null_safe_join(rows, F.broadcast(commits), by, "left_semi")  # a row for each partition


def write_folds(splits: DataFrame, path: str) -> None:
    commit_partitions(splits, path, ["run", "fold"])


def write_test_folds(test_rows: DataFrame, path: str) -> None:
    commit_partitions(test_rows, path, ["run", "fold"])


def append_metrics(rows: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Append result rows; new columns are allowed. With `by`, rows of the same run replace what it wrote before."""
    if by:
        commit_partitions(rows, path, by)
    else:
        rows.write.mode("append").parquet(path)


def write_predictions(scored: DataFrame, path: str, by: Sequence[str] = ("model", "loss_type", "run", "fold")) -> None:
    commit_partitions(scored, path, by)


def wide_predictions(scored: DataFrame, keys: Sequence[str], labels: Sequence[str], label: str = "label") -> DataFrame:
    """Long predictions in the published layout: `{label}_label, {label}_pred, {label}_score` per row."""
    cells = [
        F.max(F.when(F.col(label) == name, F.col(source))).alias(f"{name}_{suffix}")
        for name in labels
        for suffix, source in (("label", "y"), ("pred", "pred"), ("score", "score"))
    ]
    return scored.groupBy(*keys).agg(*cells)


def enrichment_audit(enriched: DataFrame, *keep: str) -> DataFrame:
    """Rows changed by an enrichment with the changed fields as text."""
    changed = enriched.where(F.size("updated_fields") > 0)
    return changed.select(*keep, "title", "abstract", F.array_join("updated_fields", ",").alias("updated_fields"))


def write_enrichment_audit(enriched: DataFrame, path: str, *keep: str) -> None:
    enrichment_audit(enriched, *keep).write.mode("overwrite").option("header", "true").option("quoteAll", "true").option(
        "escape", '"'
    ).csv(path)
