"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITIVE_COLUMNS = ("DOI", "Title", "Abstract Note", "Language", "Item Type", "Publication Year")
# fold_<fold>_<model>_<loss>[_with_title][_run-<run>]...csv, a file or a directory of part files.
PREDICTION_NAME = r"(?:^|[/=])fold_(\d+)_([^/]+?)_(BCE|focal)(_with_title)?(?:_run-(\d+))?[^/]*\.csv(?:/|$)"


def _decoded(file_column: str) -> Column:
    """File metadata is percent-encoded; a literal plus sign must survive the decoding."""
    return F.url_decode(F.replace(F.col(file_column), F.lit("+"), F.lit("%2B")))


def scan_corpus(spark: SparkSession, directory: str, schema: T.StructType | None = None) -> DataFrame:
    """All Parquet files under a directory tree, in a given schema or in the union of the files' columns."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return (reader.option("mergeSchema", "true") if schema is None else reader.schema(schema)).parquet(directory)


def scan_positive_csv(spark: SparkSession, directory: str, prefix: str = "") -> DataFrame:
    """Curated lists: one directory of CSV files per label, all columns text, label from the directory.

    A label is the directory name without `prefix`. Directories without CSV files contribute nothing.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in POSITIVE_COLUMNS])
    rows = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("multiLine", "true")
        .option("escape", '"')
        .option("pathGlobFilter", "*.csv")
        .csv(f"{directory.rstrip('/')}/{prefix}*")
    )
    name = F.regexp_extract(_decoded("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return rows.withColumn("label", F.regexp_replace(name, f"^{prefix}[-_ ]?", ""))


def cast_year(df: DataFrame, column: str = "Publication Year") -> tuple[DataFrame, DataFrame]:
    """(rows with an int year or none, rows whose year text is no number) - the latter for quarantine."""
    parsed = F.expr(f"try_cast(`{column}` as int)")
    bad = F.col(column).isNotNull() & parsed.isNull()
    return df.where(~bad).withColumn(column, parsed), df.where(bad)


def scan_ids(spark: SparkSession, path: str, column: str = "PMID") -> DataFrame:
    """Distinct ids of a CSV list, as text."""
    return spark.read.option("header", "true").csv(path).select(F.col(column).cast("string")).distinct()


def _csv(spark: SparkSession, schema: T.StructType, multi_line: bool):
    """Quoted CSV. Fields with line breaks need `multi_line`, which makes each file one task."""
    return spark.read.schema(schema).option("header", "true").option("multiLine", str(multi_line).lower()).option("escape", '"')


def scan_splits(
    spark: SparkSession, root: str, schema: T.StructType, processed: bool = True, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(train, test) of a prepared data set; the train part raw or processed."""
    reader = _csv(spark, schema, multi_line)
    train = reader.csv(f"{root}/{'processed' if processed else 'raw'}_train")
    return train, reader.csv(f"{root}/test")


def scan_predictions(spark: SparkSession, pattern: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Prediction files of all models and folds; model, loss, title flag, fold and run from the file name.

    Spark writes a directory of part files where other tools write one file; both are read.
    """
    rows = _csv(spark, schema, multi_line).csv(pattern)
    file = _decoded("_metadata.file_path")

    def part(i: int):
        return F.regexp_extract(file, PREDICTION_NAME, i)

    return rows.withColumns(
        {
            "model": part(2),
            "loss_type": part(3),
            "with_title": part(4) != "",
            "fold": part(1).try_cast("int"),
            "run": part(5).try_cast("int"),
        }
    )


def read_folds(spark: SparkSession, path: str, run: int | None = None, fold: int | None = None) -> DataFrame:
    """Written splits; run and fold prune partitions."""
    splits = spark.read.parquet(path)
    if run is not None:
        splits = splits.where(F.col("run") == run)
    if fold is not None:
        splits = splits.where(F.col("fold") == fold)
    return splits


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of all appends; columns that came later are null in earlier rows."""
    return spark.read.option("mergeSchema", "true").parquet(path)
