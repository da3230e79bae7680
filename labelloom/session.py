"""Session helpers: lineage cuts in the shared folder and size-checked broadcasts."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows and bytes of a narrow side (digests, ids) that every executor can hold comfortably.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
# Bytes of an Arrow batch between Spark and its Python tasks where rows hold much; Spark's own bound is 64 MB.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def local_session(app: str = "labelloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="labelloom-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts and staged tables, as the session names it.

    Only a local session without the setting gets a folder of its own: on a cluster a machine-local
    folder would not be seen by the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="labelloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that a job writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and pins partition-dependent values."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """Lineage cut for wide rows: a Parquet table in the shared folder, so later steps prune columns."""
    path = staging_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """`df`, after the session's Arrow batches have been bounded in bytes, as rows may hold much; a lower bound stays."""
    spark = df.sparkSession
    now = spark.conf.get(BATCH_SETTING)
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= most:
        spark.conf.set(BATCH_SETTING, str(most))
    return df


def _held_bytes(field: T.StructField) -> Column:
    """Bytes of a value, roughly: texts and binaries as they are, 16 for others and for each array element."""
    name = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.array(name))), F.lit(0)) + 16
    return F.lit(16)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast `df` only after its rows and bytes have been counted; otherwise leave the join to shuffle.

    Meant for narrow key sets that filter a wide table: below both bounds the wide rows are not
    shuffled at all. The result of the join is the same on either side of the bounds.
    """
    staged = cut_lineage(df)
    size = sum((_held_bytes(f) for f in df.schema.fields), F.lit(0))
    rows, held = staged.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(staged) if rows <= max_rows and held <= max_bytes else staged


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt over all cores by `key` if its scan leaves most rows to a few tasks.

    A file of one row group is one task, whatever its size; heavy work on its rows would run on one core. Rows a task
    are counted on the key alone. A scan that is spread already is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    by_task = df.select(key).groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    total, most = by_task.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most * cores <= 2 * total:
        return df
    return df.repartition(max(4 * cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def null_safe_join(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of both sides in which a null equals a null; still an equi-join for Spark."""
    renamed = right.withColumnsRenamed({c: f"__same_{c}" for c in columns})
    if not columns:
        return left.join(renamed)  # one row on either side
    same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__same_{c}")) for c in columns))
    return left.join(renamed, same, how).drop(*[f"__same_{c}" for c in columns])
