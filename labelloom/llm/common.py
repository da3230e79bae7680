"""Helpers that the operators share: table scans, Arrow batch maps, staged tables, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labelloom.session import cut_lineage, stage_table

#: Rows that a Python task handles at a time, so that its memory does not follow the Arrow batch size.
SLICE_ROWS = 512
#: Bytes of text in such a slice, for very long texts.
SLICE_BYTES = 4 << 20
#: Rows and bytes of an Arrow batch between Spark and its Python tasks; Spark's 10,000 rows and 64 MB suit short rows.
BATCH_ROWS, BATCH_SETTING = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES, BYTES_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(df: DataFrame) -> DataFrame:
    """`df`, after the session's Arrow batches have been bounded for rows that hold texts; lower bounds stay."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
        conf.set(BYTES_SETTING, BATCH_BYTES)
    return df


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of bounded rows and of bounded bytes on average."""
    for batch in batches:
        start = 0
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        while start < batch.num_rows:
            yield batch.slice(start, step)
            start += step


_HELD: list = []


def one_per_worker(make: Callable, *key):
    """`make(*key)`, kept for the tasks that follow in a Python worker; it holds one such object, whichever was asked for last."""
    if not _HELD or _HELD[0] != (make, key):
        forget()
        _HELD[:] = [(make, key), make(*key)]
    return _HELD[1]


def forget() -> None:
    """Drop that object: tasks of other kinds need the memory."""
    _HELD.clear()
    trim()


def give_back() -> None:
    """Return what Arrow holds in reserve: Python workers serve many tasks, one after another."""
    pa.default_memory_pool().release_unused()


def trim() -> None:
    """Return what all allocators hold in reserve, where the C library offers it; for the start of a task."""
    give_back()
    gc.collect()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def map_slices(df: DataFrame, make: Callable[[], Callable], schema: T.StructType | str) -> DataFrame:
    """`mapInArrow` by slices. `make()` runs once in a task and returns `slice -> list of arrays or None`."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(fields)

    def run(batches):
        trim()
        apply = make()
        for piece in slices(batches):
            give_back()
            columns = apply(piece)
            if columns is not None:
                arrays = [
                    c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type)
                    for c, f in zip(columns, arrow, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return text_batches(df).mapInArrow(run, fields)


def packed(values: np.ndarray) -> tuple[str, bytes]:
    """The name of the narrowest integers that hold the values, and their bytes."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, values.astype(kind).tobytes()


def unpacked(kind: str, data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.int64).reshape(rows, -1)


def fresh(columns: Sequence[str], name: str) -> str:
    """A column name that clashes with none of `columns`."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces_for(rows: int, per_piece: int) -> int:
    return max(1, -(-rows // per_piece))


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. Columns are bigint.

    Alternates two kinds of star: every node hands its smallest neighbour to its larger neighbours, then
    to its smaller ones. Edges never grow in number; hubs are aggregates (`min`), so no group of
    neighbours is gathered anywhere. The rounds end when a round changes nothing and follow the
    logarithm of the longest chain.
    """
    edges = cut_lineage(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    )
    last = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # larger neighbours of u go to the smallest one around u
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = large.where("u <> v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u")
        edges = cut_lineage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("node"), "component").union(
        roots.select(F.col("component").alias("node"), "component").distinct()
    )


def numbered_slots(
    df: DataFrame, group: str, keys: Sequence[str], rows: int, per_piece: int = 100_000, out: str = "slot"
) -> DataFrame:
    """Gapless 0-based number of every row in its group; pieces by a hash of `keys`, offsets from piece counts.

    A piece is a (group, hash) pair of `per_piece` of all `rows` at most on average, so no task sorts a whole
    group. Equal rows are interchangeable, hence ties do not matter.
    """
    pieces = pieces_for(rows, per_piece)
    cut = df.withColumn("__piece", F.pmod(F.xxhash64(*keys), F.lit(pieces)))
    sizes = cut.groupBy(group, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(group, "__piece").orderBy(*keys)) - 1
    return (
        cut.withColumn("__local", local)
        .join(offsets, [group, "__piece"])
        .withColumn(out, (F.col("__before") + F.col("__local")).cast("bigint"))
        .drop("__piece", "__local", "__before")
    )


__all__ = [
    "SLICE_ROWS",
    "connected_components",
    "cut_lineage",
    "forget",
    "fresh",
    "give_back",
    "map_slices",
    "numbered_slots",
    "one_per_worker",
    "packed",
    "pieces_for",
    "stage_table",
    "table",
    "text_batches",
    "unpacked",
]
