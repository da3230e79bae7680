"""A key index beside a store of Parquet files, so that a lookup opens only files that may hold a key.

The index has one row a file: its smallest and largest key and a Bloom filter of its keys. It is a table of
its own (`<store>.index`), appended to after the store has been. Files that are missing from it, because a
writer was cut short or never knew of it, are indexed by the next lookup, so the index is never ahead of the
store or trusted beyond what it covers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.session import cut_lineage

#: Bits a key and probes of a filter: a key that is not there opens less than one file in a thousand.
BITS, PROBES = 16, 7
#: Keys of a lookup whose hashes go to all tasks (8 bytes each); larger lookups read the whole store.
LOOKUP_KEYS = 1_000_000


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """Bit positions (keys by probes) in a filter of `size` bits."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(size)


def bloom_filter(hashes: np.ndarray) -> bytes:
    bits = np.zeros(max(64, -(-BITS * len(hashes) // 8) * 8), np.uint8)
    bits[_places(hashes, len(bits)).ravel()] = 1
    return np.packbits(bits).tobytes()


def may_hold(packed: bytes, hashes: np.ndarray) -> bool:
    bits = np.unpackbits(np.frombuffer(packed, np.uint8))
    return bool(bits[_places(hashes, len(bits))].all(axis=1).any())


def _plain(path):
    """One spelling of a file's place: `file:///a` and `file:/a` are the same."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/")


def stored_files(spark: SparkSession, store: str) -> DataFrame | None:
    """`(file)` of every Parquet file of a store, from its listing; None where there is no store."""
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(store)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return listed.select(_plain(F.col("path")).alias("file"))


def _read_index(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{store.rstrip('/')}.index")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None


def refresh(spark: SparkSession, store: str, key: str) -> DataFrame | None:
    """The index, after rows for the files that it lacks were appended; other files are not opened."""
    files = stored_files(spark, store)
    if files is None:
        return None
    index = _read_index(spark, store)
    missing = files if index is None else files.join(index.select("file"), "file", "left_anti")
    names = [r.file for r in cut_lineage(missing).collect()]  # the files of the last batches, or of a store that had no index
    if names:
        rows = spark.read.parquet(*names).select(_plain(F.col("_metadata.file_path")).alias("file"), F.xxhash64(key).alias("hash"), F.col(key).alias("key"))

        def filters(table: pa.Table) -> pa.Table:
            hashes = table.column("hash").to_numpy()
            return pa.table({"file": table.column("file")[:1], "bits": pa.array([bloom_filter(hashes)], pa.binary())})

        ranges = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        bits = rows.select("file", "hash").groupBy("file").applyInArrow(filters, "file string, bits binary")
        listed = spark.createDataFrame([(n,) for n in names], "file string")
        found = listed.join(ranges, "file", "left").join(bits, "file", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
        found.coalesce(1).write.mode("append").parquet(f"{store.rstrip('/')}.index")
        index = _read_index(spark, store)
    # a file that two writers have indexed counts once, a file that is gone not at all
    return index.dropDuplicates(["file"]).join(files, "file", "left_semi")


def candidate_files(index: DataFrame, keys: DataFrame, key: str) -> list[str] | None:
    """Files that may hold one of the keys; None if there are too many keys to ask each file for."""
    keys = cut_lineage(keys.select(F.xxhash64(key).alias("hash"), F.col(key).alias("key")).where("key is not null"))
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    if not n:
        return []
    if n > LOOKUP_KEYS:
        return None
    hashes = np.array([r.hash for r in keys.select("hash").distinct().collect()], np.int64)
    within = index.where((F.col("n") > 0) & (F.col("low") <= F.lit(high)) & (F.col("high") >= F.lit(low))).select("file", "bits")

    def ask(batches):
        for batch in batches:
            good = [may_hold(bits, hashes) for bits in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good))], names=["file"])

    return sorted(r.file for r in within.mapInArrow(ask, "file string").collect())


def not_stored(incoming: DataFrame, store: str, key: str) -> DataFrame:
    """The incoming rows whose key no file of the store holds; only candidate files are opened."""
    spark = incoming.sparkSession
    index = refresh(spark, store, key)
    if index is None:
        return incoming
    files = candidate_files(index, incoming, key)
    if files == []:
        return incoming
    stored = spark.read.parquet(*files) if files is not None else spark.read.parquet(store)
    return incoming.join(stored.select(key).distinct(), key, "left_anti")


def append_new(incoming: DataFrame, store: str, key: str) -> None:
    """Append the rows whose key is not stored. The same batch again, in part or as a whole, adds nothing twice."""
    fresh = not_stored(incoming.dropDuplicates([key]), store, key)
    # pinned before the write: the store that it was compared with is the one that grows
    cut_lineage(fresh).write.mode("append").parquet(store)
    refresh(incoming.sparkSession, store, key)
