"""Lloyd's clustering with the dimensions dealt to shards.

The kept vectors are packed once: a batch of vectors is cut into column blocks, one row a block, staged by
block. A round is one job of three steps. Tasks over column blocks compare their columns with their slice
of the centroids and emit exact partial distances. These meet by batch, are added over the blocks, and the
nearest centroid is taken. The choices go back to the blocks, where every shard adds up its own columns by
cluster and makes its new slice of the centroids; no task and no driver sees whole centroids while the
rounds run. Only sums of a block's width by cluster are combined, once a task, so a cluster that holds most
vectors costs no more than another one.

Components are integers, so distances and means are exact. They travel in the narrowest integers that
hold them: the rounds shuffle about half the bytes of single-precision input, and as much again in distances for
8 clusters and 4 blocks.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no
part; repeated rows are vectors of their own; equal distances go to the smaller number; fewer vectors than
centroids give fewer centroids; an empty table gives no rows; vectors without an id are drawn last.
Components beyond +-sqrt(2^61 / dimensions) after scaling are held there, so that a distance fits a bigint
(none is, below 131,000 for 64 dimensions at 1024); sums beyond a bigint are held at its end.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import packed, slices, unpacked
from labelloom.session import BROADCAST_BYTES, cut_lineage, staging_path

#: Column blocks that the dimensions are cut into, if there are as many.
BLOCKS = 4
#: Vectors of a batch at most.
BATCH_ROWS = 2_048
_SLICES = "batch string, block int, n int, width int, kind string, cells binary, ids array<bigint>"
_CENTROIDS = "block int, k int, width int, slice binary"
_MOST = 2**63 - 1


def partial_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows by centroids) over the given columns."""
    out = np.zeros((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        step = x - c
        out[:, k] = np.einsum("ij,ij->i", step, step)
    return out


def _columns(dims: int, blocks: int) -> list[tuple[int, int]]:
    edges = [dims * b // blocks for b in range(blocks + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def whole_vectors(df: DataFrame, dims: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """(id, x): the vectors that take part, as integers."""
    limit = float(math.isqrt(2**61 // dims))
    v = F.col(vector_column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(limit)), F.lit(-limit))))
    return df.where((F.size(v) == dims) & fine).select(F.col(id_column).cast("bigint").alias("id"), held.alias("x"))


def _staged(vectors: DataFrame, dims: int, blocks: int) -> DataFrame:
    cuts = _columns(dims, blocks)

    def cut(batches):
        for piece in slices(batches, rows=BATCH_ROWS):
            n, name = piece.num_rows, uuid.uuid4().hex
            x = piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
            kinds, cells = zip(*(packed(x[:, a:b]) for a, b in cuts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (blocks + 1)),
                    pa.array([*range(blocks), -1], pa.int32()),
                    pa.array([n] * (blocks + 1), pa.int32()),
                    pa.array([*(b - a for a, b in cuts), 0], pa.int32()),
                    pa.array([*kinds, None], pa.string()),
                    pa.array([*cells, None], pa.binary()),
                    pa.array([*[None] * blocks, piece.column(0).to_pylist()], pa.list_(pa.int64())),
                ],
                names=["batch", "block", "n", "width", "kind", "cells", "ids"],
            )

    path = staging_path(vectors.sparkSession, "column-blocks")
    vectors.mapInArrow(cut, _SLICES).write.partitionBy("block").parquet(path)
    return vectors.sparkSession.read.schema(_SLICES).parquet(path)


def _first_centroids(vectors: DataFrame, k: int, seed: str, dims: int, blocks: int) -> tuple[int, DataFrame]:
    """The k vectors whose ids have the smallest digests; k * dims numbers are the model and may pass the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(digest.alias("digest"), "x").orderBy(F.asc_nulls_last("digest"), "x").limit(k).collect()
    x = np.array([r.x for r in rows], np.int64).reshape(len(rows), dims)
    parts = [(b, len(rows), hi - lo, bytearray(x[:, lo:hi].astype("<i8").tobytes())) for b, (lo, hi) in enumerate(_columns(dims, blocks))]
    return len(rows), vectors.sparkSession.createDataFrame(parts, _CENTROIDS)


def _assigned(staged: DataFrame, centroids: DataFrame, final: bool) -> DataFrame:
    """Per batch and block the chosen clusters; `final`: per vector its id, cluster and distance."""
    blocks = staged.where("block >= 0").select("batch", "block", "n", "kind", "cells").join(centroids, "block")

    def distances(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = unpacked(row["kind"], row["cells"], row["n"])
                slice_ = np.frombuffer(row["slice"], "<i8").reshape(row["k"], -1)
                kind, cells = packed(partial_distances(x, slice_))
                names = ["batch", "block", "n", "kind", "cells"]
                yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in names[:3]}, "kind": kind, "cells": cells}], schema)

    schema = pa.schema([("batch", pa.string()), ("block", pa.int32()), ("n", pa.int32()), ("kind", pa.string()), ("cells", pa.binary())])
    partial = blocks.mapInArrow(distances, "batch string, block int, n int, kind string, cells binary")

    def total(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[dict]]:
        rows = table.to_pylist()
        parts = [r for r in rows if r["block"] >= 0]
        summed = sum(unpacked(r["kind"], r["cells"], r["n"]) for r in parts)
        nearest = summed.argmin(axis=1)  # the first of equal ones
        return nearest, summed[np.arange(len(nearest)), nearest], rows

    if not final:

        def choose(table: pa.Table) -> pa.Table:
            nearest, _, rows = total(table)
            kind, cells = packed(nearest)
            return pa.table({"batch": [r["batch"] for r in rows], "block": pa.array([r["block"] for r in rows], pa.int32()), "as": [kind] * len(rows), "chosen": pa.array([cells] * len(rows), pa.binary())})

        return partial.groupBy("batch").applyInArrow(choose, "batch string, block int, as string, chosen binary")

    def place(table: pa.Table) -> pa.Table:
        nearest, distance, rows = total(table)
        ids = next(r["ids"] for r in rows if r["block"] < 0)
        return pa.table({"id": pa.array(ids, pa.int64()), "cluster": pa.array(nearest, pa.int32()), "distance": pa.array(distance, pa.int64())})

    ids = staged.where("block < 0").select("batch", "block", "n", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("binary").alias("cells"), "ids")
    return partial.withColumn("ids", F.lit(None).cast("array<bigint>")).unionByName(ids).groupBy("batch").applyInArrow(place, "id bigint, cluster int, distance bigint")


def _moved(staged: DataFrame, chosen: DataFrame, centroids: DataFrame) -> DataFrame:
    """New slices of the centroids, made shard by shard."""
    rows = staged.where("block >= 0").select("batch", "block", "n", "kind", "cells").join(chosen, ["batch", "block"]).join(
        centroids.select("block", "k"), "block"
    )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x, to = unpacked(row["kind"], row["cells"], row["n"]), np.frombuffer(row["chosen"], row["as"])
                if row["block"] not in sums:
                    sums[row["block"]] = np.zeros((row["k"], x.shape[1] + 1), np.int64)
                one = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
                np.add.at(sums[row["block"]], to, one)
        for block, found in sums.items():
            yield pa.RecordBatch.from_pylist([{"block": block, "k": len(found), "sums": found.tobytes()}], schema)

    schema = pa.schema([("block", pa.int32()), ("k", pa.int32()), ("sums", pa.binary())])
    sums = rows.mapInArrow(add, "block int, k int, sums binary").withColumn("slice", F.lit(None).cast("binary"))
    before = centroids.select("block", "k", F.lit(None).cast("binary").alias("sums"), "slice")

    def move(table: pa.Table) -> pa.Table:
        found = table.to_pylist()
        old = next(np.frombuffer(r["slice"], "<i8").reshape(r["k"], -1) for r in found if r["slice"] is not None)
        k, width = old.shape
        total = sum((np.frombuffer(r["sums"], np.int64).reshape(k, -1) for r in found if r["sums"] is not None), np.zeros((k, width + 1), np.int64))
        new = np.where(total[:, :1] > 0, total[:, 1:] // np.maximum(total[:, :1], 1), old)  # floors, also below 0
        return pa.table({"block": pa.array([found[0]["block"]], pa.int32()), "k": pa.array([k], pa.int32()), "width": pa.array([width], pa.int32()), "slice": pa.array([new.astype("<i8").tobytes()], pa.binary())})

    return sums.unionByName(before).groupBy("block").applyInArrow(move, _CENTROIDS)


def lloyd(
    df: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    seed: str = "3",
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    blocks: int = BLOCKS,
) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, distance) of every vector that takes part, and the last centroids by column block."""
    blocks = min(blocks, dims)
    vectors = whole_vectors(df, dims, scale, id_column, vector_column)
    n, centroids = _first_centroids(vectors, k, seed, dims, blocks)
    if not n:
        return df.sparkSession.createDataFrame([], "id bigint, cluster int, distance bigint"), centroids
    staged = _staged(vectors, dims, blocks)
    # the slices of all blocks hold 8 * k * dims bytes; beyond the bound they meet the blocks by a shuffle
    small = (lambda c: F.broadcast(c)) if 8 * k * dims <= BROADCAST_BYTES else (lambda c: c)
    for _ in range(rounds):
        chosen = _assigned(staged, small(centroids), final=False)
        centroids = cut_lineage(_moved(staged, chosen, small(centroids)))
    return cut_lineage(_assigned(staged, small(centroids), final=True)), centroids


def centroid_rows(centroids: DataFrame) -> DataFrame:
    """(cluster, centroid_sha256, centroid) of the model's k rows."""
    parts = sorted(centroids.collect(), key=lambda r: r.block)  # k * dims numbers
    if not parts or not parts[0].k:
        return centroids.sparkSession.createDataFrame([], "cluster int, centroid_sha256 string, centroid array<bigint>")
    whole = np.concatenate([np.frombuffer(r.slice, "<i8").reshape(r.k, -1) for r in parts], axis=1).tolist()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in whole]
    return centroids.sparkSession.createDataFrame(list(zip(range(len(whole)), digests, whole, strict=True)), "cluster int, centroid_sha256 string, centroid array<bigint>")


def clusters(embeddings: DataFrame) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia and the digest of its centroid."""
    placed, centroids = lloyd(embeddings)
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    held = lambda c: F.least(c, F.lit(_MOST).cast("decimal(38,0)")).cast("bigint")
    per = placed.groupBy("cluster").agg(wide.alias("one"))  # at most k rows
    every = F.sum("one").over(Window.partitionBy(F.lit(0))).cast("decimal(38,0)")
    per = per.select("cluster", held(F.col("one")).alias("cluster_inertia"), held(every).alias("inertia"))
    model = F.broadcast(per.join(centroid_rows(centroids), "cluster"))
    return placed.join(model, "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
