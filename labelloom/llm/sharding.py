"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Differencing keeps partial partitions, each a row of n parts with their bytes. The two with the largest
spread (largest minus smallest part) are combined in opposite order, the heaviest part of one with the
lightest of the other, until one is left. Here it runs as a tree of Spark jobs: buckets of some thousand
groups are differenced in a task each; what remains of a bucket is one partial partition of n numbers,
and these are differenced again, many buckets to a task, until some hundred nodes remain.

Levelled partitions cannot make room for a heavy group, so the last differencing takes single weights only:
the groups too heavy for a bucket, which never enter one (fewer than n times the nodes), each part of each
node as a lump of its own, and from every level one node left apart, down to the groups of one bucket, so
that there are ever finer weights to fill the shards around the heavy groups. Its size does not follow the
table. Group members then find their shard by joins with the small maps of the levels. Texts never move,
only their digests.

Defined results: null text has no bytes (size 8) and is a group of its own, apart from empty text; equal
texts stay together, however many; repeated rows are rows; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import numbered_slots, pieces_for, stage_table

#: Groups that a task differences at a time, and partial partitions of the level below.
BUCKET_GROUPS, FAN_IN = 20_000, 1_000
#: Nodes whose parts meet in the last differencing.
TOP_NODES = 250


def difference(partials: np.ndarray, parts: int) -> np.ndarray:
    """For each row of `partials` (items x parts) the final part of each of its parts (items x parts)."""
    items = len(partials)
    target = np.empty((items, parts), np.int64)
    # A node is (part sums in falling order, origin of each part); an origin is a leaf or a pair of origins.
    heap = []
    for item in range(items):
        order = np.argsort(-partials[item], kind="stable")
        sums = partials[item][order].tolist()
        heap.append((sums[-1] - sums[0], item, sums, [(item, int(p)) for p in order]))
    heapq.heapify(heap)
    ticket = items
    while len(heap) > 1:
        _, _, sums, origin = heapq.heappop(heap)
        _, _, other, more = heapq.heappop(heap)
        joined = [(s + o, (a, b)) for s, o, a, b in zip(sums, reversed(other), origin, reversed(more), strict=True)]
        joined.sort(key=lambda x: -x[0])
        sums = [j[0] for j in joined]
        heapq.heappush(heap, (sums[-1] - sums[0], ticket, sums, [j[1] for j in joined]))
        ticket += 1
    for part, origin in enumerate(heap[0][3] if heap else []):
        stack = [origin]
        while stack:
            a, b = stack.pop()
            if isinstance(a, tuple):
                stack += (a, b)
            else:
                target[a, b] = part
    return target


def _difference_groups(parts: int):
    """Groups of a bucket (one weight each): their parts, and the bucket's bytes by part."""

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "digest"], ascending=[False, True], na_position="last")
        partials = np.zeros((len(pdf), parts), np.int64)
        partials[:, 0] = pdf["bytes"].to_numpy()
        return pd.DataFrame({"digest": pdf["digest"], "bytes": pdf["bytes"], "bucket": pdf["bucket"], "part": difference(partials, parts)[:, 0]})

    return apply


def _difference_parts(parts: int):
    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="node", columns="part", values="bytes").reindex(columns=range(parts)).fillna(0).sort_index()
        target = difference(wide.to_numpy().astype(np.int64), parts)
        return pd.DataFrame(
            {
                "node": np.repeat(wide.index.to_numpy(), parts),
                "part": np.tile(np.arange(parts), len(wide)),
                "bytes": wide.to_numpy().astype(np.int64).ravel(),
                "up": np.repeat(pdf["up"].to_numpy()[:1], wide.size),
                "up_part": target.ravel(),
            }
        )

    return apply


def _difference_top(parts: int):
    """Single weights (groups, and parts of nodes) and their shards."""

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "digest", "level", "node", "part"], ascending=[False, True, True, True, True])
        partials = np.zeros((len(pdf), parts), np.int64)
        partials[:, 0] = pdf["bytes"].to_numpy()
        return pdf.assign(shard=difference(partials, parts)[:, 0])

    return apply


def shard_of_groups(groups: DataFrame, parts: int, bucket_groups: int = BUCKET_GROUPS, fan_in: int = FAN_IN) -> DataFrame:
    """(digest, shard) of groups (digest, bytes)."""
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    nodes = pieces_for(n, bucket_groups)
    tops = min(nodes, fan_in, TOP_NODES)
    # a single bucket is the last differencing itself
    heavy = (F.col("bytes") > total // (parts * tops)) if nodes > 1 else F.lit(False)
    bucketed = groups.withColumn("bucket", F.when(~heavy, F.pmod(F.xxhash64("digest", F.lit(10)), F.lit(nodes))))
    apart = F.coalesce(F.col("bucket"), F.lit(0)) == 0
    # lumps have an empty digest, groups have no place in a level
    item = "digest binary, level int, node bigint, part bigint, bytes bigint"
    single = bucketed.where(apart).select("digest", F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("part"), "bytes")
    if nodes == 1:
        return single.groupBy("level").applyInPandas(_difference_top(parts), f"{item}, shard int").select("digest", "shard")

    def lumps(sums: DataFrame, level: int) -> DataFrame:
        return sums.select(F.lit(b"").alias("digest"), F.lit(level).alias("level"), "node", "part", "bytes")

    placed = bucketed.where(~apart).groupBy("bucket").applyInPandas(
        _difference_groups(parts), "digest binary, bytes bigint, bucket bigint, part bigint"
    )
    placed = stage_table(placed, "shard-buckets")
    sums = placed.groupBy(F.col("bucket").alias("node"), "part").agg(F.sum("bytes").alias("bytes"))
    where = placed.select("digest", F.lit(0).alias("level"), F.col("bucket").alias("node"), "part")
    items, depth = single, 0
    while nodes > tops:
        nodes = max(tops, pieces_for(nodes, fan_in))
        up = F.pmod("node", F.lit(nodes))
        items = items.union(lumps(sums.where(up == 0), depth))
        level = stage_table(
            sums.where(up != 0).withColumn("up", up).groupBy("up").applyInPandas(
                _difference_parts(parts), "node bigint, part bigint, bytes bigint, up bigint, up_part bigint"
            ),
            "shard-level",
        )
        sums = level.groupBy(F.col("up").alias("node"), F.col("up_part").alias("part")).agg(F.sum("bytes").alias("bytes"))
        moved = level.select(F.lit(depth).alias("level"), "node", "part", "up", "up_part")
        depth += 1
        where = where.join(moved, ["level", "node", "part"], "left").select(
            "digest",
            F.when(F.col("up").isNotNull(), F.lit(depth)).otherwise(F.col("level")).alias("level"),
            F.coalesce("up", "node").alias("node"),
            F.coalesce("up_part", "part").alias("part"),
        )
    items = items.union(lumps(sums, depth))
    top = items.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_difference_top(parts), f"{item}, `all` int, shard int")
    top = stage_table(top.drop("all"), "shard-top")
    alone = top.where("level = -1").select("digest", "shard")
    return alone.union(where.join(top.where("level >= 0").drop("digest", "bytes"), ["level", "node", "part"]).select("digest", "shard"))


def balanced_shards(
    df: DataFrame,
    parts: int = 24,
    id_column: str = "doc_id",
    text_column: str = "text",
    overhead: int = 8,
    bucket_groups: int = BUCKET_GROUPS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Per row: id, size (bytes of the text and `overhead`), text_crc32, shard, slot. Law: near equal bytes."""
    raw = F.col(text_column).cast("string").cast("binary")
    rows = stage_table(
        df.select(
            F.col(id_column),
            (F.coalesce(F.octet_length(raw), F.lit(0)) + overhead).cast("bigint").alias("size"),
            F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
            # a null text has a digest that no text has
            F.coalesce(F.unhex(F.sha2(raw, 256)), F.lit(b"null")).alias("digest"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    placed = rows.join(shard_of_groups(groups, parts, bucket_groups, fan_in), "digest")
    return numbered_slots(placed, "shard", [id_column, "text_crc32", "size"], rows.count()).drop("digest")


def sharded(documents: DataFrame, parts: int = 24) -> DataFrame:
    return balanced_shards(documents, parts).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
