"""Exact top-k inner products by no-random-access aggregation over sorted lists.

One list per dimension, sorted by value, is read in steps: from its top for queries with a positive
weight there, from its bottom for a negative one; lists without weight are not read. An entry that was read
adds its product to its vector's score. What a vector has not shown yet is bounded by the value where its list is being
read (above) and by the far end of the list (below), so every vector has a lower and an upper score bound.
Reading stops when the upper bounds of all but a few vectors have fallen below the k-th lower bound; the final scores
of those few are then resolved. `n_read` is the number of entries that were read for a query; it follows the groups' number.

Vectors are cut into blocks by a hash of their id, each packed into one row with lists of its own; queries, a small share of the
rows, are packed into parts. Blocks and parts meet in squares of `SIDE` by `SIDE` at most, so that a block is copied once
for so many parts and a part once for so many blocks; a square is a group of its own, in bounded memory. It sorts each block's
lists once and keeps k rows for each query: the k-th score of the blocks before is a bound for the next one. Nothing is broadcast.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id,
take no part; rows of one id count once, with the smallest vector; vectors of other lengths than the
query's are no candidates; equal scores go to the smaller id; scores beyond a bigint are held at its ends; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import cut_lineage, packed, pieces_for, stage_table, unpacked

#: Rows of a block of vectors and of a part of the queries, and of either so many that meet in a group.
VECTOR_BLOCK, QUERY_BLOCK, SIDE = 2048, 1024, 32
#: Queries that read the lists of a block side by side.
TOGETHER = 128
#: Shares of the lists up to which a step reads. Bounds of many dimensions tighten late.
STEPS = (0.25, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0)
#: Reading stops with this many vectors (times k) that can still qualify.
RESOLVE = 40
#: Above this sum of products 64-bit floats are no longer exact.
EXACT = 1 << 53
#: Below this one 32-bit floats are exact too.
EXACT_SHORT = 1 << 24
#: Scores beyond a bigint are held at its ends.
LONG = (1 << 63) - 1


class SortedLists:
    """The vectors of a block as one sorted list per dimension; `ranks` is each vector's place in each list."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.whole = ids, vectors
        self.vectors = vectors.astype(np.float64)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.ranks = np.empty_like(order)
        np.put_along_axis(self.ranks, order, np.arange(len(ids))[:, None], axis=0)
        self.values = np.take_along_axis(self.vectors, order, axis=0)
        self.largest = float(np.abs(self.vectors).max(initial=0))

    def top_k(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(vector indexes, scores, entries read) of the query's best k, its own id left out."""
        return self.top_k_of([own], query[None], k)[0]

    def top_k_of(self, own: list[int], queries: np.ndarray, k: int, least: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """`top_k` of each query, of vectors that score at least `least` where it is told.

        All queries read their lists in the same steps: the entries that a step adds are those between two ranks, and
        what they add to all scores and bounds is a product of matrices.
        """
        n, width = self.whole.shape
        lists = np.count_nonzero(queries, axis=1)
        largest = self.largest * np.abs(queries.astype(np.float64)).max(axis=1, initial=0) * max(1, width)
        out: list = [None] * len(queries)
        for q in np.flatnonzero(largest >= EXACT):
            # such weights have no exact bounds in floats: whole lists, whole numbers
            out[q] = *_best(self.whole.astype(object) @ queries[q].astype(object), self.ids, own[q], np.arange(n), k), n * width
        open_ = np.flatnonzero(largest < EXACT)
        kind = np.float32 if largest[open_].max(initial=0) < EXACT_SHORT else np.float64
        weight, vectors, values = queries[open_].astype(kind), self.vectors.astype(kind), self.values.astype(kind)
        top, bottom = np.maximum(weight, 0.0), np.minimum(weight, 0.0)
        mine = np.array([own[q] for q in open_], np.int64)[:, None] == self.ids
        score, left, read = np.zeros((len(open_), n), kind), ~mine, 0
        # scores are exact here, a bound beyond them is one that none or all reach
        told = [None if least is None else least[q] for q in open_]
        floor = np.array([-np.inf if b is None else min(max(b, -EXACT), EXACT) for b in told]).astype(kind)
        for share in STEPS:
            if not len(open_):
                break
            upto = max(read, min(n, int(np.ceil(share * n))))
            if upto > read:
                fresh_top = (self.ranks >= n - upto) & (self.ranks < n - read)
                fresh_bottom = (self.ranks >= read) & (self.ranks < upto)
                score += top @ (vectors * fresh_top).T
                score += bottom @ (vectors * fresh_bottom).T
                read = upto
            done = left.sum(axis=1) <= RESOLVE * k
            if read == n:
                done[:] = True
            elif not done.all():
                unread_top, unread_bottom = (self.ranks < n - read).astype(kind).T, (self.ranks >= read).astype(kind).T
                upper = (top * values[n - read]) @ unread_top
                upper += (bottom * values[read - 1]) @ unread_bottom
                upper += score
                bar = floor
                if n > k and not np.isfinite(floor).all():
                    lower = (top * values[0]) @ unread_top
                    lower += (bottom * values[-1]) @ unread_bottom
                    lower += score
                    lower[~left] = -np.inf
                    bar = np.maximum(floor, np.partition(lower, n - k, axis=1)[:, n - k])
                # those done have fewer than k times RESOLVE left and stay as they are
                left &= (upper >= bar[:, None]) | done[:, None]
                done = left.sum(axis=1) <= RESOLVE * k
            for j in np.flatnonzero(done):
                q, at = open_[j], np.flatnonzero(left[j])
                found = score[j, at] if read == n else vectors[at] @ weight[j]
                out[q] = *_best(found, self.ids, own[q], at, k), read * int(lists[q])
            keep = ~done
            open_, weight, top, bottom = open_[keep], weight[keep], top[keep], bottom[keep]
            score, left, floor = score[keep], left[keep], floor[keep]
        return out


def _best(scores: np.ndarray, ids: np.ndarray, own: int, left: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k of the vectors `left`, of which `scores` are the scores."""
    keep = np.flatnonzero(ids[left] != own)
    if scores.dtype == object:
        order = sorted(keep, key=lambda j: (-scores[j], ids[left[j]]))[:k]
    else:
        order = keep[np.lexsort((ids[left[keep]], -scores[keep]))[:k]]
    return left[order], scores[order]


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "vector",
    vector_block: int = VECTOR_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score, n_read) of the k best for each row where `is_query`; vectors are array<bigint>."""
    usable = vectors.where(
        F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & ~F.exists(vector_column, lambda x: x.isNull())
    ).select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("v"), is_query.alias("q"))
    rows = usable.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")).withColumn("width", F.size("v"))
    rows = stage_table(rows, "vectors")
    sizes = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    n_blocks, n_parts = pieces_for(sizes[0], vector_block), pieces_for(sizes[1], query_block)

    def pack(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        flat = table.column("v").combine_chunks()
        flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
        kind, cells = packed(flat.to_numpy(zero_copy_only=False))
        ids = table.column("id").to_numpy().astype("<i8").tobytes()
        return pa.table({"block": table.column("block")[:1], "width": pa.array([width], pa.int32()), "ids": pa.array([ids], pa.binary()), "kind": [kind], "cells": pa.array([cells], pa.binary())})

    def packs(df: DataFrame, n: int, seed: int) -> DataFrame:
        dealt = df.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("bigint"))
        return dealt.groupBy("block", "width").applyInArrow(pack, "block bigint, width int, ids binary, kind string, cells binary")

    blocks = packs(rows.select("id", "v", "width"), n_blocks, 0)
    parts = packs(rows.where("q").select("id", "v", "width"), n_parts, 1)
    # fewer blocks meet in a group where there are few: every core should have groups
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    down, across = max(pieces_for(n_blocks, SIDE), min(n_blocks, 4 * cores)), pieces_for(n_parts, SIDE)

    def squares(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    blocks = blocks.withColumn("down", F.pmod("block", F.lit(down))).withColumn("across", squares(across))
    parts = parts.withColumn("across", F.pmod("block", F.lit(across))).withColumn("down", squares(down))
    square = ["down", "across", "width"]

    def search(blocks: pa.Table, parts: pa.Table) -> pa.Table:
        given = [(np.frombuffer(r["ids"], "<i8"), r["kind"], r["cells"]) for r in parts.select(["ids", "kind", "cells"]).to_pylist()]
        best: dict[int, list[tuple[int, int]]] = {int(q): [] for ids, _, _ in given for q in ids}
        reads = dict.fromkeys(best, 0)
        for r in blocks.select(["ids", "kind", "cells"]).to_pylist() if given else []:
            ids = np.frombuffer(r["ids"], "<i8")
            lists = SortedLists(ids, unpacked(r["kind"], r["cells"], len(ids)))
            for query_ids, kind, cells in given:
                queries = unpacked(kind, cells, len(query_ids))
                for at in range(0, len(queries), TOGETHER):
                    owns = query_ids[at : at + TOGETHER].tolist()
                    least = [-best[own][-1][0] if len(best[own]) == k else None for own in owns]
                    for own, (found, scores, read) in zip(owns, lists.top_k_of(owns, queries[at : at + TOGETHER], k, least), strict=True):
                        reads[own] += read
                        best[own] = sorted([*best[own], *((-min(max(int(s), -LONG - 1), LONG), int(i)) for s, i in zip(scores, lists.ids[found], strict=True))])[:k]
        rows = [(q, i, -s, reads[q]) for q, kept in best.items() for s, i in kept]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score", "n_read"), zip(*rows) if rows else ((),) * 4, strict=True)})

    grouped = blocks.drop("block").groupBy(*square).cogroup(parts.drop("block").groupBy(*square))
    best = grouped.applyInArrow(search, "query_id bigint, vec_id bigint, score bigint, n_read bigint")
    of_block = F.pmod(F.xxhash64("vec_id", F.lit(0)), F.lit(n_blocks))
    best = cut_lineage(best.withColumn("down", F.pmod(of_block, F.lit(down))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # a group tells a query what it has read with each of its rows
    read = best.groupBy("query_id", "down").agg(F.max("n_read").alias("n")).groupBy("query_id").agg(F.sum("n").alias("n_read"))
    return ranked.drop("n_read").join(read, "query_id").select("query_id", "rank", "vec_id", "score", "n_read")


def scaled(embedding: Column, factor: int = 256) -> Column:
    """Components as whole numbers; null where the vector holds a null or a number that is not finite."""
    finite = ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * factor).cast("bigint")))


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    vectors = embeddings.select("vec_id", scaled(F.col("embedding")).alias("vector"))
    return exact_top_k(vectors, F.col("vec_id") % every == 0, k).select("query_id", "rank", "vec_id", "score")
