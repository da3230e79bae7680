"""Jaccard self-join of word n-gram sets by a grouped prefix join, and its components.

Sets are ordered from rare to frequent n-grams, so two sets that link share one of the first
|A| - ceil(t |A|) + 1 n-grams (the prefix). Texts with one set are one node; nodes with the same prefix
and size are one group. Group pairs come from an equi-join on prefix n-grams and must pass the size
bound, the position bound and, for groups of one node, a bound from 256-bit parity signatures. Pairs
that pass are expanded to their nodes and verified on the whole sets.

Families of near copies would give a pair for each two members. Only components are asked for, so the
join runs twice: first every group is paired with one leader of each shared n-gram (a linear number of
pairs), then only groups that are still in different components are paired, on n-grams whose groups are
not all in one component. No link between different components is lost.

The order needs no exact frequencies, only one order for all: counts of hashed n-grams in a sketch of
2^bits cells, summed over all texts. n-grams are 64-bit hashes, nodes 64-bit hashes of sets.

Defined results: null and empty texts (no words) have no n-grams, link with nothing and are their own
component; fewer words than `n` are one n-gram; rows of equal texts, repeated or not, are one node; the
component of rows without any id is null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import connected_components, cut_lineage, forget, map_slices, slices, text_batches
from labelloom.session import broadcast_if_small, stage_table

#: Signature words of 64 bits, and the bounds of the sketch's size.
SIGNATURE, LEAST_BITS, MOST_BITS = 4, 16, 24
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of ASCII-lower-cased words between ASCII white space."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    codes = np.array([digest(w) for w in words], np.uint64)
    width = min(n, len(codes))
    run = np.full(len(codes) - width + 1, width, np.uint64)
    for k in range(width):
        run = run * _STEP + codes[k : len(codes) - width + 1 + k]
    return np.unique(_mixed(run))


def node_of(grams: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64)))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _sketch(texts: DataFrame, n: int, bits: int) -> np.ndarray:
    """Counts of n-grams by hashed cell over all texts; a task sends its cells in slabs, slabs are summed in tasks."""
    slabs = 1 << max(0, bits - 14)

    def count(batches):
        forget()
        cells = np.zeros(1 << bits, np.int64)
        for piece in slices(batches):
            found = [ngram_set(t, n) for t in piece.column(0).to_pylist()]
            cells += np.bincount((np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        for slab, part in enumerate(np.split(cells.astype("<i4"), slabs)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([slab]), pa.array([part.tobytes()])], names=["slab", "cells"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(part, "<i4").astype(np.int64)
                sums[slab] = sums[slab] + part if slab in sums else part
        for slab, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([slab]), pa.array([np.minimum(part, 2**31 - 1).astype("<i4").tobytes()])], names=["slab", "cells"])

    kinds = "slab bigint, cells binary"
    total = np.zeros((slabs, (1 << bits) // slabs), np.int32)
    # the sketch has a fixed size: at most 4 * 2^MOST_BITS bytes in all
    for row in text_batches(texts).mapInArrow(count, kinds).repartition("slab").mapInArrow(add, kinds).toLocalIterator():
        total[row["slab"]] = np.frombuffer(row["cells"], "<i4")
    return total.ravel()


def _prefixes(docs: DataFrame, n: int, percent: int, cells: np.ndarray, bits: int) -> DataFrame:
    """Per row: id, n (set size), node, its prefix in order, the parity signature and gid, its group."""
    frequency = docs.sparkSession.sparkContext.broadcast(cells)

    def make():
        counts = frequency.value

        def apply(batch):
            sizes, nodes, heads, signs = [], [], [], []
            for text in batch.column(1).to_pylist():
                grams = ngram_set(text, n)
                size = len(grams)
                sizes.append(size)
                nodes.append(node_of(grams) if size else None)
                if size:
                    first = np.lexsort((grams, counts[(grams >> np.uint64(64 - bits)).astype(np.int64)]))[: prefix_size(size, percent)]
                    heads.append(grams[first].view(np.int64))
                else:
                    heads.append(np.empty(0, np.int64))
                parity = (np.bincount((grams & np.uint64(64 * SIGNATURE - 1)).astype(np.int64), minlength=64 * SIGNATURE) & 1).astype(np.uint8)
                signs.append(np.packbits(parity).view("<i8"))
            offsets = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum([len(h) for h in heads], out=offsets[1:])
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads)))
            return [batch.column(0), sizes, pa.array(nodes, pa.int64()), prefix, *np.array(signs).T]

        return apply

    signs = "".join(f", s{k} bigint" for k in range(SIGNATURE))
    rows = map_slices(docs, make, f"id bigint, n bigint, node bigint, prefix array<bigint>{signs}")
    return stage_table(rows.withColumn("gid", F.xxhash64("prefix", "n")), "prefixes")


def _may_link(a: str, b: str, percent: int, signed: bool) -> Column:
    """Size and signature bounds of two rows with columns n and s0.. under the names `a` and `b`."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    size = (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent)
    if not signed:
        return size
    differ = sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(SIGNATURE)), F.lit(0))
    # |A xor B| = |A| + |B| - 2 |A and B|, and (100 + percent) |A and B| >= percent (|A| + |B|) for a link
    fits = differ * (100 + percent) <= (n_a + n_b) * (100 - percent)
    return size & F.coalesce(fits, F.lit(True))  # groups of several nodes have no signature


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The node pairs (x, y) that link, checked on the whole sets of the nodes in question."""
    pairs = cut_lineage(pairs)
    wanted = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()

    def make():
        def apply(batch):
            found = [g for g in (ngram_set(t, n) for t in batch.column(0).to_pylist()) if len(g)]
            return [[node_of(g) for g in found], [g.tobytes() for g in found]]

        return apply

    sets = map_slices(texts, make, "node bigint, grams binary").join(broadcast_if_small(wanted), "node", "left_semi")
    sets = stage_table(sets.groupBy("node").agg(F.any_value("grams").alias("grams")), "gram-sets")
    both = (
        pairs.join(sets.select(F.col("node").alias("x"), F.col("grams").alias("gx")), "x")
        .join(sets.select(F.col("node").alias("y"), F.col("grams").alias("gy")), "y")
        .select("x", "y", "gx", "gy")
    )

    def check():
        def apply(batch):
            good = []
            for x, y, gx, gy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = np.frombuffer(gx, np.uint64), np.frombuffer(gy, np.uint64)
                common = len(np.intersect1d(one, two, assume_unique=True))
                if common * 100 >= percent * (len(one) + len(two) - common):
                    good.append((x, y))
            return [[g[0] for g in good], [g[1] for g in good]]

        return apply

    return cut_lineage(map_slices(both, check, "x bigint, y bigint"))


def similar_components(
    docs: DataFrame, n: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: id, n_shingles, node (of its set) and component_id, the smallest id that links reach."""
    named = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    texts = named.select("text")
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(named.select("id").count() + 1)) + 2))
    rows = _prefixes(named, n, percent, _sketch(texts, n, bits), bits)

    # nodes, and groups of nodes with one prefix and size
    signs = [f"s{k}" for k in range(SIGNATURE)]
    filled = rows.where("n > 0")
    nodes = stage_table(filled.select("node", "gid", "n", *signs).dropDuplicates(["node"]), "nodes")
    leads = nodes.groupBy("gid").agg(
        F.min("node").alias("node"), F.any_value("n").alias("n"), *[F.min_by(s, "node").alias(s) for s in signs], F.count(F.lit(1)).alias("members")
    )
    leads = stage_table(leads, "groups")
    grams = filled.groupBy("gid").agg(F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix")).select(
        "gid", "n", F.posexplode("prefix").alias("pos", "gram")
    )
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1").select("gram")
    postings = stage_table(grams.join(shared, "gram"), "gram-postings")

    # first round: every group with the leaders of its n-grams, every node with the first of its group
    leaders = postings.groupBy("gram").agg(F.min_by("gid", F.xxhash64("gid", "gram")).alias("leader"))
    star = postings.join(leaders, "gram").where("gid <> leader").select("gid", "leader").distinct()
    star = (
        star.join(leads.alias("a"), "gid")
        .join(leads.withColumnRenamed("gid", "leader").alias("b"), "leader")
        .where(_may_link("a", "b", percent, True))
        .select(F.col("a.node").alias("x"), F.col("b.node").alias("y"))
    )
    inside = (
        nodes.alias("a")
        .join(leads.where("members > 1").select("gid", F.col("node").alias("first")).alias("g"), "gid")
        .where("a.node <> first")
        .select(F.col("a.node").alias("x"), F.col("first").alias("y"))
    )
    links = _verified(star.union(inside), texts, n, percent)
    reached = cut_lineage(connected_components(links, "x", "y"))

    # second round: group pairs that are not yet in one component
    placed = stage_table(
        nodes.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed"
    )
    spans = placed.groupBy("gid").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.any_value("n").alias("n"),
        *[F.when(F.count(F.lit(1)) == 1, F.any_value(s)).alias(s) for s in signs],
    )
    open_ = postings.select("gram", "gid", "pos").join(spans, "gid")
    mixed = open_.groupBy("gram").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("gram")
    open_ = stage_table(open_.join(mixed, "gram", "left_semi"), "open-postings")
    a, b = open_.alias("a"), open_.alias("b")
    left = lambda side: F.col(f"{side}.n") - F.col(f"{side}.pos")
    reach = F.least(left("a"), left("b"))  # n-grams that may be common from the first shared one on
    crossing = (
        a.join(
            b,
            (F.col("a.gram") == F.col("b.gram"))
            & (F.col("a.gid") < F.col("b.gid"))
            & ((F.col("a.low") != F.col("b.low")) | (F.col("a.high") != F.col("b.high")) | (F.col("a.low") != F.col("a.high")))
            & (reach * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent)
            & _may_link("a", "b", percent, True),
        )
        .select(F.col("a.gid").alias("ga"), F.col("b.gid").alias("gb"))
        .distinct()
        .union(spans.where("low <> high").select(F.col("gid").alias("ga"), F.col("gid").alias("gb")))
    )
    expanded = (
        crossing.join(placed.withColumnRenamed("gid", "ga").alias("a"), "ga")
        .join(placed.withColumnRenamed("gid", "gb").alias("b"), "gb")
        .where((F.col("a.component") != F.col("b.component")) & _may_link("a", "b", percent, True))
        .select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y"))
        .distinct()
    )
    more = _verified(expanded, texts, n, percent)
    links = links.union(more)
    final = cut_lineage(connected_components(links, "x", "y"))

    keyed = rows.select("id", "n", "node").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # staged, so that the join has two plain shuffles, which adaptive execution splits at a hot component
    least = cut_lineage(keyed.where("n > 0").groupBy("component").agg(F.min("id").alias("least")))
    return keyed.join(least, "component", "left").select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        "node",
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, text_column: str = "text") -> DataFrame:
    """The rows of `docs` without those that a row with a smaller id links to; empty texts stay."""
    found = stage_table(similar_components(docs, n, percent, "doc_id", text_column), "components")
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    again = stays.where("n_shingles > 0").groupBy("doc_id", "node").count().where("count > 1")
    keys = stays.select(F.col("doc_id").alias("__kept")).distinct()
    out = docs.join(broadcast_if_small(keys), F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")
    # rows that repeat an id and its text: one stays; a shuffle of texts only where there are such rows
    if again.limit(1).count():
        full = F.length(F.trim(F.coalesce(text_column, F.lit("")))) > 0
        out = out.where(full).dropDuplicates(["doc_id", text_column]).union(out.where(~full))
    return out


def components(documents: DataFrame) -> DataFrame:
    return similar_components(documents, n=3, percent=90).select("doc_id", "n_shingles", "component_id")
