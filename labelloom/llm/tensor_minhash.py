"""Near copies by MinHash with tensored banding.

Table keys are pairs: two small collections of `SIDE` parts each, a part being `ROWS` minhashes, give
SIDE^2 keys of 2 * ROWS minhashes from 2 * SIDE * ROWS minhashes instead of 2 * ROWS * SIDE^2 (84 instead of
1,176). Two sets with Jaccard similarity s share a key unless one of the collections has no common part:
they are missed with probability 1 - (1 - (1 - s^ROWS)^SIDE)^2, which is 9e-5 at s = 0.8, 3e-6 at 0.85 and
2e-8 at 0.9. Every pair that shares a key is a candidate, without any cap, and links are confirmed on full sets.

Texts are read once for the keys and once for each confirmation. A slice of rows is one packed row with its
parts, so keys are made where they are needed and a slice's copies meet before the shuffle: only one of
the sets of a slice that share a key travels, to a slab of keys, the others are paired with it on the spot.
A key that a third of all documents share has one entry a slice.

Families of near copies would give a pair for each two members. The first confirmation therefore takes one
partner for every set (the one that shares most keys, of the smallest hash in each table), then the other such
partners in different components. The second pairs the sets of a key that is still in several components with
the set among them that shares most keys with others: the text that copies were made from, which is nearer to each
than they are to each other. The third takes all pairs of sets with a common key that are then still in different
components; they are made and tested inside tasks, and only those that pass the bounds below become rows. Before a set is read again, pairs must pass bounds from their sizes and from parities of their
shingles in 2,048 cells, which no link fails and few pairs below the threshold pass, and agree in half of their
minhashes (a byte of each), which a link at s = 0.8 fails with probability below 1e-8, less than the tables miss.

Shingles and sets are 64-bit hashes, keys 32 bits within a slab; keys that are equal by chance only add candidates.

Defined results: null and empty texts (no words) have no shingles and link with nothing; fewer words than
`n` are one shingle; rows of equal texts, repeated or not, are in one component; rows without an id have no
say in a component's id, which is null where no row has one. `kept` marks the row of the component's id
(and its repetitions).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import connected_components, cut_lineage, forget, map_slices, pieces_for, slices, text_batches
from labelloom.llm.ngram_join import ngram_set, node_of
from labelloom.session import broadcast_if_small, stage_table

#: Parts of each of the two collections, and minhashes of a part.
SIDE, ROWS = 14, 3
#: Rows of a packed slice, key entries of a slab on average, words of a parity signature.
SLICE, SLAB, SIGNATURE = 2_048, 1 << 21, 32
#: Words of a parity signature that are looked at before the whole one.
FOLDED = 8
#: Third round: sets of a key that meet whole, entries of a slab on average, sets of a small cell, pairs compared at a time.
BLOCK, OPEN_SLAB, FEW, PAIRS = 2_048, 1 << 15, 24, 1 << 14
#: Words of a sketch, and how far below the threshold, in percent, the share of equal minhashes may be.
SKETCH, SLACK = 2 * SIDE * ROWS // 7, 30
_SIGNS = "".join(f", s{k} bigint" for k in range(SIGNATURE)) + "".join(f", m{k} bigint" for k in range(SKETCH))
SIGNS = [*(f"s{k}" for k in range(SIGNATURE)), *(f"m{k}" for k in range(SKETCH))]
_PAIRS = "a bigint, b bigint, votes bigint, key bigint"


@functools.cache
def _hashing() -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of the minhashes, drawn once from a fixed seed."""
    rng = np.random.default_rng(20)
    draw = lambda: rng.integers(0, 2**64, 2 * SIDE * ROWS, np.uint64)
    return draw(), draw() | np.uint64(1)


def minhashes(grams: np.ndarray) -> np.ndarray:
    """The 2 * SIDE * ROWS minhashes of a set. Long sets are taken in pieces."""
    masks, factors = _hashing()
    least = np.full(len(masks), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), 4_096):
        piece = grams[start : start + 4_096, None]
        np.minimum(least, ((piece ^ masks) * factors).min(axis=0), out=least)
    return least


def parts_of(least: np.ndarray) -> np.ndarray:
    """The 2 * SIDE parts of a set: each the mix of ROWS minhashes."""
    out = np.zeros(2 * SIDE, np.uint64)
    for row in least.reshape(2 * SIDE, ROWS).T:
        out = _mixed(out + row)
    return out


def sketch_of(least: np.ndarray) -> np.ndarray:
    """A byte of each minhash, seven to a bigint, so that sums of bytes do not overflow."""
    return ((_mixed(least) >> np.uint64(56)).reshape(SKETCH, 7) << (np.uint64(8) * np.arange(7, dtype=np.uint64))).sum(axis=1).view("<i8")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)


def table_keys(parts: np.ndarray) -> np.ndarray:
    """Keys (rows by SIDE^2) of all tables: every part of one collection with every part of the other."""
    left, right = parts[:, :SIDE, None], parts[:, None, SIDE:]
    number = np.arange(SIDE * SIDE, dtype=np.uint64).reshape(SIDE, SIDE)
    return _mixed(_mixed(left + number) ^ right).reshape(len(parts), SIDE * SIDE)


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """One row a document (id, n, node, parity signature) and one row a slice (nodes, parts), staged."""

    def sign(batches):
        forget()
        nothing = np.zeros(SKETCH, "<i8")
        for piece in slices(batches, rows=SLICE):
            sizes, nodes, signs, parts, held = [], [], [], [], {}
            for text in piece.column(1).to_pylist():
                grams = ngram_set(text, n)
                sizes.append(len(grams))
                nodes.append(node_of(grams) if len(grams) else None)
                parity = (np.bincount((grams & np.uint64(64 * SIGNATURE - 1)).astype(np.int64), minlength=64 * SIGNATURE) & 1).astype(np.uint8)
                if len(grams) and nodes[-1] not in held:
                    least = minhashes(grams)
                    held[nodes[-1]] = sketch_of(least)
                    parts.append(parts_of(least))
                signs.append(np.concatenate([np.packbits(parity).view("<i8"), held.get(nodes[-1], nothing)]))
            rows = piece.num_rows
            signed = np.array(signs).reshape(rows, SIGNATURE + SKETCH)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([False] * rows),
                    piece.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    *(pa.array(signed[:, k]) for k in range(SIGNATURE + SKETCH)),
                    pa.nulls(rows, pa.binary()),
                    pa.nulls(rows, pa.binary()),
                ],
                names=names,
            )
            if held:
                packed = [np.array(list(held), "<i8").tobytes(), np.array(parts, "<u8").tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([True]), *(pa.nulls(1, pa.int64()) for _ in range(3 + SIGNATURE + SKETCH)), *(pa.array([p], pa.binary()) for p in packed)], names=names
                )

    names = ["slice", "id", "n", "node", *SIGNS, "nodes", "parts"]
    return stage_table(text_batches(docs).mapInArrow(sign, f"slice boolean, id bigint, n bigint, node bigint{_SIGNS}, nodes binary, parts binary"), "minhash-parts")


def _runs(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by (key, node), without repetitions; the start of each one's run and whether others share it."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[fresh], nodes[fresh]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(first)
    sizes = np.diff(starts, append=len(keys))
    return keys, nodes, np.repeat(starts, sizes), np.repeat(sizes, sizes) > 1


def _links(keys, nodes, start, shared) -> pa.RecordBatch:
    """Pairs (a, its partner b, keys in common) of the runs, and the shared entries (a, key) for the second round."""
    leader = nodes[start]
    other = leader != nodes
    pairs, votes = np.unique(np.stack([nodes[other], leader[other]], axis=1), axis=0, return_counts=True)
    held, at = nodes[shared], keys[shared].view("<i8")
    blank = len(held)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([pairs[:, 0], held])),
            pa.array(np.concatenate([pairs[:, 1], held]), mask=np.arange(len(pairs) + blank) >= len(pairs)),
            pa.array(np.concatenate([votes, np.zeros(blank, np.int64)])),
            pa.array(np.concatenate([np.zeros(len(pairs), np.int64), at]), mask=np.arange(len(pairs) + blank) < len(pairs)),
        ],
        names=["a", "b", "votes", "key"],
    )


def _slice_entries(nodes: bytes, parts: bytes, slabs: int):
    """Entries of a slice as `_runs` gives them; a key is the number of its slab over 32 bits."""
    nodes = np.frombuffer(nodes, "<i8")
    keys = table_keys(np.frombuffer(parts, "<u8").reshape(len(nodes), 2 * SIDE)).ravel()
    keys = (keys >> np.uint64(32)) % np.uint64(slabs) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)
    return _runs(keys, np.repeat(nodes, SIDE * SIDE))


def _matches(packed: DataFrame, slabs: int) -> DataFrame:
    """Pairs and shared entries of all tables (see `_links`), staged."""

    def inside(batches):
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _links(*_slice_entries(*row, slabs))

    def deal(batches):
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, nodes, start, _ = _slice_entries(*row, slabs)
                one = start == np.arange(len(keys))  # the smallest node of each key in the slice
                keys, nodes = keys[one], nodes[one]
                slab, keys = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
                starts = np.flatnonzero(np.diff(slab, prepend=-1))
                cuts = list(zip(starts, [*starts[1:], len(slab)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slab[starts]),
                        pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()),
                        pa.array([nodes[a:b].tobytes() for a, b in cuts], pa.binary()),
                    ],
                    names=["slab", "keys", "nodes"],
                )

    def meet(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), "<u4").astype(np.uint64)
        nodes = np.frombuffer(b"".join(table.column("nodes").to_pylist()), "<i8")
        slab = np.uint64(table.column("slab")[0].as_py())
        keys, nodes, start, shared = _runs(keys | (slab << np.uint64(32)), nodes)
        return pa.Table.from_batches([_links(keys, nodes, start, shared)])

    dealt = packed.mapInArrow(deal, "slab bigint, keys binary, nodes binary")
    across = dealt.groupBy("slab").applyInArrow(meet, _PAIRS)
    return stage_table(packed.mapInArrow(inside, _PAIRS).unionByName(across), "minhash-matches")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Bounds of the sizes and of the parity signatures that every link satisfies, and enough equal minhashes."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    other = lambda name: F.col(f"{a}.{name}").bitwiseXOR(F.col(f"{b}.{name}"))
    differ = sum((F.bit_count(other(f"s{k}")) for k in range(SIGNATURE)), F.lit(0))
    # the top bit of each byte is set where the byte is not 0
    low, high = F.lit(0x7F7F7F7F7F7F7F), F.lit(0x80808080808080)
    unequal = sum((F.bit_count((other(f"m{k}").bitwiseAND(low) + low).bitwiseOR(other(f"m{k}")).bitwiseAND(high)) for k in range(SKETCH)), F.lit(0))
    # each differing bit needs a shingle that only one set has, and a link leaves room for this share of both
    sizes = (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent) & (differ * (100 + percent) <= (n_a + n_b) * (100 - percent))
    return sizes & (unequal * 100 <= 7 * SKETCH * (100 - percent + SLACK))


def _confirmed(pairs: DataFrame, nodes: DataFrame, named: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, on their full sets.

    One text of each set is read again. The sets of `a` go to those of `b`, of which there are fewer; ids only
    choose the texts, sets are told apart by their own hash.
    """
    pairs = cut_lineage(pairs.select("a", "b"))
    if not pairs.limit(1).count():
        return pairs

    def make():
        forget()

        def apply(batch):
            found = [g for g in (ngram_set(t, n) for t in batch.column(0).to_pylist()) if len(g)]
            return [[node_of(g) for g in found], [g.tobytes() for g in found]]

        return apply

    def sets(side: str, grams: str) -> DataFrame:
        ids = nodes.join(pairs.select(F.col(side).alias("node")).distinct(), "node").select(F.col("id").alias("rep")).distinct()
        texts = named.join(broadcast_if_small(ids), F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("text")
        return map_slices(texts, make, f"{side} bigint, {grams} binary")

    one = sets("a", "one").join(broadcast_if_small(pairs), "a")
    wanted = pairs.select("b").distinct()
    two = sets("b", "two").join(broadcast_if_small(wanted), "b", "left_semi")
    both = one.join(two, "b").select("a", "b", "one", "two")

    def check():
        def apply(batch):
            good = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common * 100 >= percent * (len(x) + len(y) - common):
                    good.append((a, b))
            return [[g[0] for g in good], [g[1] for g in good]]

        return apply

    return cut_lineage(map_slices(both, check, "a bigint, b bigint").distinct())


def near_copies(docs: DataFrame, n: int = 2, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_shingles, node (of its set), component_id (smallest id that links reach) and `kept`."""
    named = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    signed = _signed(named, n)
    rows = signed.where("not slice").drop("slice", "nodes", "parts")
    packed = signed.where("slice").select("nodes", "parts")
    entries = packed.agg(F.coalesce(F.sum(F.octet_length("nodes")), F.lit(0))).first()[0] // 8 * SIDE * SIDE
    matches = _matches(packed, pieces_for(entries, SLAB))
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", *SIGNS)])
    nodes = stage_table(nodes, "minhash-nodes")

    # first round: for every set the partner it shares most keys with, then the other ones of its keys
    votes = matches.where("b is not null").groupBy("a", "b").agg(F.sum("votes").alias("votes"))
    facts = nodes.select("node", "n", *SIGNS)
    partners = votes.join(facts.withColumnRenamed("node", "a").alias("x"), "a").join(facts.withColumnRenamed("node", "b").alias("y"), "b")
    partners = cut_lineage(partners.where(_may_link("x", "y", percent)).select("a", "b", "votes"))
    best = partners.groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b"))
    links = _confirmed(best, nodes, named, n, percent)
    reached = cut_lineage(connected_components(links, "a", "b"))
    rest = _apart(partners, reached).join(best, ["a", "b"], "left_anti")
    links = links.unionByName(_confirmed(rest, nodes, named, n, percent))
    reached = cut_lineage(connected_components(links, "a", "b"))

    # second round: the sets of keys that are still in several components with the set of the key that shares most keys
    entries = matches.where("key is not null").select("key", F.col("a").alias("node"))
    weights = cut_lineage(entries.groupBy("node").agg(F.count(F.lit(1)).alias("weight")))
    open_ = stage_table(_open_entries(entries, reached).distinct(), "minhash-open")
    leads = open_.join(broadcast_if_small(weights), "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("b"))
    star = open_.join(leads, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    star = _apart(star, reached).join(partners, ["a", "b"], "left_anti")
    star = star.join(facts.withColumnRenamed("node", "a").alias("x"), "a").join(facts.withColumnRenamed("node", "b").alias("y"), "b")
    tried = cut_lineage(star.where(_may_link("x", "y", percent)).select("a", "b"))
    links = links.unionByName(_confirmed(tried, nodes, named, n, percent))
    reached = cut_lineage(connected_components(links, "a", "b"))

    # third round: all sets with a common key that are still in different components
    crossing = _crossing(_open_entries(open_.drop("component"), reached), facts, percent)
    tried = partners.select("a", "b").union(tried)
    crossing = crossing.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    links = links.unionByName(_confirmed(crossing, nodes, named, n, percent))
    final = cut_lineage(connected_components(links, "a", "b"))

    keyed = rows.select("id", "n", "node").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = cut_lineage(keyed.where("n > 0").groupBy("component").agg(F.min("id").alias("least")))
    whole = keyed.join(least, "component", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")))
    return whole.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "node", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _open_entries(entries: DataFrame, reached: DataFrame) -> DataFrame:
    """(key, node, component) of the keys whose sets are in several components."""
    placed = entries.join(broadcast_if_small(reached), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return placed.join(broadcast_if_small(mixed), "key", "left_semi").select("key", "node", "component")


def _crossing(entries: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a common key in different components that may link, of entries (key, node, component).

    Keys are dealt to slabs, and a set meets a slab once, with its signature and the cells it has there: a cell is a key, or
    for a key of more than `BLOCK` sets two of its blocks. Pairs are made and tested inside the tasks, so
    only those that pass all bounds become rows, one for each slab at most.
    """
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = sizes.agg(F.coalesce(F.sum(F.col("n") * blocks), F.lit(0))).first()[0]
    hot = broadcast_if_small(sizes.where(F.col("n") > BLOCK).select("key", blocks.cast("bigint").alias("blocks")))
    cut = entries.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2)
    # the number of the cell over two bits for the set's side: 0 where the two blocks are one
    cut = cut.withColumn("cell", F.shiftleft(F.xxhash64("key", low, high), 2).bitwiseOR(side.cast("bigint")))
    slab = F.pmod(F.shiftright("cell", 2), F.lit(pieces_for(dealt, OPEN_SLAB)))
    met = cut.select(slab.alias("slab"), "node", "component", "cell").groupBy("slab", "node", "component").agg(F.collect_list("cell").alias("cells"))
    met = stage_table(met, "minhash-open").join(facts.select("node", "n", *SIGNS), "node")

    def meet(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).combine_chunks().to_numpy()
        cells = table.column("cells").combine_chunks()
        rows = np.repeat(np.arange(table.num_rows), np.diff(cells.offsets.to_numpy()))
        signs = np.stack([column(s) for s in SIGNS], axis=1).view(np.uint64)
        found = _near_pairs(cells.flatten().to_numpy(), rows, column("node"), column("component"), column("n"), signs, percent)
        return pa.table({"a": column("node")[found[:, 0]], "b": column("node")[found[:, 1]]})

    return met.groupBy("slab").applyInArrow(meet, "a bigint, b bigint").distinct()


def _near_pairs(cells, rows, node, component, n, signs, percent: int) -> np.ndarray:
    """Rows (i, j), node i below node j, that share a cell, are in different components and pass the bounds of `_may_link`.

    Parities of cells that are added up differ in no more cells than before: signatures folded to `FOLDED` words are looked at first.
    """
    folded = np.bitwise_xor.reduce(signs[:, :SIGNATURE].reshape(len(signs), SIGNATURE // FOLDED, FOLDED), axis=1)
    found = [np.empty((0, 2), np.int64)]

    def keep(i, j, apart):
        apart = apart & (component[i] != component[j]) & (n[i] * 100 >= n[j] * percent) & (n[j] * 100 >= n[i] * percent)
        i, j = i[apart], j[apart]
        for start in range(0, len(i), PAIRS):
            x, y = i[start : start + PAIRS], j[start : start + PAIRS]
            room = (n[x] + n[y]) * (100 - percent)
            for words in (folded, signs[:, :SIGNATURE]):
                near = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) * (100 + percent) <= room
                x, y, room = x[near], y[near], room[near]
            bytes_ = (signs[x, SIGNATURE:] ^ signs[y, SIGNATURE:]).view(np.uint8)
            near = np.count_nonzero(bytes_, axis=1) * 100 <= 7 * SKETCH * (100 - percent + SLACK)
            x, y = x[near], y[near]
            swap = node[x] > node[y]
            found.append(np.unique(np.stack([np.where(swap, y, x), np.where(swap, x, y)], axis=1), axis=0))

    order = np.lexsort((component[rows], cells >> 2))
    cells, rows = cells[order], rows[order]
    side, cells = cells & 3, cells >> 2
    starts = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1))
    sizes = np.diff(starts, append=len(cells))
    # small cells side by side: every entry with the one `step` places on
    few = np.flatnonzero(np.repeat(sizes, sizes) <= FEW)
    for step in range(1, min(FEW, len(few))):
        i, j = few[:-step], few[step:]
        keep(rows[i], rows[j], (cells[i] == cells[j]) & ((side[i] == 0) | (side[i] != side[j])))
    for start, size in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
        at, here = rows[start : start + size], side[start : start + size]
        # those of the largest component meet the others, never each other
        _, code, many = np.unique(component[at], return_inverse=True, return_counts=True)
        major = code == many.argmax()
        minor = np.flatnonzero(~major)
        step = max(1, 16 * PAIRS // size)
        for first in range(0, len(minor), step):
            i, j = (g.ravel() for g in np.meshgrid(minor[first : first + step], np.arange(size), indexing="ij"))
            keep(at[i], at[j], (major[j] | (i < j)) & ((here[i] == 0) | (here[i] != here[j])))
    return np.unique(np.concatenate(found), axis=0)


def _apart(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    ends = [reached.select(F.col("node").alias(c), F.col("component").alias(f"at_{c}")) for c in ("a", "b")]
    placed = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
    return placed.where(F.coalesce("at_a", "a") != F.coalesce("at_b", "b")).select("a", "b")


def near_duplicates(documents: DataFrame) -> DataFrame:
    return near_copies(documents).select("doc_id", "n_shingles", "component_id", "kept")
