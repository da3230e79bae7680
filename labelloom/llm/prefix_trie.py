"""Prefix trie of conversations by van Emde Boas recursion over the depth.

A trie of depth 2^k is cut at half its depth: the conversations' prefixes at the cut are named, and the
upper trie and the forest of lower tries (one below each named prefix) are the same task at half the depth.
The recursion runs level by level with all its parts at once: a row is one conversation in one part, it
holds the name of the prefix above the part, and each level turns it into a row of the upper and, if the
conversation is long enough, a row of the lower part. A prefix is named by the prefix above and the block
of turns between them; names of blocks are made of pairs of names of half the length beforehand. Level k
has a 2^k-th of the turns as rows, so all levels together have at most twice as many rows as there are
turns; keys are (conversation, part), so one long conversation is spread like many short ones.

Totals of subtrees are grafted upwards over the same parts. A node belongs to its smallest member, hence a
conversation owns the lower end of its path, and the tries of all conversations' own ends are disjoint. The
total of a lower part is grafted on every row of the upper part, level by level; what a node's members have
at and below it then adds up to the total of its subtree.

Names are 128-bit digests of the turns and of pairs of names; their equality stands for equality of turns.

Defined results: null roles and texts are empty; rows without a conversation id take no part; turns sort by
number (null first), equal ones by the digest of role and text, so repeated rows are turns of their own; a
conversation without rebuilt turns ends in the root; an empty table has no nodes. Texts of any length stay
in the scan: only their digest and word count are shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import cut_lineage
from labelloom.operators.ordering import running_aggregates

#: Every conversation shares up to `shared(c)` first turns of the one at the head of its block of this many ids.
BLOCK = 20
#: Conversations whose ids are joined to one piece of a node's list of ends, as a power of two.
PIECE_BITS = 12
WORD, NOT_WORD = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def named(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(c, i, name, words): the i-th turn of every conversation, from 1. No conversation is sorted in one task."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    name = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    words = F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), NOT_WORD, "")).cast("bigint")
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("c"), F.col("turn").cast("bigint").alias("turn"), name.alias("name"), words.alias("words"), F.lit(1).alias("one")
    )
    numbered = running_aggregates(turns, ["c"], ["turn", "name"], {"i": ("sum", "one")}, totals={"size": ("sum", "one")})
    return numbered.select("c", F.col("i").cast("bigint").alias("i"), "name", "words", F.col("size").cast("bigint").alias("size"))


def shared_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (c, size) of each, and their turns (c, j, name, words, size), j from 0.

    A conversation takes the first h turns of the head of its block, then its own ones after its first h.
    """
    c, head = F.col("c"), F.col("c") - F.col("c") % BLOCK
    h = F.crc32(c.cast("string").cast("binary")) % 4
    firsts = turns.where((c % BLOCK == 0) & (F.col("i") <= 3))
    heads = firsts.groupBy(F.col("c").alias("head")).agg(F.count(F.lit(1)).alias("n"))
    one = turns.groupBy("c").agg(F.max("size").alias("own")).withColumns({"head": head, "h": h})
    one = one.join(heads, "head", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0))))
    one = one.withColumn("size", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    one = cut_lineage(one.select("c", "head", "h", "taken", "size"))
    above = one.join(firsts.select(F.col("c").alias("head"), "i", "name", "words"), "head").where("i <= h")
    below = turns.drop("size").join(one, "c").where("i > h")
    rows = above.select("c", (F.col("i") - 1).alias("j"), "name", "words", "size").unionByName(
        below.select("c", (F.col("taken") + F.col("i") - F.col("h") - 1).alias("j"), "name", "words", "size")
    )
    return one.select("c", "size"), cut_lineage(rows)


def _pairs(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Two neighbouring blocks as one: `{out: (which, column)}` with the value of the left or right block."""
    side = {"left": F.col("j") % 2 == 0, "right": F.col("j") % 2 == 1}
    picked = [F.max(F.when(side[which], F.col(c))).alias(out) for out, (which, c) in columns.items()]
    return df.groupBy("c", F.shiftright("j", 1).alias("half")).agg(*picked).withColumnRenamed("half", "j")


def node_rows(sizes: DataFrame, rows: DataFrame, levels: int) -> DataFrame:
    """(c, d, node, size, words): the node of every conversation at every depth d, and the words of the turn that follows."""
    blocks = [rows.select("c", "j", "name")]
    for _ in range(1, levels):
        both = _pairs(blocks[-1], a=("left", "name"), b=("right", "name")).where("a is not null and b is not null")
        blocks.append(cut_lineage(both.select("c", "j", named(F.col("a"), F.col("b")).alias("name"))))
    part = sizes.select("c", F.lit(0).cast("bigint").alias("j"), named(F.lit("root")).alias("node"), "size")
    for level in range(levels - 1, -1, -1):
        # cut: the upper part keeps the name above it, the lower part gets the name of the prefix at the cut
        upper = part.withColumn("j", F.col("j") * 2)
        longer = upper.where(F.col("size") >= (F.col("j") + 1) * (1 << level))
        lower = longer.join(blocks[level], ["c", "j"]).select("c", (F.col("j") + 1).alias("j"), named(F.col("node"), F.col("name")).alias("node"), "size")
        part = cut_lineage(upper.select("c", "j", "node", "size").unionByName(lower))
    return cut_lineage(part.join(rows.select("c", "j", "words"), ["c", "j"], "left").withColumnRenamed("j", "d"))


def grafted(own: DataFrame, sizes: DataFrame, levels: int, *columns: str) -> DataFrame:
    """(c, d, columns...): the sums of the own values (c, d, columns...) of a conversation at depth d and below it."""
    none = F.lit(0).cast("bigint")
    sums = [own.select("c", F.col("d").alias("j"), *columns)]
    for _ in range(1, levels):
        halves = sums[-1].groupBy("c", F.shiftright("j", 1).alias("half")).agg(*[F.sum(x).alias(x) for x in columns])
        sums.append(cut_lineage(halves.withColumnRenamed("half", "j")))
    part = sizes.select("c", none.alias("j"), "size", *[none.alias(x) for x in columns])
    for level in range(levels - 1, -1, -1):
        lower = part.withColumn("j", F.col("j") * 2 + 1).where(F.col("size") >= F.col("j") * (1 << level))
        under = sums[level].where("j % 2 = 1").select("c", (F.col("j") - 1).alias("j"), *[F.col(x).alias(f"under_{x}") for x in columns])
        upper = part.withColumn("j", F.col("j") * 2).join(under, ["c", "j"], "left")
        upper = upper.select("c", "j", "size", *[(F.col(x) + F.coalesce(f"under_{x}", none)).alias(x) for x in columns])
        part = cut_lineage(upper.unionByName(lower))
    here = own.select("c", "d", *[F.col(x).alias(f"own_{x}") for x in columns])
    part = part.withColumnRenamed("j", "d").join(here, ["c", "d"], "left")
    return part.select("c", "d", *[(F.col(x) + F.coalesce(f"own_{x}", none)).alias(x) for x in columns])


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes (node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) and the ends (node, c)."""
    sizes, rows = shared_turns(ordered_turns(conversations))
    levels = max(1, int(sizes.agg(F.max("size")).first()[0] or 0).bit_length())
    at = node_rows(sizes, rows, levels)
    nodes = cut_lineage(at.groupBy("node").agg(F.min("c").alias("conv_id"), F.min("d").alias("depth"), F.count(F.lit(1)).alias("n_convs")))
    # the node above and the last turn, from the row of the smallest member
    step = at.select(F.col("c").alias("conv_id"), (F.col("d") + 1).alias("depth"), F.col("node").alias("above"), "words")
    nodes = cut_lineage(nodes.join(step, ["conv_id", "depth"], "left"))
    children = nodes.where("above is not null").groupBy(F.col("above").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    none = F.lit(0).cast("bigint")
    saved = (F.col("n_convs") - 1) * F.coalesce("words", none)
    nodes = cut_lineage(nodes.join(children, "node", "left").select("node", "above", "conv_id", "depth", "n_convs", F.coalesce("n_children", none).alias("n_children"), saved.alias("saved")))

    # every node is in the path of its smallest member, and there from some depth on
    own = nodes.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("saved").alias("saved_tokens"), (F.col("n_children") == 0).cast("bigint").alias("n_leaves"))
    below = grafted(own, sizes, levels, "saved_tokens", "n_leaves")
    subtree = at.select("c", "d", "node").join(below, ["c", "d"]).groupBy("node").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    parents = nodes.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(cut_lineage(subtree), "node").join(parents, "above", "left")
    ends = at.where("d = size").select("node", "c")
    return whole.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes with ends. Ids are joined by ranges; one digest goes over a node's ranges in turn."""
    ranges = ends.groupBy("node", F.shiftright("c", PIECE_BITS).alias("piece")).agg(
        F.array_join(F.array_sort(F.collect_list("c")), ",").alias("ids")  # at most 2^PIECE_BITS ids
    )

    def digest(batches):
        last, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node == last:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((last, state.hexdigest()))
                    last, state = node, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    dealt = ranges.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids")
    return dealt.mapInArrow(digest, "node binary, ends_sha256 string")


def trie_report(conversations: DataFrame) -> DataFrame:
    nodes, ends = trie(conversations)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(end_digests(ends), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
