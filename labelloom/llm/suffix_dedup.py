"""Removal of byte strings that also start in a document with a smaller id, by prefix doubling over samples.

Prefix doubling names the strings at all positions by rank pairs at growing offsets, drops positions whose
name is unique and stops past the threshold. Over every byte of a corpus its first sort alone outweighs
the corpus many times, so the positions are sampled by content: each window of `length` bytes contributes
the position of its smallest `GRAM`-byte hash, its anchor, and equal windows have equal anchors at one
offset. Names are hashes, equality classes instead of ranks; they are brought together by a Spark shuffle
in slabs of names and sorted there.

Round 1 names anchors by their gram. Unique names leave. An anchor's context is what all its windows
cover. If a document with a smaller id has the same name and context, all windows of the anchor repeat
("full"); if only contexts differ, the anchor stays "open". Round 2 doubles for the windows of open anchors:
names of HALF bytes become names of twice as many by the pair at the offset of their width, until a last
pair, at the window's start and at its end less that width, overlaps or touches and so covers the window;
a window whose name also stands in a smaller document repeats. Bytes covered by repeats are removed.

Each task first decides within its slice of the corpus and sends one entry per name (or the entries of
the smallest document), so a hot passage costs a slab one entry for each slice, never one for each copy.

Defined results: null text has no bytes; texts under `length` bytes keep all; rows with equal ids are not
smaller than one another; a null id is larger than all others; repeated rows have equal results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import map_slices, pieces_for, slices, text_batches
from labelloom.session import stage_table

#: Bytes of a gram that is sampled and of the first names that a window's name is doubled from.
GRAM, HALF = 20, 32
#: Bytes of text to a slab of names, slabs at least, and bytes of text that a task decides on at a time.
SLAB_BYTES, LEAST_SLABS, SLICE_BYTES = 24 << 20, 24, 1 << 20
#: Packed bytes of spans up to which they are broadcast to the texts; beyond, both sides are shuffled.
BROADCAST_BYTES = 48 << 20
_FLAG = np.uint32(1 << 31)
_ODD = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(5).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
ENTRY = (
    "slab bigint, key bigint, full binary, open binary, ids binary, keys binary, starts binary, name binary, context binary, "
    "place binary"
)
_NAMES = [c.split()[0] for c in ENTRY.split(", ")]


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """64-bit names of any byte ranges of one slice, from running sums."""

    _powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, data: np.ndarray):
        size = len(data) + 1
        if Hashes._powers is None or len(Hashes._powers[0]) < size:
            up = np.full(size, _ODD, np.uint64)
            down = np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            Hashes._powers = np.cumprod(up), np.cumprod(down)
        up, self.down = (p[:size] for p in Hashes._powers)
        self.sums = np.zeros(size, np.uint64)
        np.cumsum(_CODES[data] * up[:-1], out=self.sums[1:])

    def fixed(self, width: int) -> np.ndarray:
        """The names of all ranges of `width` bytes."""
        n = max(0, len(self.sums) - width)
        return _mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])

    def ranges(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[high] - self.sums[low]) * self.down[low] + (high - low).astype(np.uint64))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts side by side and their starts."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _anchors(data: np.ndarray, starts: np.ndarray, length: int):
    """Window starts that stay in a document, the anchor of each, and the hashes."""
    hashes = Hashes(data)
    windows = len(data) - length + 1
    if windows <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), hashes, None
    grams = hashes.fixed(GRAM)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width, size = length - GRAM + 1, 1
    while size * 2 <= width:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    inside = np.ones(windows, bool)
    for end in starts[1:-1]:
        inside[max(0, end - length + 1) : end] = False
    at = np.flatnonzero(inside)
    return at, (low[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), hashes, grams


def _first(keys: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    cut = np.flatnonzero(_first([keys])).tolist() if len(keys) else []
    return list(zip(cut, [*cut[1:], len(keys)][: len(cut)], strict=True))


def _decide(name: np.ndarray, context: np.ndarray | None, ids: np.ndarray):
    """In the order that is returned: repeats of a smaller id, names with several contexts, and group starts."""
    order = np.lexsort((ids, name) if context is None else (ids, context, name))
    name, ids = name[order], ids[order]
    new_name = _first([name])
    new = new_name if context is None else _first([name, context[order]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    group = np.cumsum(new_name) - 1
    several = np.bincount(group, new, minlength=0)[group] > 1 if len(order) else np.empty(0, bool)
    return order, ids > ids[first], several, new_name


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(columns["slab"])
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * (len(_NAMES) - 2)]
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), k) for c, k in zip(_NAMES, kinds, strict=True)], names=_NAMES)


def _by_document(place: np.ndarray, starts: np.ndarray, keys: np.ndarray):
    """(key, positions in the document as packed int32) for sorted places of a slice."""
    doc = np.searchsorted(starts, place, "right") - 1
    local = (place - starts[doc]).astype("<i4")
    return [(int(keys[doc[a]]), local[a:b].tobytes()) for a, b in _runs(doc)]


def _send(place, name, context, doc, ids, keys, starts, slabs, dealt=None):
    """What a slice decides by itself, one row a document, and its open entries, one row a slab.

    `dealt` are other hashes to choose slabs by: then a slab keeps all 64 bits of its names apart from them.
    """
    order, full, several, new_name = _decide(name, context, ids[doc])
    place_, doc_ = place[order], doc[order]
    open_ = several & ~full
    first_id = ids[doc_][np.flatnonzero(new_name)][np.cumsum(new_name) - 1] if len(order) else ids[:0]
    ship = np.where(several, new_name, ids[doc_] == first_id)
    found: dict[int, list] = {}
    for kind, chosen in ((0, full), (1, open_)):
        for key, packed in _by_document(np.sort(place_[chosen]), starts, keys):
            found.setdefault(key, [None, None])[kind] = packed
    if found:
        yield _rows({"slab": [k % slabs for k in found], "key": list(found), "full": [v[0] for v in found.values()], "open": [v[1] for v in found.values()]})
    picked = order[ship]
    slab = ((name if dealt is None else dealt)[picked] % np.uint64(slabs)).astype(np.int64)
    by_slab = np.argsort(slab, kind="stable")
    picked, slab, flags = picked[by_slab], slab[by_slab], several[ship][by_slab]
    columns: dict[str, list] = {c: [] for c in _NAMES if c not in ("key", "full", "open")}
    for a, b in _runs(slab):
        some = picked[a:b]
        docs = np.unique(doc[some])
        columns["slab"].append(int(slab[a]))
        columns["ids"].append(ids[docs].tobytes())
        columns["keys"].append(keys[docs].tobytes())
        columns["starts"].append(starts[docs].astype("<u4").tobytes())
        codes = name[some] if dealt is not None else name[some] // np.uint64(slabs)
        columns["name"].append(codes.astype("<u4" if context is not None else "<u8").tobytes())
        columns["context"].append(context[some].tobytes() if context is not None else None)
        columns["place"].append((place[some].astype(np.uint32) | np.where(flags[a:b], _FLAG, np.uint32(0))).tobytes())
    if columns["slab"]:
        yield _rows(columns)


def _settle(rows: pa.Table) -> pa.Table:
    """A slab: names that several slices have sent are decided over all of them."""
    keys, fulls, opens = ([x for x in rows.column(c).to_pylist()] for c in ("key", "full", "open"))
    out = [(k, f, o) for k, f, o in zip(keys, fulls, opens, strict=True) if k is not None]
    parts: dict[str, list] = {c: [] for c in ("name", "context", "place", "doc")}
    ids, keys, starts, docs = [], [], [], 0
    for row in rows.select(["name", "context", "place", "ids", "keys", "starts"]).to_pylist():
        if row["name"] is None:
            continue
        place = np.frombuffer(row["place"], np.uint32)
        begin = np.frombuffer(row["starts"], "<u4")
        parts["place"].append(place)
        parts["doc"].append(np.searchsorted(begin, place & ~_FLAG, "right") - 1 + docs)
        parts["name"].append(np.frombuffer(row["name"], "<u8" if row["context"] is None else "<u4"))
        if row["context"] is not None:
            parts["context"].append(np.frombuffer(row["context"], np.uint64))
        ids.append(np.frombuffer(row["ids"], np.int64))
        keys.append(np.frombuffer(row["keys"], np.int64))
        starts.append(begin)
        docs += len(begin)
    if docs:
        name, place, doc = (np.concatenate(parts[c]) for c in ("name", "place", "doc"))
        context = np.concatenate(parts["context"]) if parts["context"] else None
        ids, keys, starts = (np.concatenate(x) for x in (ids, keys, starts))
        # most names are unique: they leave before anything else is looked at
        order = np.argsort(name, kind="stable")
        new = _first([name[order]])
        alone = new & np.append(new[1:], True)
        rest = order[~alone]
        name, place, doc = name[rest], place[rest], doc[rest]
        context = context[rest] if context is not None else None
        many = (place & _FLAG) > 0  # a slice that has several contexts for the name, settled there
        place = (place & ~_FLAG).astype(np.int64)
        if context is not None and len(context):
            context = np.where(many, ~np.uint64(0) - np.arange(len(context), dtype=np.uint64), context)
        order, full, several, _ = _decide(name, context, ids[doc])
        mine = ~many[order]
        found: dict[int, list] = {}
        for kind, chosen in ((0, full & mine), (1, several & ~full & mine)):
            some = order[chosen]
            local = (place[some] - starts[doc[some]]).astype("<i4")
            by_doc = np.lexsort((local, keys[doc[some]]))
            local, owner = local[by_doc], keys[doc[some]][by_doc]
            for a, b in _runs(owner):
                found.setdefault(int(owner[a]), [None, None])[kind] = local[a:b].tobytes()
        out += [(k, f, o) for k, (f, o) in found.items()]
    columns = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["key", "full", "open"])


def _merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the given ranges."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    first = np.flatnonzero(new)
    return low[first], high[np.append(first[1:] - 1, len(low) - 1)] if len(low) else high


def _unpacked(parts: list | None) -> np.ndarray:
    return np.frombuffer(b"".join(p for p in parts or [] if p), "<i4").astype(np.int64)


def _collected(entries: DataFrame, before: int, after: int, name: str) -> DataFrame:
    """(key, spans, open): per document the merged ranges [place - before, place + after) and the open places."""
    settled = entries.groupBy("slab").applyInArrow(_settle, "key bigint, full binary, open binary")
    lists = settled.groupBy("key").agg(F.collect_list("full").alias("full"), F.collect_list("open").alias("open"))

    def make():
        def apply(batch):
            spans, opens = [], []
            for full, open_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = _unpacked(full)
                low, high = _merged(np.maximum(at - before, 0), at + after)
                spans.append(np.stack([low, high], axis=1).astype("<i4").tobytes())
                opens.append(np.unique(_unpacked(open_)).astype("<i4").tobytes())
            return [batch.column(0), spans, opens]

        return apply

    return stage_table(map_slices(lists, make, "key bigint, spans binary, open binary"), name)


def _beside(texts: DataFrame, narrow: DataFrame, how: str) -> DataFrame:
    """Texts with the packed columns of their keys: broadcast only where those are few bytes, else a shuffle join."""
    packed = [c for c in narrow.columns if c != "key"]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in packed), F.lit(40))
    held = narrow.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return texts.join(F.broadcast(narrow) if held <= BROADCAST_BYTES else narrow, "key", how)


def repeated_spans(docs: DataFrame, length: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(key, spans): for documents with repeats, the byte ranges to remove as packed int32 pairs.

    `key` is a hash of the row's id and text. Ranges may reach beyond the end of the text.
    """
    if length < max(GRAM, HALF):
        raise ValueError(f"length must be {max(GRAM, HALF)} at least")
    texts = keyed(docs, id_column, text_column)
    held = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slabs = max(LEAST_SLABS, pieces_for(held, SLAB_BYTES))

    def sample(batches):
        for piece in slices(batches, 1 << 20, SLICE_BYTES):
            data, starts = _texts(piece.column(2))
            keys, ids = (piece.column(c).to_numpy() for c in (0, 1))
            _, anchors, hashes, grams = _anchors(data, starts, length)
            if not len(anchors):
                continue
            place = anchors[_first([anchors])]
            doc = np.searchsorted(starts, place, "right") - 1
            context = hashes.ranges(np.maximum(starts[doc], place - (length - GRAM)), np.minimum(starts[doc + 1], place + length))
            yield from _send(place, grams[place], context, doc, ids, keys, starts, slabs)

    first = _collected(text_batches(texts).mapInArrow(sample, ENTRY), length - GRAM, length, "repeats-1")

    def double(batches):
        for piece in slices(batches, 1 << 20, SLICE_BYTES):
            data, starts = _texts(piece.column(2))
            keys, ids = (piece.column(c).to_numpy() for c in (0, 1))
            at, anchors, hashes, _ = _anchors(data, starts, length)
            wanted = np.zeros(len(data) + 1, bool)
            for start, open_ in zip(starts, piece.column(3).to_pylist(), strict=False):
                wanted[start + np.frombuffer(open_, "<i4")] = True
            place = at[wanted[anchors]]
            if not len(place):
                continue
            half = names = hashes.fixed(HALF)
            width = HALF
            while 2 * width < length:  # the rank pair at an offset that doubles
                names, width = _mixed(names[:-width] * np.uint64(_ODD) + names[width:]), 2 * width
            # the last one at the offset that makes both names cover the window
            name = _mixed(names[place] * np.uint64(_ODD) + names[place + length - width])
            doc = np.searchsorted(starts, place, "right") - 1
            yield from _send(place, name, None, doc, ids, keys, starts, slabs, half[place])

    open_ = first.where(F.octet_length("open") > 0).select("key", "open")
    second = _collected(_beside(texts, open_, "inner").select("key", "id", "text", "open").mapInArrow(double, ENTRY), 0, length, "repeats-2")
    found = first.select("key", "spans").union(second.select("key", "spans")).where(F.octet_length("spans") > 0)

    def make():
        def apply(batch):
            out = []
            for parts in batch.column(1).to_pylist():
                pairs = _unpacked(parts).reshape(-1, 2)
                out.append(np.stack(_merged(pairs[:, 0], pairs[:, 1]), axis=1).astype("<i4").tobytes())
            return [batch.column(0), out]

        return apply

    return stage_table(map_slices(found.groupBy("key").agg(F.collect_list("spans").alias("spans")), make, "key bigint, spans binary"), "repeats")


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(
        F.xxhash64(F.col(id_column), text).alias("key"),
        F.coalesce(F.col(id_column).cast("bigint"), F.lit((1 << 63) - 1)).alias("id"),
        text.alias("text"),
    )


def remove_repeats(docs: DataFrame, length: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, n_bytes, the removed runs (start, end) and the remaining bytes."""
    spans = repeated_spans(docs, length, id_column, text_column)
    texts = keyed(docs, id_column, text_column).withColumn("own", F.when(F.col("id") < (1 << 63) - 1, F.col("id")))
    both = _beside(texts, spans, "left").select("own", "spans", "text")

    def make():
        def apply(batch):
            sizes, starts, ends, kept = [], [], [], []
            for packed, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                pairs = np.frombuffer(packed or b"", "<i4").reshape(-1, 2)
                low, high = pairs[:, 0].tolist(), np.minimum(pairs[:, 1], len(data)).tolist()
                sizes.append(len(data))
                starts.append(low)
                ends.append(high)
                kept.append(b"".join(data[a:b] for a, b in zip([0, *high], [*low, len(data)], strict=True)) if low else data)
            return [batch.column(0), sizes, starts, ends, pa.array(kept, pa.binary())]

        return apply

    return map_slices(both, make, f"`{id_column}` bigint, n_bytes bigint, starts array<int>, ends array<int>, kept binary")


def removal_report(documents: DataFrame, length: int = 50) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs and the digest of what remains."""
    return remove_repeats(documents, length).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
