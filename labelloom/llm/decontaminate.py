"""Benchmark decontamination through a stored positional inverted index.

The index is cut by documents, as in search engines: a shard holds some megabytes of text, and for each
of its terms the sorted positions in the shard's token stream. It is built in the scan (no shuffle) and
staged as a table, one row per (shard, term) and one head row per shard with its documents. A search
takes from it only the rows of terms that the test items use, adds up their frequencies over all
shards, and intersects, shard by shard, the offset-adjusted lists of a window from its rarest term on.

Exact matches are windows of `window` consecutive item words (an item of fewer words is one window);
near matches are stretches of the window's length and `slop` words in which at least `NEAR_PERCENT` of all its
distinct terms stand, in any order (`slop` None: exact matches only). Neither crosses documents. Whichever terms
are missing, one of the rarest few must be there: stretches are looked for around those. Items are searched in
blocks of bounded bytes, so they may outgrow any executor.

Defined results: null and empty texts have no words and match nothing; rows are told apart by their place
in the index, so ids may be null or repeated; repeated items with one id count once; items whose id is null
hit words but are not counted as items.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import forget, pieces_for, slices, text_batches, trim
from labelloom.session import broadcast_if_small, stage_table

#: Bytes of text in a shard, and of test items that are searched at a time.
SHARD_BYTES, ITEM_BYTES = 8 << 20, 4 << 20
#: Share of a window's distinct terms that a near match needs, and words that may stand between them.
NEAR_PERCENT, NEAR_SLOP = 80, 10
INDEX = "shard string, term binary, n bigint, places binary, ids array<bigint>, starts array<int>"
MATCH = "shard string, no int, item_id string, kind string, start int, end int"

#: A-Z in lower case; digits, letters and all bytes above ASCII are word bytes.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def coded_words(texts: list[str | None]) -> tuple[list[int], pa.DictionaryArray]:
    """Words in each text and the codes of all of them in turn; words are cut out of one buffer, none is an object."""
    raw = [t.encode("utf-8", "replace").translate(WORD_BYTES) if t else b"" for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    inside = data != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(end - begin, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    upto = np.searchsorted(begin, np.cumsum([len(r) + 1 for r in raw]))
    return np.diff(upto, prepend=0).tolist(), words.dictionary_encode()


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The staged positional index of all words of all texts."""

    def shard_rows(ids: list, lengths: list[int], words: list[pa.DictionaryArray]):
        name = uuid.uuid4().hex
        starts = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(lengths, out=starts[1:])
        coded = pa.chunked_array(words).unify_dictionaries().combine_chunks()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable").astype("<i4")
        counts = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int64)
        ends = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        # the positions of a term as steps from one to the next, which compress well
        steps = np.diff(order, prepend=order[:1])
        steps[ends[:-1]] = order[ends[:-1]]
        places = pa.Array.from_buffers(
            pa.binary(), len(counts), [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(steps.tobytes())]
        )
        n = len(counts)
        none = [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))]
        names = ["shard", "term", "n", "places", "ids", "starts"]
        yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), coded.dictionary, pa.array(counts), places, *none], names=names)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name]),
                pa.nulls(1, pa.binary()),
                pa.array([len(ids)], pa.int64()),
                pa.nulls(1, pa.binary()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([starts.tolist()], pa.list_(pa.int32())),
            ],
            names=names,
        )

    def build(batches):
        forget()
        ids, lengths, words, held = [], [], [], 0
        for piece in slices(batches, size=1 << 20):
            count, coded = coded_words(piece.column(1).to_pylist())
            ids += piece.column(0).to_pylist()
            lengths += count
            words.append(coded)
            held += piece.nbytes
            if held >= SHARD_BYTES:
                yield from shard_rows(ids, lengths, words)
                ids, lengths, words, held = [], [], [], 0
                trim()
        if ids:
            yield from shard_rows(ids, lengths, words)

    narrow = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    return stage_table(text_batches(narrow).mapInArrow(build, INDEX), "postings")


def _near(places, starts, terms, needed, length):
    """Stretches of at most `length` words of a document with `needed` of the terms, which come rarest first."""
    lists = [places[t] for t in terms if t in places]
    if len(lists) < needed:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # `needed` terms cannot all be among the last `needed - 1`
    at = np.unique(np.concatenate(lists[: len(lists) - needed + 1]))
    doc = np.searchsorted(starts, at, "right") - 1
    low, high = np.maximum(at - length + 1, starts[doc]), np.minimum(at + length, starts[doc + 1])
    count = np.zeros(len(at), np.int64)
    for left, found in zip(range(len(lists) - 1, -1, -1), lists, strict=True):
        k = np.searchsorted(found, low)
        count += found[np.minimum(k, len(found) - 1)] < high
        count -= (k == len(found)) & (found[-1] < high)
        good = count + left >= needed
        at, low, high, count = at[good], low[good], high[good], count[good]
        if not len(at):
            return at, at
    # every place where a stretch around one of them may begin
    begin = (at[:, None] - np.arange(length)).ravel()
    begin = np.unique(begin[begin >= np.repeat(low, length)])
    end = np.minimum(begin + length, starts[np.searchsorted(starts, begin, "right")])
    count, first, last = np.zeros(len(begin), np.int64), end.copy(), begin.copy()
    for found in lists:
        k = np.searchsorted(found, begin)
        near = found[np.minimum(k, len(found) - 1)]
        here = (k < len(found)) & (near < end)
        count += here
        first = np.where(here, np.minimum(first, near), first)
        last = np.where(here, np.maximum(last, near), last)
    good = count >= needed
    return first[good], last[good]


def _phrase(places, window):
    """Starts of the window's exact occurrences, from the list of its rarest term on."""
    at = None
    for term, offset in window:
        found = places[term]
        if at is None:
            at = found - offset
        else:
            want = at + offset
            k = np.minimum(np.searchsorted(found, want), len(found) - 1)
            at = at[found[k] == want]
        if not len(at):
            break
    return at


def search(index: DataFrame, items: DataFrame, window: int = 13, slop: int | None = NEAR_SLOP, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Matches (shard, no, item_id, kind, start, end) of items; `end` is exclusive, both in words of the document."""
    spark = index.sparkSession
    items = items.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text")).distinct()
    held = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, found = pieces_for(held, ITEM_BYTES), None
    for block in range(blocks):
        # one block at a time: its bytes are bounded, its windows go along with the tasks
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        texts = [(r["id"], words_of(r["text"])) for r in part]
        vocabulary = sorted({w for _, words in texts for w in words})
        if not vocabulary:
            continue
        terms = spark.createDataFrame([(bytearray(w),) for w in vocabulary], "term binary")
        used = index.where("term is not null").select("shard", "term", "n", "places").join(broadcast_if_small(terms), "term")
        number = {w: k for k, w in enumerate(vocabulary)}
        frequency = np.zeros(len(vocabulary), np.int64)
        for row in used.groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most the block's vocabulary
            frequency[number[bytes(row["term"])]] = row["n"]
        names, coded = [t[0] for t in texts], [np.array([number[w] for w in words], np.int32) for _, words in texts]
        heads = index.where("term is null").select("shard", F.lit(None).cast("binary").alias("term"), F.lit(None).cast("binary").alias("places"), "starts")
        rows = used.select("shard", "term", "places", F.lit(None).cast("array<int>").alias("starts")).unionByName(heads)
        matches = rows.groupBy("shard").applyInArrow(_search_shard(coded, names, vocabulary, frequency, window, slop), MATCH)
        found = matches if found is None else found.unionByName(matches)
    return stage_table(found, "matches") if found is not None else spark.createDataFrame([], MATCH)


def _search_shard(items, names, vocabulary, frequency, window, slop):
    """Search of one shard: items are arrays of term numbers, frequencies are those of the whole corpus."""

    def apply(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        number = {w: k for k, w in enumerate(vocabulary)}
        places, starts = {}, None
        for term, packed, begins in zip(*(rows.column(c).to_pylist() for c in ("term", "places", "starts")), strict=True):
            if term is None:
                starts = np.array(begins, np.int64)
            else:
                places[number[term]] = np.cumsum(np.frombuffer(packed, "<i4"), dtype=np.int64)
        here = np.zeros(len(vocabulary), bool)
        here[list(places)] = True
        out = {}
        for item, codes in enumerate(items):
            for first in range(max(1, len(codes) - window + 1) if len(codes) else 0):
                piece = codes[first : first + window]
                whole = here[piece].all()
                if not whole and slop is None:
                    continue
                size, order = len(piece), np.argsort(frequency[piece], kind="stable")
                if whole:
                    at = _phrase(places, [(int(piece[o]), int(o)) for o in order])
                    if len(at):
                        doc = np.searchsorted(starts, at, "right") - 1
                        good = (at >= 0) & (at + size <= starts[np.minimum(doc + 1, len(starts) - 1)])
                        out.setdefault((item, "phrase"), []).append((at[good], at[good] + size))
                if slop is not None:
                    near = list(dict.fromkeys(int(piece[o]) for o in order))
                    low, high = _near(places, starts, near, -(-len(near) * NEAR_PERCENT // 100), size + slop)
                    if len(low):
                        out.setdefault((item, "near"), []).append((low, high + 1))
        columns = [[], [], [], [], []]
        for (item, kind), spans in out.items():
            low, high = (np.concatenate([s[c] for s in spans]) for c in (0, 1))
            if not len(low):
                continue
            order = np.argsort(low, kind="stable")
            low, high = low[order], high[order]
            doc = np.searchsorted(starts, low, "right") - 1
            # spans of one item that overlap or touch in a document become one
            reach = np.maximum.accumulate(high)
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            columns[0].append(doc[first])
            columns[1] += [names[item]] * len(first)
            columns[2] += [kind] * len(first)
            columns[3].append(low[first] - starts[doc[first]])
            columns[4].append(np.maximum.reduceat(high, first) - starts[doc[first]])
        n = len(columns[1])
        flat = [np.concatenate(columns[c]) if columns[c] else np.empty(0, np.int64) for c in (0, 3, 4)]
        return pa.table(
            {
                "shard": pa.array([shard] * n, pa.string()),
                "no": pa.array(flat[0], pa.int32()),
                "item_id": pa.array(columns[1], pa.string()),
                "kind": pa.array(columns[2], pa.string()),
                "start": pa.array(flat[1], pa.int32()),
                "end": pa.array(flat[2], pa.int32()),
            }
        )

    return apply


def overlap_report(docs: DataFrame, items: DataFrame, window: int = 13, percent: int = 5, slop: int | None = None, id_column: str = "doc_id") -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items, n_near, near_items and `contaminated` (hits and at least `percent` of the words)."""
    index = build_index(docs, id_column)
    found = search(index, items, window, slop)
    rows = index.where("term is null").select(
        "shard", F.posexplode("ids").alias("no", id_column), "starts"
    ).select("shard", "no", id_column, (F.get("starts", F.col("no") + 1) - F.get("starts", "no")).cast("bigint").alias("n_words"))
    # Words hit by several items count once: each span adds what lies beyond the furthest end before it.
    before = Window.partitionBy("shard", "no").orderBy("start", "end", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    phrases = found.where("kind = 'phrase'").withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
    hits = phrases.groupBy("shard", "no").agg(
        F.sum(F.greatest(F.col("end") - F.greatest("start", "reach"), F.lit(0))).alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    near = found.where("kind = 'near'").groupBy("shard", "no").agg(F.array_sort(F.collect_set("item_id")).alias("near_items"))
    return (
        rows.join(hits, ["shard", "no"], "left")
        .join(near, ["shard", "no"], "left")
        .select(
            id_column,
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"),
        )
        .withColumn("n_near", F.size("near_items").cast("bigint"))
        .withColumn("n_items", F.size("items").cast("bigint"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))
    )


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return overlap_report(documents, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def near_contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of `contamination` with the near matches beside them."""
    return overlap_report(documents, benchmark, slop=NEAR_SLOP).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        "n_near",
        F.array_join("near_items", ",").alias("near_items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows that are not contaminated, with all their columns; decided on a hash of the row's id and text."""
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", text_column))
    bad = overlap_report(keyed.select("__key", "text"), benchmark, id_column="__key").where("contaminated").select("__key").distinct()
    return keyed.join(broadcast_if_small(bad), "__key", "left_anti").drop("__key")
