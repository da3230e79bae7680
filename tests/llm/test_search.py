"""Top-k search and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import decontaminate, topk
from tests.llm.cases import documents, plain, prose, texts


def brute_top(rows, every, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            scaled = [int(np.floor(256 * float(x))) for x in v]
            usable[i] = min(scaled, usable.get(i, scaled))
    out = []
    for q, w in usable.items():
        if q % every == 0:
            scores = [(-sum(a * b for a, b in zip(w, v, strict=True)), i) for i, v in usable.items() if i != q and len(v) == len(w)]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def vectors(seed, n, width, scale=1.0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in scale * rng.normal(size=width)]) for i in range(n)]
    same = rows[3][1]
    rows += [(n + k, same) for k in range(30)]  # ties
    rows += [(None, same), (n + 50, None), (n + 51, [None, 1.0]), (n + 52, [float("nan")] * width), (n + 53, [float("inf")] * width)]
    return rows + [rows[5], (n + 54, [1.0]), (n + 100, [2.0]), (n + 57, [])]


@pytest.mark.parametrize(("n", "width", "scale"), [(400, 8, 1.0), (300, 64, 0.2), (60, 3, 1e6)])
def test_top_k(spark, n, width, scale):
    rows = vectors(n, n, width, scale)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).withColumn("id", F.lit("x"))
    frame_rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    scaled = frame.select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    got = topk.exact_top_k(scaled, F.col("vec_id") % 10 == 0, 5, vector_block=100, query_block=16)
    assert plain(got.select("query_id", "rank", "vec_id", "score").collect()) == plain(brute_top(frame_rows, 10, 5))


def test_few_or_no_candidates(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert topk.nearest(spark.createDataFrame([], kind)).count() == 0
    assert topk.nearest(spark.createDataFrame([(0, [1.0, 2.0])], kind)).count() == 0
    two = topk.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -0.5])], kind)).collect()
    assert [tuple(r) for r in two] == [(0, 1, 1, 256 * 128 - 512 * 128)]


def test_reading_stops_early_with_the_right_rows():
    rng = np.random.default_rng(1)
    base = np.floor(256 * rng.normal(size=(3000, 4)) * [[10, 1, 0.1, 0.1]]).astype(np.int64)
    lists = topk.SortedLists(np.arange(3000), base)
    for row in range(20):
        found, scores, read = lists.top_k(row, base[row], 5)
        every = base @ base[row]
        want = sorted((-int(every[i]), i) for i in range(3000) if i != row)[:5]
        assert sorted((-int(s), int(i)) for i, s in zip(found, scores, strict=True)) == want
        assert read < base.size


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 27, 1 << 40])
def test_queries_read_side_by_side(scale):
    """Queries that stop at different steps, in floats of either size or whole numbers, get what each gets alone."""
    rng = np.random.default_rng(3)
    base = rng.integers(-90, 90, (900, 5)) * np.array([scale, 10, 1, 1, 1])
    queries = np.concatenate([base[:30], np.eye(5, dtype=np.int64), -np.eye(5, dtype=np.int64), np.zeros((1, 5), np.int64)])
    own = [*range(30), *[-1] * 11]
    lists = topk.SortedLists(np.arange(900), base)
    together = lists.top_k_of(own, queries, 4)
    for mine, query, (found, scores, read) in zip(own, queries, together, strict=True):
        every = base.astype(object) @ query.astype(object)
        want = sorted((-int(every[i]), i) for i in range(900) if i != mine)[:4]
        assert [(-int(s), int(i)) for i, s in zip(found, scores, strict=True)] == want
        one = lists.top_k(mine, query, 4)
        assert one[0].tolist() == found.tolist() and one[2] == read
    assert scale > 1 << 20 or len({read for *_, read in together}) > 1


def test_lists_without_weight_are_not_read():
    base = np.random.default_rng(2).integers(-50, 50, (500, 6))
    query = np.array([3, 0, 0, -2, 0, 0])
    found, scores, read = topk.SortedLists(np.arange(500), base).top_k(-1, query, 3)
    assert scores.tolist() == sorted((base @ query).tolist(), reverse=True)[:3]
    assert read <= 2 * 500


def test_entries_read_are_reported(spark):
    rows = [(i, [float(i % 7), float(i % 11) / 100]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    scaled = frame.select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    got = topk.exact_top_k(scaled, F.col("vec_id") == 6, 5, vector_block=100).collect()
    assert len(got) == 5 and len({r.n_read for r in got}) == 1 and 0 < got[0].n_read <= 600


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_overlap(rows, items, window=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(item)
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                owners = windows.get(tuple(w[k : k + size]))
                if owners:
                    hit |= set(range(k, k + size))
                    found |= owners
        names = sorted(str(x) for x in found if x is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def benchmark_rows():
    passage = prose(2, 60).split()
    return [
        (1, " ".join(passage[:20])),
        (2, " ".join(passage[10:40]).upper() + "."),
        (2, " ".join(passage[45:])),
        (3, "one"),
        (4, "one, TWO"),
        (5, ""),
        (6, None),
        (7, prose(77, 30)),
        (None, " ".join(passage[5:30])),
        (10, " ".join(passage[:12])),
    ]


@pytest.mark.parametrize("shard", [decontaminate.SHARD_BYTES, 300])
@pytest.mark.parametrize("item_bytes", [decontaminate.ITEM_BYTES, 100])
def test_overlaps(spark, shard, item_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", item_bytes)
    items = spark.createDataFrame(benchmark_rows(), "item_id bigint, text string")
    got = decontaminate.contamination(documents(spark), items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert plain(got.collect()) == plain(brute_overlap(texts(), benchmark_rows()))


def test_near_matches_stand_close_in_any_order(spark):
    rng, passage = random.Random(4), prose(9, 13).split()
    far = " ".join(passage[:6]) + " " + " ".join(["filler"] * 60) + " " + " ".join(passage[6:])
    mixed = " ".join(rng.sample(passage, len(passage)))
    rows = [(1, f"aa bb {mixed} cc"), (2, far), (3, " ".join(passage)), (4, "nothing here")]
    items = spark.createDataFrame([(1, " ".join(passage))], "item_id bigint, text string")
    report = {r.doc_id: r for r in decontaminate.overlap_report(documents(spark, rows), items, slop=5).collect()}
    assert [report[k].n_near for k in (1, 3, 4)] == [1, 1, 0]
    assert [report[k].n_items for k in (1, 2, 3, 4)] == [0, 0, 1, 0]


def brute_near(rows, items, window=13, slop=10, percent=80):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault((frozenset(w[k : k + window]), len(w[k : k + window])), set()).add(item)
    out = []
    for i, text in rows:
        w, found = words(text), set()
        for (terms, size), owners in windows.items():
            if any(100 * len(terms & set(w[k : k + size + slop])) >= percent * len(terms) for k in range(len(w))):
                found |= owners
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(names), ",".join(names)))
    return out


@pytest.mark.parametrize("shard", [decontaminate.SHARD_BYTES, 300])
def test_near_matches_by_all_terms(spark, shard, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    rng, rows = random.Random(3), [(i, t) for i, t in texts() if len(t or "") < 4000]
    passage = [f"rare{k}" for k in range(13)]
    items = [*benchmark_rows(), (20, " ".join(passage))]
    for k in range(13):  # any one word replaced
        rows.append((700 + k, " ".join([*passage[:k], "other", *passage[k + 1 :]])))
    for k in range(40):  # words lost and put in between, about the share and the reach
        text = list(passage)
        for _ in range(rng.randint(1, 4)):
            text[rng.randrange(13)] = f"w{k}"
        for _ in range(rng.randint(0, 14)):
            text.insert(rng.randrange(1, len(text)), f"v{k}")
        rows.append((800 + k, " ".join(text)))
    rows.append((900, " ".join(passage[:4])))  # the four rarest alone
    rows += [(901, " ".join(passage[:7])), (902, " ".join(passage[7:]))]  # never across documents
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.near_contamination(documents(spark, rows), frame).cache()
    assert plain(got.select("doc_id", "n_near", "near_items").collect()) == plain(brute_near(rows, items))
    exact = got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert plain(exact) == plain(brute_overlap(rows, items))


def test_contaminated_rows_go_and_columns_stay(spark):
    items = spark.createDataFrame(benchmark_rows(), "item_id bigint, text string")
    docs = documents(spark)
    bad = {(i, t) for (i, t), r in zip(texts(), brute_overlap(texts(), benchmark_rows()), strict=True) if r[-1]}
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert plain((r.doc_id, r.text) for r in kept.collect()) == plain(x for x in texts() if x not in bad)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(documents(spark, []), none).count() == 0
    got = decontaminate.contamination(documents(spark), none)
    assert {(r.n_hit, r.n_items, r.contaminated) for r in got.collect()} == {(0, 0, False)}


@pytest.mark.parametrize("side", [1, 3, 50])
def test_blocks_and_parts_meet_in_squares(spark, monkeypatch, side):
    """Equal scores in several blocks included; a group hands on k rows a query, however many blocks it has, not k rows a block."""
    rng = np.random.default_rng(12)
    vectors = rng.integers(-3, 4, (700, 4))
    vectors[600:] = vectors[:100]
    frame = spark.createDataFrame([(k * 7, v.tolist()) for k, v in enumerate(vectors)], "vec_id bigint, vector array<bigint>")
    monkeypatch.setattr(topk, "SIDE", side)
    handed, cut = [], topk.cut_lineage
    monkeypatch.setattr(topk, "cut_lineage", lambda df: handed.append(cut(df)) or handed[-1])
    got = topk.exact_top_k(frame, F.col("vec_id") % 10 == 0, 5, vector_block=10, query_block=8).collect()
    ids, scores = np.arange(700) * 7, vectors @ vectors.T
    want = set()
    for q in np.flatnonzero(ids % 10 == 0):
        order = [i for i in np.lexsort((ids, -scores[q])) if i != q][:5]
        want |= {(int(ids[q]), rank + 1, int(ids[i]), int(scores[q, i])) for rank, i in enumerate(order)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    groups = max(-(-70 // side), min(70, 4 * spark.sparkContext.defaultParallelism))
    assert handed[0].count() <= groups * 5 * 70


def test_a_bound_from_other_blocks_keeps_equal_scores():
    rng = np.random.default_rng(13)
    base = rng.integers(-100, 100, (2000, 8))
    lists, queries = topk.SortedLists(np.arange(2000), base), rng.integers(-100, 100, (6, 8))
    free = lists.top_k_of([-1] * 6, queries, 4)
    for shift in (0, 1):
        bound = lists.top_k_of([-1] * 6, queries, 4, [int(scores[1]) + shift for _, scores, _ in free])
        for (found, scores, read), (kept, held, less) in zip(free, bound, strict=True):
            reach = scores >= scores[1] + shift
            assert held[: reach.sum()].tolist() == scores[reach].tolist() and kept[: reach.sum()].tolist() == found[reach].tolist()
            assert less <= read
