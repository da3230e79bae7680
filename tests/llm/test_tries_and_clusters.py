"""Prefix trie, centroid clustering and tensored MinHash against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from labelloom.llm import centroids, prefix_trie, tensor_minhash
from tests.llm.cases import documents, plain, prose, texts
from tests.llm.test_copies import brute_components, family

TURNS = "conv_id bigint, turn bigint, role string, text string, node string, c bigint, j bigint, size bigint"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, None, 7) for r in rows], TURNS).repartition(3)


def brute_trie(rows):
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    turns: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), role, text))
    turns = {c: [(t[3], t[4]) for t in sorted(own)] for c, own in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members: dict = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children: dict = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    for node, held in members.items():
        leaves = saved = 0
        stack = [node]
        while stack:
            at = stack.pop()
            below = children.get(at, [])
            leaves += not below
            saved += (len(members[at]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", at[-1][1])) if at else 0
            stack += below
        ends = ",".join(str(c) for c in sorted(held) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(held), len(node), parent, len(held), len(children.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def awkward_turns():
    rng = random.Random(7)
    rows = []
    for c in range(90):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi there", "a  b\tc", "", None, "é x"])))
    # long conversations that part late, copies of one conversation, repeated rows and ties, lone and negative ids
    for c in (200, 201, 202):
        rows += [(c, t, "user", f"same {t // 3}" if t < 60 else f"own {c}") for t in range(70 + c % 3)]
    rows += [(c, t, "user", "copy") for c in range(5000, 5060) for t in range(3)]
    rows += [(300, 1, "user", "x")] * 3 + [(300, 1, "a", "user x"), (300, None, "user", "first"), (300, None, None, None)]
    rows += [(-7, 1, "user", "minus"), (-7, 2, "user", "two"), (991, 1, "user", "lone"), (None, 1, "user", "nobody"), (400, 1, "user", "long " * 30_000)]
    return rows


def test_trie_equals_brute_force(spark):
    rows = awkward_turns()
    assert plain(prefix_trie.trie_report(conversations(spark, rows)).collect()) == plain(brute_trie(rows))


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(21, 1, "user", "x")], [(20, 1, None, None)]])
def test_trie_of_few_rows(spark, rows):
    assert plain(prefix_trie.trie_report(conversations(spark, rows)).collect()) == plain(brute_trie(rows))


def test_rows_of_the_recursion_halve(spark):
    """The parts of a level of the recursion are a share of the turns, whatever the longest conversation is."""
    rows = [(1, t, "user", str(t)) for t in range(64)] + [(c, 1, "user", "short") for c in range(100, 160)]
    sizes, turns = prefix_trie.shared_turns(prefix_trie.ordered_turns(conversations(spark, rows)))
    at = prefix_trie.node_rows(sizes, turns, 7)
    assert at.count() == sum(r.size + 1 for r in sizes.collect())
    assert at.groupBy("c", "d").count().where("count > 1").count() == 0


# --- centroids -------------------------------------------------------------------------------------


def brute_lloyd(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups: dict = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, held in groups.items():
            centers[j] = [sum(col) // len(held) for col in zip(*held, strict=True)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return [(i, j, s, sum(x for _, y, x in placed if y == j), sum(x for *_, x in placed), digest[j]) for i, j, s in placed]


def vectors(spark, rows):
    schema = "vec_id bigint, embedding array<float>, label int, cluster int, id string, x string, k int"
    return spark.createDataFrame([(i, v, 1, 9, "q", None, 3) for i, v in rows], schema).repartition(5)


def drawn(n, dims=64, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dims))
    return [(int(i), [float(np.float32(x)) for x in centers[i % 12] + 0.4 * rng.normal(size=dims)]) for i in range(n)]


def test_clusters_equal_brute_force(spark):
    rows = drawn(150)
    same = [float(np.float32(x)) for x in rows[3][1]]
    rows += [(1000 + k, same) for k in range(60)] + [(3, same), (3, same), (None, same), (7, None), (8, []), (9, [1.0] * 63), (10, [0.5] * 63 + [None])]
    rows += [(11, [0.5] * 63 + [math.nan]), (12, [math.inf] * 64), (13, [-0.001] * 64)]
    got = plain(centroids.clusters(vectors(spark, rows)).collect())
    assert got == plain(brute_lloyd(rows, 8, 10, 64, 1024, "3"))


def test_few_vectors_and_none(spark):
    for rows in ([], [(1, None)], drawn(1), [(k, [0.0] * 64) for k in range(5)]):
        assert plain(centroids.clusters(vectors(spark, rows)).collect()) == plain(brute_lloyd(rows, 8, 10, 64, 1024, "3"))


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_any_number_of_blocks(spark, blocks):
    rows = [(i, v[:7]) for i, v in drawn(80)]
    placed, model = centroids.lloyd(vectors(spark, rows), k=3, rounds=4, dims=7, scale=100, seed="s", blocks=blocks)
    want = brute_lloyd(rows, 3, 4, 7, 100, "s")
    assert plain(placed.collect()) == plain([w[:3] for w in want])
    assert {r.centroid_sha256 for r in centroids.centroid_rows(model).collect()} >= {w[5] for w in want}


def test_huge_components_are_held(spark):
    rows = [*drawn(20), (50, [3e38] * 64), (51, [-3e38] * 64)]
    got = {r.vec_id: r for r in centroids.clusters(vectors(spark, rows)).collect()}
    assert len(got) == 22 and all(r.distance >= 0 and r.inertia > 0 for r in got.values())


# --- near copies -----------------------------------------------------------------------------------


def test_near_copies_equal_brute_force(spark):
    rows = texts() + [(2000 + k, t) for k, t in enumerate(family(31, 40, 5, 110))] + [(3000 + k, prose(9, 50)) for k in range(300)]
    got = tensor_minhash.near_duplicates(documents(spark, rows)).collect()
    want = brute_components(rows, 2, 80)
    assert plain([r[:3] for r in got]) == plain(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_few_words_of_a_signature_go_with_each_key(spark, monkeypatch):
    """What is staged for every open key of a set holds no whole signature, and all links are found from it."""
    staged, stage = {}, tensor_minhash.stage_table
    monkeypatch.setattr(tensor_minhash, "stage_table", lambda df, name: staged.setdefault(name, []).append(df.columns) or stage(df, name))
    rows = [(2000 + k, t) for k, t in enumerate(family(31, 40, 5, 110))] + [(3000 + k, t) for k, t in enumerate(family(32, 30, 9, 90))]
    got = tensor_minhash.near_duplicates(documents(spark, rows)).collect()
    assert plain([r[:3] for r in got]) == plain(brute_components(rows, 2, 80))
    assert len(staged["minhash-open"]) == 2
    assert all(len(columns) <= 4 + tensor_minhash.FOLDED for columns in staged["minhash-open"])


def test_pairs_of_a_key_become_rows_only_when_they_may_link(spark, monkeypatch):
    """Sets that share keys with each other are compared inside the tasks: no join puts out a row for two of them."""
    rng = np.random.default_rng(5)
    draw = lambda k: rng.integers(-(2**62), 2**62, k)
    keys, columns = draw(40), [draw(90) for _ in tensor_minhash.SIGNS]
    # 90 sets of distant signatures in two components, and of each the next one has the same signature
    facts = [(i, 400, *(int(c[i - i % 2]) for c in columns)) for i in range(90)]
    entries = [(int(k), i, i % 2) for k in keys for i in range(90)] + [(1, 0, 0), (1, 1, 1), (2, 5, 1), (3, 4, 0), (3, 6, 0)]
    facts = spark.createDataFrame(facts, "node bigint, n bigint, " + ", ".join(f"{s} bigint" for s in tensor_minhash.SIGNS))
    entries = spark.createDataFrame(entries, "key bigint, node bigint, component bigint")
    for block, few in ((2_048, 24), (16, 4)):
        monkeypatch.setattr(tensor_minhash, "BLOCK", block, raising=False)
        monkeypatch.setattr(tensor_minhash, "FEW", few, raising=False)
        pairs = tensor_minhash._crossing(entries, facts, 80)
        assert sorted(tuple(r) for r in pairs.collect()) == [(i, i + 1) for i in range(0, 90, 2)]
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Join" in line and ("<" in line or "bit_count" in line)]


def test_no_documents(spark):
    assert tensor_minhash.near_duplicates(documents(spark, [])).count() == 0
    assert plain(tensor_minhash.near_duplicates(documents(spark, [(1, None), (2, "")])).collect()) == plain([(1, 0, 1, True), (2, 0, 2, True)])


def test_tables_come_from_few_minhashes():
    grams = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    parts = tensor_minhash.parts_of(tensor_minhash.minhashes(grams))
    assert len(parts) == 2 * tensor_minhash.SIDE
    keys = tensor_minhash.table_keys(parts[None])[0]
    assert len(set(keys.tolist())) == tensor_minhash.SIDE**2
    # a set that shares one part of either collection shares just the key of the two
    other = np.random.default_rng(1).integers(0, 2**63, len(parts)).astype(np.uint64)
    other[4], other[tensor_minhash.SIDE + 9] = parts[4], parts[tensor_minhash.SIDE + 9]
    same = np.flatnonzero(tensor_minhash.table_keys(other[None])[0] == keys)
    assert same.tolist() == [4 * tensor_minhash.SIDE + 9]


def test_share_of_pairs_found():
    """Pairs at the threshold and above share a key; those far below seldom do."""
    rng = np.random.default_rng(5)

    def shares(similarity, size=400, trials=150):
        common = round(2 * size * similarity / (1 + similarity))
        hit = 0
        for _ in range(trials):
            pool = tensor_minhash._mixed(rng.integers(0, 2**63, 2 * size - common).astype(np.uint64))
            keys = tensor_minhash.table_keys(np.stack([tensor_minhash.parts_of(tensor_minhash.minhashes(p)) for p in (pool[:size], pool[-size:])]))
            hit += bool((keys[0] == keys[1]).any())
        return hit / trials

    assert shares(0.8) == 1.0
    assert shares(0.1) <= 0.02
