"""The Jaccard join and the removal of repeated byte strings against brute force."""

import hashlib
import random
import re

import pytest

from labelloom.llm import common, ngram_join, suffix_dedup
from tests.llm.cases import documents, plain, prose, texts


def grams(text, n):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(rows, n, percent):
    sets = [grams(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        if i is not None and sets[k]:
            least[r] = min(i, least.get(r, i))
    return [(i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def family(seed, copies, edits, words=70):
    rng = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components(spark, n, percent):
    rows = texts()
    for k, text in enumerate([*family(50, 60, 4), *family(51, 25, 9), *family(52, 12, 1, 9)]):
        rows.append((1000 + k, text))
    got = ngram_join.similar_components(documents(spark, rows), n, percent).collect()
    assert plain((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(brute_components(rows, n, percent))


def test_one_document_of_each_component_stays(spark):
    rows = [(i, t) for i, t in texts() if i is not None]
    kept = ngram_join.one_of_each(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    want = {i for (i, n, c) in brute_components(rows, 5, 80) if c == i}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_no_documents(spark):
    assert ngram_join.components(documents(spark, [])).count() == 0
    assert suffix_dedup.removal_report(documents(spark, [])).count() == 0


def test_chains_become_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (103, 102), (101, 103)], "a bigint, b bigint")
    got = {r.node: r.component for r in common.connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 104), 100)}


def brute_removal(rows, length=50):
    first = {}
    data = [(10**18 if i is None else i, i, (t or "").encode()) for i, t in rows]
    for order, _, b in data:
        for p in range(len(b) - length + 1):
            g = b[p : p + length]
            first[g] = min(order, first.get(g, order))
    out = []
    for order, i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < order:
                gone[p : p + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("slice_bytes", [suffix_dedup.SLICE_BYTES, 2000])
def test_removed_bytes(spark, slice_bytes, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)
    rng, rows = random.Random(8), texts()
    pieces = [prose(200 + k, rng.randint(5, 14)) for k in range(12)]
    for k in range(60):  # passages in ever other surroundings, some just under and over the length
        rows.append((500 + k, "".join(rng.choice(pieces) + rng.choice(["", " ", "x", f" {k} "]) for _ in range(rng.randint(1, 6)))))
    for k in range(5):
        rows.append((600 + k, prose(1, 120)[k : 49 + 2 * k]))
    got = suffix_dedup.removal_report(documents(spark, rows)).collect()
    assert plain(got) == plain(brute_removal(rows))


@pytest.mark.parametrize("length", [32, 64, 65, 100, 128, 129, 200])
def test_removed_bytes_at_other_lengths(spark, length):
    """Form letters that agree but for a number, at every distance from the ends of a window."""
    rows = texts()
    head, tail = prose(300, 60)[:150], prose(301, 60)[:150]
    for k, (a, b) in enumerate([(150, 150), (40, 40), (66, 33), (33, 66), (90, 90), (130, 20)]):
        for copy in range(4):
            rows.append((700 + 10 * k + copy, head[-a:] + f"<{k * 10 + copy % 3:02}>" + tail[:b]))
    got = suffix_dedup.removal_report(documents(spark, rows), length).collect()
    assert plain(got) == plain(brute_removal(rows, length))


def test_runs_and_bytes(spark):
    text = prose(31, 40)
    rows = [(1, text), (2, "start " + text[10:100] + " end")]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(documents(spark, rows)).collect()}
    assert got[2].starts == [5 if text[9] == " " else 6] and bytes(got[2].kept).endswith(b" end")
    assert got[1].starts == []
    with pytest.raises(ValueError, match="at least"):
        suffix_dedup.repeated_spans(documents(spark, rows), 10)
