"""Secrets, archives, shards and the classifier."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import quality, secrets, sharding, warc
from labelloom.session import staging_path
from tests.llm.cases import documents, plain, prose, texts

ASSIGN = re.compile(
    "(" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
TRICKY = [
    "secret=token: abcdef123 token: key token=token=abcdefgh",
    "PassWord : 'hunter22' passwd=\"a\" API-KEY=abcdefgh apikey=abcdefgh1",
    "AKIA" + "A" * 15 + " AKIAAKIA" + "B" * 16 + " xAKIA" + "Z9" * 9,
    "é😀 " + "deadbeef" * 3 + "x" + "deadbeef" * 2 + "  token=" + "0123456789abcdef" * 2,
    "toKen:" + "a" * 6 + "\nsecret=" + "b" * 5 + ".",
]


def brute_base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def secret_rows():
    rows = texts() + [(700 + k, t) for k, t in enumerate(TRICKY)]
    digest = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    rows += [(800 + k, f"{prose(800 + k, 30)} some_long_identifier_name_{k} token={digest(k)[:30]}") for k in range(60)]
    return rows


def test_base_spans(spark):
    rows = secret_rows()
    got = secrets.secret_report(documents(spark, rows))
    want = []
    for i, text in rows:
        spans = brute_base(text)
        counts = collections.Counter(s[1] for s in spans)
        said = ",".join(f"{secrets.ORDER[k]}:{a}:{b}" for a, k, b in spans)
        want.append((i, counts[0], counts[1], counts[2], hashlib.sha256(said.encode()).hexdigest()))
    assert plain(tuple(r)[:5] for r in got.collect()) == plain(want)
    for r in got.collect():
        base = [s for s in r.spans.split(",") if s and not s.startswith("markov")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_models_tell_random_strings_from_identifiers(spark):
    rows = secret_rows()
    model = secrets.train(secrets.labelled_tokens(documents(spark, rows)))
    probe = [(1, "see 9f8e7d6c5b4a39281706f5e4d3 c2b1.a0 and 8f3b2c9e7a1d5f6b4c8e0A9d3b7c2e here"), (2, "see some_long_identifier_name_x and thereananontiesre here")]
    got = {r.doc_id: r.secrets_ for r in secrets.find_secrets(documents(spark, probe), model).collect()}
    assert any(s.kind == 3 and s.ratio > 0.5 for s in got[1])
    assert got[2] == []


def test_scan_without_samples_and_without_rows(spark):
    assert secrets.train(secrets.labelled_tokens(documents(spark, [(1, "abc")]))) is None
    assert secrets.secret_report(documents(spark, [])).count() == 0
    assert [tuple(r)[:4] for r in secrets.secret_report(documents(spark, [(1, None)])).collect()] == [(1, 0, 0, 0)]


def brute_spans(text, model):
    """All spans: base ones, and the long tokens of what they leave that the model takes for random."""
    text = text or ""
    base = brute_base(text)
    left = list(text)
    for a, _, b in base:
        left[a:b] = " " * (b - a)
    spans = [(k, a, b) for a, k, b in base]
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]{20,}", "".join(left)):
        steps = [model[x + y] for x, y in zip(m[0], m[0][1:])]
        if sum(round(s, 6) for s in steps) / len(steps) >= secrets.LEAST_RATIO:
            spans.append((3, m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], s[0]))


def test_all_spans_equal_brute_force(spark):
    rng = random.Random(5)
    rows = secret_rows()
    gaps = [" ", "\n", "  ", " : ", " = ", "\t", ". ", "=", " ='", "é "]
    kinds = ["password", "api_key", "token", "AKIA" + "Q" * 18, "deadbeef" * 4, "x8Kq2LmZ9vB4nT7wR1cY5d", "some_long_identifier_name_here", "word", "AKIA", "0a" * 11, "Secret"]
    for k in range(12):  # texts of several pieces, with every gap between every kind of token
        rows.append((5_000 + k, "".join(rng.choice(kinds) + rng.choice(gaps) for _ in range(2_500))))
    docs = documents(spark, rows)
    model = secrets.train(secrets.labelled_tokens(docs))
    got = plain((r.doc_id, [(s.kind, s.start, s.end) for s in r.secrets_]) for r in secrets.find_secrets(docs, model).collect())
    assert got == plain((i, brute_spans(t, model)) for i, t in rows)
    hidden = {r.doc_id: r.text for r in secrets.masked(docs).collect() if r.doc_id and r.doc_id >= 5_000}
    for i, t in rows[-12:]:
        out, at = [], 0
        for _, a, b in brute_spans(t, model):
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        assert hidden[i] == "".join(out) + t[at:]


def test_long_texts_take_linear_time(spark):
    def seconds(n):
        text = " ".join(f"{k:032x} some_long_identifier_{k}" for k in range(n))
        docs = documents(spark, [(1, text)]).cache()
        docs.count()
        start = time.perf_counter()
        row = secrets.secret_report(docs).first()
        assert (row.n_hex, row.spans.count("hex")) == (n, n)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(40_000) < 60  # 2.5 MB, one task


def test_scan_has_no_python(spark):
    frame = secrets.secret_report(documents(spark, secret_rows()))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hash" not in plan
    assert plan.count("Exchange") <= 1  # that of the test's own repartition


def test_masks(spark):
    rows = [(1, "a token=abcdefgh1 b"), (2, None), (3, "plain"), (4, "x token=" + "0123456789abcdef" * 2 + " y AKIA" + "B" * 16)]
    docs = documents(spark, rows)
    got = secrets.masked(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "a [SECRET] b", 2: None, 3: "plain", 4: "x [SECRET] y [SECRET]"}


PAGES = [
    (5, "http://a/x y", "<p>" + "same " * 40),
    (3, "http://b", "<p>" + "same " * 40),
    (9, None, "<p>" + "same " * 40),
    (3, "http://b", "<p>" + "same " * 40),
    (1, "http://c", "short"),
    (2, "http://d", "short"),
    (4, "http://é", None),
    (6, "http://e", ""),
    (7, "http://f", "\r\n\r\nWARC/1.1\r\n" + "é" * 5000),
    (None, "http://g", "<p>" + "same " * 40),
    (8, "u", "a" * 99),
    (10, "u", "a" * 99),
    (11, "u", "b" * 100),
    (12, "u", "b" * 100),
]


def brute_pages(rows):
    body = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, b in body:
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, b in body:
        f = first.get(b)
        again = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None, True))
    return out


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, key int")


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 900)
    assert plain(warc.round_trip(spark, pages(spark)).collect()) == plain(brute_pages(PAGES))
    assert warc.round_trip(spark, pages(spark, [])).count() == 0


def test_payloads_and_urls_come_back(spark):
    rows = warc.read_archives(warc.write_archives(pages(spark), staging_path(spark, "warc"))).collect()
    whole = {(r.page_id, bytes(r.payload)) for r in rows if r.record_type == "response"}
    assert (7, ("\r\n\r\nWARC/1.1\r\n" + "é" * 5000).encode()) in whole and (4, b"") in whole
    assert {r.url for r in rows if r.page_id == 5} == {"http://a/x%20y"} and {r.url for r in rows if r.page_id == 9} == {None}


class _Stream:
    def __init__(self, data):
        self.data, self.at = data, 0

    def read(self, n):
        self.at += n
        return self.data[self.at - n : self.at]


@pytest.mark.parametrize("read", [1, 7, 100_000])
def test_reader_frames_members_and_finds_damage(read):
    bodies = [b"one" * 50, b"", b"\r\n\r\n" * 9]
    records = [warc.record_bytes(k, f"u{k}", b, hashlib.sha256(b).hexdigest(), None) for k, b in enumerate(bodies)]
    data = b"".join(warc.member(r) for r in records)
    rows = [warc.parse_record(m) for m in warc.members(_Stream(data), read)]
    assert [(r[0], r[6], r[7]) for r in rows] == [(k, b, True) for k, b in enumerate(bodies)]
    assert all(zlib.decompressobj(31).decompress(warc.member(r)) == r for r in records)
    cut = [warc.parse_record(m) for m in warc.members(_Stream(data[:-5]), read)]
    assert [r[7] for r in cut] == [True, True, False]
    wrong = warc.parse_record(records[0].replace(b"oneone", b"onetwo", 1))
    assert wrong[0] == 0 and wrong[7] is False
    assert warc.parse_record(b"nonsense")[7] is False


def test_shards(spark):
    rows = texts() + [(900 + k, prose(900 + k, 5 + k)) for k in range(120)] + [(2000 + k, "copy") for k in range(50)]
    for buckets, fan in ((sharding.BUCKET_GROUPS, sharding.FAN_IN), (7, 3)):
        got = sharding.balanced_shards(documents(spark, rows), 6, bucket_groups=buckets, fan_in=fan).collect()
        assert plain((r.doc_id, r.size, r.text_crc32) for r in got) == plain(
            (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
        )
        slots, size, homes = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
        text = dict(rows)
        for r in got:
            slots[r.shard].append(r.slot)
            size[r.shard] += r.size
            if r.doc_id is not None:
                homes[text[r.doc_id]].add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert set(map(len, homes.values())) == {1}
        if buckets > 7:
            heavy = 2 * (18000 + 8)  # two long texts fill a shard each
            rest = [s for s in size.values() if s < heavy / 2]
            assert max(rest) - min(rest) <= 40, size
    assert sharding.sharded(documents(spark, [])).count() == 0
    assert set(sharding.sharded(documents(spark, rows)).columns) == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}


@pytest.mark.parametrize(("n", "buckets", "fan", "share"), [(3000, 500, 1000, 48), (3000, 500, 1000, 3), (6000, 60, 4, 48), (6000, 60, 4, 3)])
def test_heavy_group_in_many_buckets(spark, n, buckets, fan, share):
    parts, rng = 24, np.random.default_rng(n)
    sizes = rng.integers(100, 3000, n).tolist()
    heavy = sum(sizes) // (share - 1)  # a `share`th of all bytes
    total = sum(sizes) + heavy
    rows = [(k.to_bytes(4, "big"), int(b)) for k, b in enumerate([heavy, *sizes])]
    groups = spark.createDataFrame(rows, "digest binary, bytes bigint").repartition(4)
    got = {bytes(r.digest): r.shard for r in sharding.shard_of_groups(groups, parts, buckets, fan).collect()}
    assert set(got) == {d for d, _ in rows}
    load = collections.Counter()
    for digest, size in rows:
        load[got[digest]] += size
    assert len(load) == parts
    assert max(load.values()) <= max(heavy, total / parts * 1.01)
    others = [s for k, s in load.items() if k != got[rows[0][0]]] if heavy > total / parts else list(load.values())
    assert max(others) - min(others) <= total / parts * 0.01


def test_differencing_combines_the_widest_first():
    weights = np.array([[8], [7], [6], [5], [4]])
    partials = np.hstack([weights, np.zeros((5, 1), np.int64)])
    part = sharding.difference(partials, 2)[:, 0]
    sums = sorted(int(weights[part == p].sum()) for p in (0, 1))
    assert sums == [14, 16]  # the known outcome of differencing on this set


def graded_rows(n=400, seed=0):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for k in range(n):
        kind = k % 4
        text = prose(5000 + seed * n + k, int(rng.integers(30, 90)))
        if kind == 0:
            words = text.split()
            words[int(rng.integers(len(words)))] = str(rng.choice(["idiot", "Scum,", "moron."]))
            text = " ".join(words)
        elif kind == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((k, text))
        labels.append((k, int(kind > 1), int(kind == 0)))
    return docs, labels


LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_grades(spark):
    docs, labels = graded_rows()
    other, truth = graded_rows(seed=1)
    model = quality.fit(quality.graded(documents(spark, docs), spark.createDataFrame(labels, LABELS)), min_docs=3)
    scored = quality.score_texts(documents(spark, other).select("doc_id", "text"), model).collect()
    good = {i: q == 1 and t == 0 for i, q, t in truth}
    hits = [(r.tail_probs[-1] >= 0.5) == good[r.doc_id] for r in scored]
    assert np.mean(hits) >= 0.97
    assert all(abs(sum(r.tail_probs) - r.expected_grade) < 1e-9 and r.tail_probs[0] >= r.tail_probs[1] for r in scored)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    scores, grades, cuts = rng.normal(size=30), rng.integers(0, 3, 30), np.array([-0.4, 0.9])
    loss, by_score, by_cut = quality.loss_and_gradient(scores, grades, cuts)
    step = 1e-6
    for k in range(30):
        moved = scores.copy()
        moved[k] += step
        assert abs((quality.loss_and_gradient(moved, grades, cuts)[0] - loss) / step - by_score[k]) < 1e-4
    for k in range(2):
        moved = cuts.copy()
        moved[k] += step
        assert abs((quality.loss_and_gradient(scores, grades, moved)[0] - loss) / step - by_cut[k]) < 1e-3


def test_quality_of_awkward_rows(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], LABELS)
    assert {r.keep for r in quality.quality_report(docs, none).collect()} == {True}
    some = spark.createDataFrame([(0, 1, 0), (3, None, 0), (4, 1, None), (None, 1, 1), (5, 0, 1), (0, 1, 0), (999, 0, 0)], LABELS)
    got = quality.quality_report(docs, some)
    assert got.count() == len(texts()) and got.where(F.col("score").isNull()).count() == 0
    kept = quality.keep_good(docs, some)
    assert kept.columns == docs.columns and kept.count() <= len(texts())
    assert quality.quality_report(documents(spark, []), some).count() == 0
