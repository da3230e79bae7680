"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelloom.llm import (
    centroids,
    decontaminate,
    ngram_join,
    piece_codec,
    prefix_trie,
    quality,
    secrets,
    sharding,
    suffix_dedup,
    tensor_minhash,
    token_counts,
    topk,
    warc,
)
from labelloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_piece_codec")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_codec.model_bytes(tokenizer_path("piece_bpe_32k.model"))
    return piece_codec.encoded_digests(table(spark, sf_dir, "documents"), model)


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op4_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0
    ), r AS (
        SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


@query(
    "op6_decontaminate",
    r"""
    WITH dw AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), iw AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), windows AS (
        SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
    ), sizes AS (SELECT DISTINCT size FROM windows),
    places AS (
        SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw CROSS JOIN sizes WHERE len(w) >= size)
    ), found AS (SELECT doc_id, item_id, size, i FROM places JOIN windows USING (size, words)),
    hits AS (
        SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id
    ), items AS (
        SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
        FROM found GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_near_matches")
def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and near matches: the columns of the SQL above and `n_near`, `near_items`."""
    return decontaminate.near_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_secrets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query(
    "op8_warc",
    """
    WITH p AS (
        SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
    ), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN first <> page_id THEN first END AS refers_to, TRUE AS valid
    FROM p LEFT JOIN f USING (payload_digest)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("word_bpe_49k.json"), "rb") as file:
        data = file.read()
    return token_counts.over_limit(table(spark, sf_dir, "documents"), data)


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


SIMILAR_SQL = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + least({n}, len(w)) - 1], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
    r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.x, r.root FROM r JOIN l ON l.y = r.doc_id),
    m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id{more} FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
    """


@query("op2_ngram_join", SIMILAR_SQL.format(n=3, percent=90, more=""))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


@query("op13_tensor_minhash", SIMILAR_SQL.format(n=2, percent=80, more=", d.doc_id = component_id AS kept"))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op5_suffix_dedup",
    """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
    p AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM t)),
    f AS (SELECT g, min(doc_id) AS first FROM p GROUP BY g HAVING count(*) > 1),
    hit AS (SELECT doc_id, p FROM p JOIN f USING (g) WHERE first < doc_id),
    gaps AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM hit),
    runs AS (SELECT doc_id, p, count(*) FILTER (gap IS NULL OR gap > 50) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM gaps),
    spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run),
    around AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
    cut AS (
        SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
            string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
        FROM around JOIN t USING (doc_id) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
        CASE WHEN last IS NULL THEN sha256(text) ELSE sha256(unhex(head || substr(h, 2 * last + 1))) END AS kept_sha256
    FROM t LEFT JOIN cut USING (doc_id)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def _crc32_sql(column: str) -> str:
    """Unsigned CRC-32 of a number's decimal digits; its table for half bytes follows from the polynomial."""
    table = []
    for entry in range(16):
        for _ in range(4):
            entry = entry >> 1 ^ (0xEDB88320 if entry & 1 else 0)
        table.append(entry)
    halves = (
        f"flatten(list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda d: [CAST(ascii(d) & 15 AS BIGINT), CAST(ascii(d) >> 4 AS BIGINT)]))"
    )
    step = f"xor(crc >> 4, CAST({table} AS BIGINT[])[1 + (xor(crc, half) & 15)])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {halves}), lambda crc, half: {step}), CAST(4294967295 AS BIGINT))"


@query(
    "op11_prefix_trie",
    rf"""
    WITH t AS (
        SELECT conv_id AS c, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS name,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL
    ), own AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, name) AS i, name, words FROM t),
    ids AS (SELECT c, c - c % 20 AS head, {_crc32_sql("c")} % 4 AS h FROM (SELECT DISTINCT c FROM own)),
    rebuilt AS (
        SELECT ids.c, i, 0 AS part, name, words FROM ids JOIN own ON own.c = head AND i <= h
        UNION ALL SELECT ids.c, i, 1, name, words FROM ids JOIN own ON own.c = ids.c AND i > h
    ), paths AS (
        SELECT ids.c, coalesce(list(name ORDER BY part, i) FILTER (name IS NOT NULL), []) AS names, list(words ORDER BY part, i) AS words
        FROM ids LEFT JOIN rebuilt USING (c) GROUP BY ids.c
    ), prefixes AS (
        SELECT c, d, array_to_string(names[1:d], '') AS node, array_to_string(names[1:d - 1], '') AS above, len(names) = d AS ends,
            CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words
        FROM (SELECT *, unnest(range(0, len(names) + 1)) AS d FROM paths)
    ), nodes AS (
        SELECT node, min(c) AS conv_id, d AS depth, any_value(above) AS above, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
            sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
        FROM prefixes GROUP BY node, d
    ), children AS (SELECT above AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
    marked AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (node, depth)),
    totals AS (
        SELECT a.node, a.depth, CAST(count(*) FILTER (b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens
        FROM marked a JOIN marked b ON b.depth >= a.depth AND starts_with(b.node, a.node) GROUP BY ALL
    )
    SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
    FROM marked m JOIN totals USING (node, depth) LEFT JOIN nodes p ON m.depth > 0 AND p.depth = m.depth - 1 AND p.node = m.above
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_report(table(spark, sf_dir, "conversations"))


def _lloyd_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """Ten rounds over (vector, dimension) rows, one pair of steps each."""
    steps = [
        f"""v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        f"x AS MATERIALIZED (SELECT r, unnest(range(1, {dims + 1})) AS d, unnest(x) AS x FROM v)",
        f"""f AS (SELECT r, row_number() OVER (ORDER BY sha256(concat('{seed}:', vec_id))) - 1 AS k FROM v
            QUALIFY k < {k})""",
        "c0 AS MATERIALIZED (SELECT k, d, x AS c FROM f JOIN x USING (r))",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (
                SELECT r, arg_min(k, (s, k)) AS k, min(s) AS s
                FROM (SELECT r, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS s FROM x JOIN c{n} USING (d) GROUP BY r, k) GROUP BY r
            )"""
        )
        if n < rounds:
            steps.append(
                f"""c{n + 1} AS MATERIALIZED (
                    SELECT k, d, coalesce(m, c) AS c FROM c{n}
                    LEFT JOIN (SELECT k, d, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM a{n} JOIN x USING (r) GROUP BY k, d) USING (k, d)
                )"""
            )
    return f"""
    WITH {", ".join(steps)},
    h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
    SELECT vec_id, CAST(k AS INTEGER) AS cluster, s AS distance, CAST(sum(s) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
        CAST(sum(s) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM a{rounds} JOIN v USING (r) JOIN h USING (k)
    """


@query("op12_centroid_clusters", _lloyd_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))
