"""Landed API responses: parsing, request batches, outcomes and incremental storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import blank_to_null, clean_jats, normalize_id
from labelloom.operators.ordering import digest_positions, seeded_digest

RECORD_SCHEMA = (
    "message struct<abstract:string, `container-title`:array<string>, language:string, title:array<string>, "
    "author:array<struct<given:string, family:string>>>"
)
WORKS_SCHEMA = "results array<struct<id:string, doi:string, title:string, publication_year:int>>"
ARTICLES_TYPE = "array<struct<_id:string, document:struct<pmcid:string, title:string, abstract:string>>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def record_fields(payload: Column | str) -> Column:
    """Struct (abstract, journal, language, title) of a work record in JSON; blank or absent is null."""
    message = F.from_json(_col(payload), RECORD_SCHEMA)["message"]

    def head(field: str) -> Column:
        return F.get(message[field], 0)

    return F.struct(
        blank_to_null(clean_jats(message["abstract"])).alias("abstract"),
        head("container-title").alias("journal"),
        blank_to_null(message["language"]).alias("language"),
        head("title").alias("title"),
    )


def parse_api_record(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """One row of metadata per landed record."""
    return df.select(*keep, record_fields(payload).alias("__r")).select(*keep, "__r.*")


def authors_concat(authors: Column | str) -> Column:
    """`given family` of all authors, comma separated; null without authors."""
    return F.array_join(
        F.transform(
            _col(authors),
            lambda a: F.concat(F.coalesce(a["given"], F.lit("")), F.lit(" "), F.coalesce(a["family"], F.lit(""))),
        ),
        ", ",
    )


def parse_article_set(df: DataFrame, payload: str, field: str = "article_set") -> DataFrame:
    """One publication per article of a response; a response without articles gives none.

    `field` is the name of the article array in the responses of the service in use.
    """
    response = F.from_json(_col(payload), f"`{field}` {ARTICLES_TYPE}")
    articles = df.select(F.explode(response[field]).alias("a"))
    return articles.select(
        F.col("a._id").alias("pmid"),
        F.col("a.document.title").alias("title"),
        F.col("a.document.abstract").alias("abstract"),
        F.lit(None).cast("string").alias("fulltext"),
        F.col("a.document.pmcid").alias("pmcid"),
    )


def parse_works(df: DataFrame, payload: str) -> DataFrame:
    """One row per work of a batch response."""
    works = df.select(F.explode(F.from_json(_col(payload), WORKS_SCHEMA)["results"]).alias("w"))
    return works.select("w.*")


def request_batches(ids: DataFrame, column: str = "id", size: int = 50, separator: str = "|", seed: int = 0) -> DataFrame:
    """Ids in requests of `size`, one row per request: `(batch, n_ids, ids)`.

    Positions come from hash buckets, so ids are never sorted in a single task; a batch gathers at
    most `size` ids.
    """
    wanted = ids.select(normalize_id(column).alias("__id")).where("__id is not null").distinct()
    placed = digest_positions(wanted.withColumn("__digest", seeded_digest(seed, "__id")), "__digest", (), "__pos")
    batched = placed.select(F.expr(f"__pos div {int(size)}").alias("batch"), "__pos", "__id")
    grouped = batched.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("__pos", "__id"))).alias("__members"))
    return grouped.select(
        "batch", F.size("__members").alias("n_ids"), F.array_join(F.col("__members.__id"), separator).alias("ids")
    )


def fetch_outcome_report(requested: DataFrame, landed: DataFrame, key: str, by: str) -> DataFrame:
    """Requested, fetched and failed ids per group (batch, source, ...)."""
    got = landed.select(F.col(key)).distinct().withColumn("__got", F.lit(1))
    joined = requested.join(got, key, "left")
    return joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("requested"),
        F.count("__got").alias("fetched"),
        F.count_if(F.col("__got").isNull()).alias("failed"),
    )


def skip_existing(incoming: DataFrame, store: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Rows to write: only keys not stored yet, or all incoming rows when overwriting."""
    if overwrite:
        return incoming
    return incoming.join(store.select(key).distinct(), key, "left_anti")


def latest_wins(store: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Store after an overwrite: an incoming row replaces the stored row of its key."""
    kept = store.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def match_fetched_titles(works: DataFrame, corpus: DataFrame, corpus_title: str = "display_name") -> DataFrame:
    """Fetched works next to the corpus title of the same work id."""
    known = corpus.select(normalize_id("id").alias("__id"), F.col(corpus_title).alias("old_title"))
    fetched = works.withColumn("__id", normalize_id("id"))
    return fetched.join(known, "__id", "left").drop("__id")
