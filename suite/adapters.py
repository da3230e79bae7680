"""Views of the given tables in the shapes the operators expect, in Spark and as SQL text.

No given table holds nulls, so the views of publications blank some fields for whole sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.session import spread

LABELS = ("quality", "toxic")
MODELS = (("alpha", 7919), ("beta", 6271), ("gamma", 3571))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A text table for heavy per-row work, over all cores even if its file is one row group."""
    docs = table(spark, sf_dir, name)
    return spread(docs, docs.columns[0])


def pubs(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """One publication per document: doi, title, abstract, item type, year text and two labels."""
    docs = texts(spark, sf_dir) if heavy else table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("source") != "src7", F.concat_ws("", F.lit("10.5555/"), "source", F.lit("."), "n_chars")).alias("doi"),
        F.when(F.col("source") != "src11", F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
        F.when(F.col("source") != "src13", F.col("text")).alias("abstract"),
        F.when(F.col("source") == "src17", "book").otherwise("journalArticle").alias("item_type"),
        F.when(F.col("source") == "src5", "n.d.").otherwise((2015 + F.col("n_chars") % 10).cast("string")).alias("year"),
        "lang",
        F.coalesce("quality", F.lit(0)).alias("quality"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )


PUBS = r"""pubs AS (
  SELECT d.doc_id,
         CASE WHEN source <> 'src7' THEN concat('10.5555/', source, '.', n_chars) END AS doi,
         CASE WHEN source <> 'src11' THEN split_part(text, chr(10), 1) END AS title,
         CASE WHEN source <> 'src13' THEN text END AS abstract,
         CASE WHEN source = 'src17' THEN 'book' ELSE 'journalArticle' END AS item_type,
         CASE WHEN source = 'src5' THEN 'n.d.' ELSE CAST(2015 + n_chars % 10 AS VARCHAR) END AS year,
         lang,
         coalesce(quality, 0) AS quality,
         coalesce(toxic, 0) AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background corpus: every document, with a DOI as URL."""
    docs = texts(spark, sf_dir)
    return docs.select(
        F.concat(F.lit("https://openalex.org/W"), "doc_id").alias("id"),
        F.concat(F.lit("https://doi.org/10.5555/"), "source", F.lit("."), "n_chars").alias("doi"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("display_name"),
        F.when(F.col("source") != "src13", F.col("text")).alias("ab"),
        F.col("source").alias("author"),
        F.col("lang").alias("topics"),
    )


CORPUS = r"""corpus AS (
  SELECT concat('https://openalex.org/W', doc_id) AS id,
         concat('https://doi.org/10.5555/', source, '.', n_chars) AS doi,
         split_part(text, chr(10), 1) AS display_name,
         CASE WHEN source <> 'src13' THEN text END AS ab,
         source AS author, lang AS topics
  FROM documents)"""


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated list: documents labelled toxic, with a bare DOI."""
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return docs.join(toxic, "doc_id").select(
        F.concat(F.lit("10.5555/"), "source", F.lit("."), "n_chars").alias("DOI"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("Title"),
        F.col("text").alias("Abstract Note"),
        F.col("lang").alias("Language"),
        F.when(F.col("source") == "src17", "book").otherwise("journalArticle").alias("Item Type"),
        F.when(F.col("source") == "src5", "n.d.").otherwise((2015 + F.col("n_chars") % 10).cast("string")).alias("Publication Year"),
    )


POSITIVES = r"""positives AS (
  SELECT concat('10.5555/', source, '.', n_chars) AS doi,
         split_part(text, chr(10), 1) AS title, text AS abstract, lang,
         CASE WHEN source = 'src17' THEN 'book' ELSE 'journalArticle' END AS item_type,
         CASE WHEN source = 'src5' THEN 'n.d.' ELSE CAST(2015 + n_chars % 10 AS VARCHAR) END AS year
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1)"""


def scored_models(spark: SparkSession, sf_dir: str, models=MODELS) -> DataFrame:
    """Scores of several models for both labels of every document, with ties."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels")
    cells = F.array(
        *[
            F.struct(
                F.lit(model).alias("model"),
                F.lit(name).alias("label"),
                F.coalesce(F.col(name), F.lit(0)).cast("int").alias("y"),
                (F.col("doc_id") * factor + (k + 1) * 104729).alias("noise"),
            )
            for model, factor in models
            for k, name in enumerate(LABELS)
        ]
    )
    return (
        docs.join(labels, "doc_id", "left")
        .select("doc_id", (F.col("doc_id") % 5).cast("int").alias("fold"), F.inline(cells))
        .select(
            "doc_id", "fold", "model", "label", "y", ((40 * F.col("y") + F.col("noise") % 83) / F.lit(123.0)).alias("score")
        )
        .withColumn("pred", (F.col("score") > 0.5).cast("int"))
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_models(spark, sf_dir, MODELS[:1]).drop("model")


SCORED_MODELS = """scored_models AS (
  SELECT c.*, CASE WHEN score > 0.5e0 THEN 1 ELSE 0 END AS pred FROM (
    SELECT d.doc_id, CAST(d.doc_id % 5 AS INTEGER) AS fold, m.model, k.label,
           coalesce(CASE WHEN k.label = 'quality' THEN l.quality ELSE l.toxic END, 0) AS y,
           (40 * coalesce(CASE WHEN k.label = 'quality' THEN l.quality ELSE l.toxic END, 0)
            + (d.doc_id * m.factor + k.k * 104729) % 83) / 123.0e0 AS score
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id,
         (VALUES ('alpha', 7919), ('beta', 6271), ('gamma', 3571)) m(model, factor),
         (VALUES ('quality', 1), ('toxic', 2)) k(label, k)) c)"""

SCORED = SCORED_MODELS + """, scored AS (
  SELECT doc_id, fold, label, y, score, pred FROM scored_models WHERE model = 'alpha')"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows of experiments: one per model (event type), fold, loss and title flag.

    Values are sums of whole cents divided once, so they do not depend on the order of the rows.
    """
    events = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return (
        events.groupBy(
            F.col("event_type").alias("model"),
            (F.col("user_id") % 5).cast("int").alias("fold"),
            F.when(F.hour("ts") < 12, "BCE").otherwise("focal").alias("loss_type"),
            (F.dayofmonth("ts") % 2 == 0).alias("with_title"),
        )
        .agg(
            (F.sum(cents) / (F.lit(10000.0) * F.count(F.lit(1)))).alias("m_mean"),
            (F.count_if(F.col("value") > 50) / F.count(F.lit(1))).alias("m_high"),
            (F.count_if(F.col("value") < 20) / F.count(F.lit(1))).alias("m_low"),
            F.count(F.lit(1)).alias("n_events"),
        )
    )


RUNS = """runs AS (
  SELECT event_type AS model, CAST(user_id % 5 AS INTEGER) AS fold,
         CASE WHEN hour(ts) < 12 THEN 'BCE' ELSE 'focal' END AS loss_type,
         day(ts) % 2 = 0 AS with_title,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (10000.0e0 * count(*)) AS m_mean,
         CAST(count(*) FILTER (WHERE value > 50) AS DOUBLE) / count(*) AS m_high,
         CAST(count(*) FILTER (WHERE value < 20) AS DOUBLE) / count(*) AS m_low,
         count(*) AS n_events
  FROM events GROUP BY 1, 2, 3, 4)"""


def fold_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric value per model and fold."""
    events = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return events.groupBy(
        F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("int").alias("fold")
    ).agg((F.sum(cents) / (F.lit(10000.0) * F.count(F.lit(1)))).alias("value"))


FOLD_RUNS = """fold_runs AS (
  SELECT event_type AS model, CAST(user_id % 5 AS INTEGER) AS fold,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (10000.0e0 * count(*)) AS value
  FROM events GROUP BY 1, 2)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial log: one row per logged step; the trial is the user, the epoch the day."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("trial_id"),
        F.col("event_id").alias("iteration"),
        F.dayofmonth("ts").alias("epoch"),
        (F.col("user_id") % 5 / F.lit(5.0)).alias("alpha"),
        (F.col("user_id") % 7).alias("gamma"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("metric"),
    )


TRIALS = """trials AS (
  SELECT user_id AS trial_id, event_id AS iteration, CAST(day(ts) AS INTEGER) AS epoch,
         (user_id % 5) / 5.0e0 AS alpha, user_id % 7 AS gamma, event_type AS kind, value AS metric
  FROM events)"""


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
