"""Sources and sinks: tables are written to the shared folder and read back; landed API records."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.operators import corpus as ops
from labelloom.operators import folds
from labelloom.session import staging_path
from labelloom.sources import key_index, readers, records, writers
from suite.adapters import (
    CORPUS, LABELS, POSITIVES, PUBS, SCORED, SCORED_MODELS, corpus, positives, pubs, scored, scored_models, table, texts, with_,
)
from suite.corpus_build import METADATA, _metadata, strip_sql
from suite.evaluation import FOLDS
from suite.registry import query, rounded

# --- sources ---------------------------------------------------------------------------------------


@query("scan_corpus", "SELECT doc_id, text, lang, source FROM documents")
def _(spark, sf):
    root = staging_path(spark, "corpus")
    docs = table(spark, sf, "documents")
    docs.where("lang = 'en'").drop("n_chars").write.parquet(f"{root}/a/en")
    docs.where("lang <> 'en'").drop("n_chars").write.parquet(f"{root}/b/c/other")
    return readers.scan_corpus(spark, root).select("doc_id", "text", "lang", "source")


def _positive_dirs(spark, sf):
    root = staging_path(spark, "positives")
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").join(labels, "doc_id")
    for name in LABELS:
        listed = docs.where(F.col(name) == 1).select(
            F.concat(F.lit("10.5555/"), "source", F.lit("."), "n_chars").alias("DOI"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("Title"),
            F.col("text").alias("Abstract Note"),
            F.col("lang").alias("Language"),
            F.lit("journalArticle").alias("Item Type"),
            F.when(F.col("source") == "src5", "n.d.").otherwise((2015 + F.col("n_chars") % 10).cast("string")).alias("Publication Year"),
        )
        writers.write_cleaned(listed, f"{root}/LIST {name}", as_csv=True)
    return root


POSITIVE_LISTS = """listed AS (SELECT concat('10.5555/', source, '.', n_chars) AS doi, text AS abstract, k.label,
    CASE WHEN source = 'src5' THEN 'n.d.' ELSE CAST(2015 + n_chars % 10 AS VARCHAR) END AS year
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id, (VALUES ('quality'), ('toxic')) k(label)
  WHERE CASE k.label WHEN 'quality' THEN quality ELSE toxic END = 1)"""


@query("scan_positive_csv", with_(POSITIVE_LISTS) + "SELECT label, doi, abstract, year FROM listed")
def _(spark, sf):
    rows = readers.scan_positive_csv(spark, _positive_dirs(spark, sf), "LIST")
    return rows.select("label", F.col("DOI").alias("doi"), F.col("Abstract Note").alias("abstract"), F.col("Publication Year").alias("year"))


@query(
    "cast_year",
    with_(POSITIVES)
    + "SELECT doi, TRY_CAST(year AS INTEGER) AS year, CASE WHEN TRY_CAST(year AS INTEGER) IS NULL THEN year END AS quarantined FROM positives",
)
def _(spark, sf):
    good, bad = readers.cast_year(positives(spark, sf))
    year = F.col("Publication Year")
    kept = good.select(F.col("DOI").alias("doi"), year.alias("year"), F.lit(None).cast("string").alias("quarantined"))
    return kept.unionByName(bad.select(F.col("DOI").alias("doi"), F.lit(None).cast("int").alias("year"), year.alias("quarantined")))


@query("scan_pmids", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS PMID FROM events")
def _(spark, sf):
    path = staging_path(spark, "ids")
    table(spark, sf, "events").select(F.col("user_id").alias("PMID")).write.option("header", "true").csv(path)
    return readers.scan_ids(spark, path)


@query(
    "scan_splits",
    """SELECT 'train' AS part, doc_id, text, lang FROM documents WHERE lang = 'en' UNION ALL SELECT 'test', doc_id, text, lang FROM documents WHERE lang <> 'en'""",
)
def _(spark, sf):
    root = staging_path(spark, "splits")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    writers.write_cleaned(docs.where("lang = 'en'"), f"{root}/processed_train", as_csv=True)
    writers.write_cleaned(docs.where("lang <> 'en'"), f"{root}/test", as_csv=True)
    train, test = readers.scan_splits(spark, root, docs.schema)
    return train.select(F.lit("train").alias("part"), "*").unionByName(test.select(F.lit("test").alias("part"), "*"))


@query(
    "scan_predictions",
    with_(SCORED_MODELS)
    + "SELECT doc_id, label, y, score, CONCAT('net-', model) AS model, 'BCE' AS loss_type, model = 'alpha' AS with_title, fold, 0 AS run FROM scored_models",
)
def _(spark, sf):
    root = staging_path(spark, "predictions")
    data = scored_models(spark, sf).select("doc_id", "label", "y", "score", "model", "fold")
    title = F.when(F.col("model") == "alpha", "_with_title").otherwise("")
    name = F.concat(F.lit("fold_"), "fold", F.lit("_net-"), "model", F.lit("_BCE"), title, F.lit("_run-0.csv"))
    data.withColumn("name", name).drop("model", "fold").write.partitionBy("name").option("header", "true").csv(root)
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("score", T.DoubleType())]
    )
    return readers.scan_predictions(spark, f"{root}/*", schema)


# --- sinks -----------------------------------------------------------------------------------------


@query("write_shards", "SELECT doc_id, lang, n_chars, 4 AS n_files FROM documents")
def _(spark, sf):
    path = staging_path(spark, "shards")
    writers.write_shards(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), path, 4)
    stored = spark.read.parquet(path)
    files = stored.select(F.col("_metadata.file_name").alias("f")).agg(F.countDistinct("f").cast("int").alias("n")).scalar()
    return stored.withColumn("n_files", files)


@query("write_cleaned", with_(PUBS) + "SELECT doc_id, doi, title, abstract FROM pubs WHERE title IS NOT NULL AND abstract IS NOT NULL AND doi IS NOT NULL")
def _(spark, sf):
    path = staging_path(spark, "cleaned")
    data = ops.filter_complete(pubs(spark, sf)).select("doc_id", "doi", "title", "abstract")
    writers.write_cleaned(data, path, as_csv=True)
    return spark.read.schema(data.schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def _stored_folds(spark, sf):
    path = staging_path(spark, "folds")
    writers.write_folds(folds.train_dev_test(pubs(spark, sf), "doc_id", LABELS, 5, 2, 42), path)
    return path


@query("write_folds", with_(PUBS, FOLDS) + "SELECT doc_id, run, fold, labelset, split FROM splits")
def _(spark, sf):
    return readers.read_folds(spark, _stored_folds(spark, sf)).select("doc_id", "run", "fold", "labelset", "split")


@query("read_folds", with_(PUBS, FOLDS) + "SELECT doc_id, split FROM splits WHERE run = 1 AND fold = 3")
def _(spark, sf):
    return readers.read_folds(spark, _stored_folds(spark, sf), run=1, fold=3).select("doc_id", "split")


@query("write_test_folds", with_(PUBS, FOLDS) + "SELECT p.doc_id, p.doi, s.run, s.fold FROM splits s JOIN pubs p ON p.doc_id = s.doc_id WHERE split = 'test'")
def _(spark, sf):
    path = staging_path(spark, "test-folds")
    data = pubs(spark, sf)
    splits = folds.train_dev_test(data, "doc_id", LABELS, 5, 2, 42)
    writers.write_test_folds(folds.test_folds(data.select("doc_id", "doi"), splits, "doc_id"), path)
    return spark.read.parquet(path).select("doc_id", "doi", "run", "fold")


@query(
    "append_metrics",
    with_(SCORED)
    + """SELECT fold, label, count(*) AS n, CAST(sum(pred) AS BIGINT) AS n_pred FROM scored WHERE fold < 3 GROUP BY fold, label
    UNION ALL SELECT fold, label, count(*), NULL FROM scored WHERE fold >= 3 GROUP BY fold, label""",
)
def _(spark, sf):
    path = staging_path(spark, "metrics")
    rows = scored(spark, sf).groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("pred").alias("n_pred"))
    writers.append_metrics(rows.where("fold >= 3").drop("n_pred"), path, ["fold"])
    for _ in range(2):  # a rerun replaces its own rows
        writers.append_metrics(rows.where("fold < 3"), path, ["fold"])
    return writers.committed(spark, path, ["fold"]).select("fold", "label", "n", "n_pred")


@query("write_predictions", with_(SCORED_MODELS) + "SELECT doc_id, label, y, pred, model, fold FROM scored_models")
def _(spark, sf):
    path = staging_path(spark, "predictions")
    data = scored_models(spark, sf).withColumns({"loss_type": F.lit("BCE"), "run": F.lit(0)})
    writers.write_predictions(data.where("fold <> 2"), path)
    # one fold on its own, and another one once more: the other folds stay
    writers.write_predictions(data.where("fold in (2, 3)"), path)
    return writers.committed(spark, path, ["model", "loss_type", "run", "fold"]).select("doc_id", "label", "y", "pred", "model", "fold")


@query(
    "wide_predictions",
    with_(SCORED)
    + ", ".join(
        ["SELECT doc_id, fold"]
        + [f"max(CASE WHEN label = '{n}' THEN {c} END) AS {n}_{s}" for n in LABELS for s, c in (("label", "y"), ("pred", "pred"), ("score", "round(score, 8)"))]
    )
    + " FROM scored GROUP BY doc_id, fold",
)
def _(spark, sf):
    wide = writers.wide_predictions(scored(spark, sf), ["doc_id", "fold"], LABELS)
    return rounded(wide, "quality_score", "toxic_score")


@query(
    "write_enrichment_audit",
    with_(PUBS, METADATA)
    + """SELECT doc_id, coalesce(nullif(p.title, ''), m.title) AS title, coalesce(nullif(p.abstract, ''), m.abstract) AS abstract,
      concat_ws(',', CASE WHEN nullif(p.title, '') IS NULL AND m.title IS NOT NULL THEN 'title' END,
                CASE WHEN nullif(p.abstract, '') IS NULL AND m.abstract IS NOT NULL THEN 'abstract' END) AS updated_fields
    FROM pubs p JOIN metadata m ON p.doi = m.doi WHERE nullif(p.title, '') IS NULL OR nullif(p.abstract, '') IS NULL""",
)
def _(spark, sf):
    path = staging_path(spark, "audit")
    enriched = ops.enrich_metadata(pubs(spark, sf).select("doc_id", "doi", "title", "abstract"), _metadata(spark, sf))
    writers.write_enrichment_audit(enriched, path, "doc_id")
    schema = "doc_id bigint, title string, abstract string, updated_fields string"
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


# --- landed records --------------------------------------------------------------------------------


def api_records(spark, sf):
    """Landed JSON per document; whole sources lack the abstract, the journal or the title."""
    source = F.col("source")
    message = F.struct(
        F.when(source != "src3", F.concat(F.lit("<jats:p>"), "text", F.lit("</jats:p>"))).alias("abstract"),
        F.when(source == "src4", F.array().cast("array<string>")).otherwise(F.array("source", F.lit("second"))).alias("container-title"),
        F.when(source == "src6", "").otherwise(F.col("lang")).alias("language"),
        F.when(source != "src8", F.array(F.split_part("text", F.lit("\n"), F.lit(1)))).alias("title"),
        F.array(
            F.struct(F.col("lang").alias("given"), F.col("source").alias("family")),
            F.struct(F.lit(None).cast("string").alias("given"), F.lit("Group").alias("family")),
        ).alias("author"),
    )
    return texts(spark, sf).select("doc_id", F.to_json(F.struct(message.alias("message"))).alias("payload"))


@query(
    "parse_api_record",
    f"""SELECT doc_id, CASE WHEN source <> 'src3' THEN nullif({strip_sql("text")}, '') END AS abstract, CASE WHEN source <> 'src4' THEN source END AS journal,
    CASE WHEN source <> 'src6' THEN lang END AS language, CASE WHEN source <> 'src8' THEN split_part(text, chr(10), 1) END AS title FROM documents""",
)
def _(spark, sf):
    return records.parse_api_record(api_records(spark, sf), "payload", "doc_id")


@query("authors_concat", "SELECT doc_id, concat(lang, ' ', source, ',  Group') AS authors FROM documents")
def _(spark, sf):
    message = F.from_json("payload", records.RECORD_SCHEMA)["message"]
    return api_records(spark, sf).select("doc_id", records.authors_concat(message["author"]).alias("authors"))


@query(
    "parse_article_set",
    """SELECT CAST(doc_id AS VARCHAR) AS pmid, split_part(text, chr(10), 1) AS title, text AS abstract, NULL::VARCHAR AS fulltext,
       CASE WHEN lang = 'en' THEN concat('PMC', doc_id) END AS pmcid FROM documents""",
)
def _(spark, sf):
    # Responses of up to a few documents each: those of one source and length.
    article = F.struct(
        F.col("doc_id").cast("string").alias("_id"),
        F.struct(
            F.when(F.col("lang") == "en", F.concat(F.lit("PMC"), "doc_id")).alias("pmcid"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.col("text").alias("abstract"),
        ).alias("document"),
    )
    responses = table(spark, sf, "documents").select(F.to_json(F.struct(F.array(article).alias("article_set"))).alias("payload"))
    return records.parse_article_set(responses, "payload")


@query(
    "request_batches",
    """WITH p AS (SELECT concat('W', doc_id) AS w, row_number() OVER (ORDER BY md5(concat('0-W', doc_id))) - 1 AS pos FROM documents)
    SELECT pos // 50 AS batch, CAST(count(*) AS INTEGER) AS n_ids, string_agg(w, '|' ORDER BY pos) AS ids FROM p GROUP BY 1""",
)
def _(spark, sf):
    return records.request_batches(corpus(spark, sf), "id", 50)


@query(
    "fetch_outcome_report",
    """SELECT source, count(*) AS requested, count(l.doc_id) AS fetched, count(*) - count(l.doc_id) AS failed
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""",
)
def _(spark, sf):
    return records.fetch_outcome_report(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id", "source")


@query("skip_existing", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return records.skip_existing(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


@query("store_lookup", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    """`skip_existing` against a stored table of many files by its key index; SQL as for the plain form."""
    path = staging_path(spark, "store")
    table(spark, sf, "labels").repartitionByRange(40, "doc_id").write.parquet(path)
    return key_index.not_stored(table(spark, sf, "documents").select("doc_id", "source"), path, "doc_id")


@query(
    "overwrite_existing",
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN source ELSE 'new' END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def _(spark, sf):
    incoming = table(spark, sf, "labels").select("doc_id", F.lit("new").alias("source"))
    return records.latest_wins(table(spark, sf, "documents").select("doc_id", "source"), incoming, "doc_id")


@query(
    "match_fetched_titles",
    with_(CORPUS) + "SELECT replace(c.id, 'https://openalex.org/', '') AS id, concat('New ', d.doc_id) AS title, c.display_name AS old_title FROM documents d JOIN corpus c ON c.id = concat('https://openalex.org/W', d.doc_id) WHERE lang = 'en'",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").where("lang = 'en'")
    work = F.struct(F.concat(F.lit("W"), "doc_id").alias("id"), F.concat(F.lit("New "), "doc_id").alias("title"))
    responses = docs.select(F.to_json(F.struct(F.array(work).alias("results"))).alias("payload"))
    matched = records.match_fetched_titles(records.parse_works(responses, "payload"), corpus(spark, sf))
    return matched.select("id", "title", "old_title")
