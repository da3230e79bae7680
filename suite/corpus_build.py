"""Corpus building: text cleaning, joins, conflicts, duplicates, balance, unions."""

from pyspark.sql import functions as F

from labelloom.functions import text, vectors
from labelloom.functions.vectors import cosine_similarity, paraphrase_gate
from labelloom.operators import corpus as ops
from labelloom.session import stage_table
from suite.adapters import CORPUS, LABELS, POSITIVES, PUBS, corpus, positives, pubs, table, texts, with_
from suite.registry import query, rounded

# The SQL engine's \s is ASCII only, so white space is spelled out.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
STRIP = "regexp_replace({0}, '^" + WS + "+|" + WS + "+$', '', 'g')"
CLEAN = r"trim(regexp_replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '" + WS + r"+', ' ', 'g'))"


def strip_sql(x):
    return STRIP.replace("{0}", x)


def clean_sql(x):
    return CLEAN.replace("{0}", x)


# --- scalar text functions -------------------------------------------------------------------------


@query("clean_html", f"SELECT page_id, {clean_sql('html')} AS clean FROM pages")
def _(spark, sf):
    return texts(spark, sf, "pages").select("page_id", text.clean_html("html").alias("clean"))


@query(
    "clean_jats",
    f"""SELECT doc_id, {strip_sql("text")} AS bare, {strip_sql("concat('<p>', text)")} AS other FROM documents""",
)
def _(spark, sf):
    wrapped = F.concat(F.lit(" <jats:p>"), "text", F.lit("</jats:p>\n"))
    return table(spark, sf, "documents").select(
        "doc_id", text.clean_jats(wrapped).alias("bare"), text.clean_jats(F.concat(F.lit("<p>"), "text")).alias("other")
    )


@query("normalize_ids", with_(CORPUS) + "SELECT replace(id, 'https://openalex.org/', '') AS work, doi FROM corpus")
def _(spark, sf):
    padded = F.concat(F.lit(" "), "doi", F.lit("\t"))
    return corpus(spark, sf).select(text.normalize_id("id").alias("work"), text.normalize_doi(padded).alias("doi"))


PUNCT = "CASE WHEN {0} = '' OR regexp_matches({0}, '[.?!…][\"'')\\]]?$') THEN {0} ELSE concat({0}, '.') END"


def punct_sql(x):
    return PUNCT.replace("{0}", x)


@query("ensure_punctuated", f"SELECT conv_id, turn, {punct_sql(strip_sql('text'))} AS closed FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.ensure_punctuated("text").alias("closed"))


@query(
    "valid_header",
    f"""SELECT doc_id, lower({strip_sql("h")}) <> '' AND lower({strip_sql("h")}) NOT IN ('title', 'abstract') AS valid FROM (
      SELECT doc_id, CASE lang WHEN 'de' THEN ' Title ' WHEN 'es' THEN 'ABSTRACT' WHEN 'fr' THEN '  ' ELSE split_part(text, ' ', 1) END AS h FROM documents)""",
)
def _(spark, sf):
    lang = F.col("lang")
    header = (
        F.when(lang == "de", " Title ").when(lang == "es", "ABSTRACT").when(lang == "fr", "  ").otherwise(F.split_part("text", F.lit(" "), F.lit(1)))
    )
    return table(spark, sf, "documents").select("doc_id", text.valid_header(header).alias("valid"))


def _sections(spark, sf):
    """Two sections per document: its own lines as contents, tags by line length."""
    docs = texts(spark, sf)
    lines = F.transform(
        F.split("text", "\n"),
        lambda x: F.struct(
            F.when(F.length(x) % 7 == 0, "fn").when(F.length(x) % 5 == 0, "list-item").otherwise("p").alias("tag"), x.alias("text")
        ),
    )
    first = F.struct(
        F.when(F.col("lang") == "de", "Box").otherwise("").alias("label"),
        F.col("source").alias("caption"),
        F.when(F.col("lang") == "fr", "Abstract").otherwise("Part one").alias("title"),
        lines.alias("contents"),
    )
    second = F.struct(
        F.lit("Fig. 1").alias("label"),
        F.when(F.col("lang") == "es", " Title").otherwise("").alias("caption"),
        F.lit("").alias("title"),
        F.array(F.struct(F.lit("p").alias("tag"), F.col("lang").alias("text"))).alias("contents"),
    )
    return docs.select("doc_id", F.array(first, second).alias("body_sections"))


def _fulltext_sql():
    line = strip_sql("x")
    # The tag depends on the untrimmed line, so both are carried.
    raw = f"list_filter(string_split(text, chr(10)), lambda x: {line} <> '')"
    closed = punct_sql(line)
    body = f"list_transform(list_filter(raw, lambda x: length(x) % 7 <> 0), lambda x: concat(CASE WHEN length(x) % 5 = 0 THEN '- ' ELSE '' END, {closed}))"
    notes = f"list_transform(list_filter(raw, lambda x: length(x) % 7 = 0), lambda x: concat('- ', {closed}))"
    return f"""WITH s AS (SELECT *, {raw} AS raw FROM documents),
    parts AS (SELECT doc_id, lang, list_concat(
        list_concat(CASE WHEN lang = 'de' THEN ['Box:'] ELSE [] END, [concat(source, '.')]),
        list_concat(CASE WHEN lang <> 'fr' THEN ['Part one.'] ELSE [] END, {body})) AS one, {notes} AS notes FROM s)
    SELECT doc_id, concat(array_to_string(one, ' '), ' Fig. 1. ', lang, '.',
      CASE WHEN len(notes) > 0 THEN concat(chr(10), chr(10), 'Footnotes:', chr(10), array_to_string(notes, chr(10))) ELSE '' END) AS fulltext FROM parts"""


@query("assemble_fulltext", _fulltext_sql())
def _(spark, sf):
    return _sections(spark, sf).select("doc_id", text.assemble_fulltext("body_sections").alias("fulltext"))


@query(
    "model_input_text",
    with_(PUBS)
    + """SELECT doc_id, abstract AS abs_only, title || '[SEP]' || abstract AS with_title, abstract || '[SEP]' || lang AS with_keywords,
         title || '[SEP]' || lang || '[SEP]' || abstract AS with_both FROM pubs""",
)
def _(spark, sf):
    return pubs(spark, sf).select(
        "doc_id",
        text.model_input_text("abstract", strict=False).alias("abs_only"),
        text.model_input_text("abstract", "title", strict=False).alias("with_title"),
        text.model_input_text("abstract", keywords="lang", strict=False).alias("with_keywords"),
        text.model_input_text("abstract", "title", "lang", strict=False).alias("with_both"),
    )


MODEL_NAME = """CASE source WHEN 'src0' THEN 'FacebookAI/roberta-base' WHEN 'src1' THEN 'dmis-lab/biobert-v1.1' WHEN 'src2' THEN 'google-bert/bert-base-uncased'
  WHEN 'src3' THEN 'microsoft/BiomedNLP-BiomedBERT-base-uncased-abstract' WHEN 'src4' THEN 'microsoft/BiomedNLP-BiomedBERT-base-uncased-abstract-fulltext'
  WHEN 'src5' THEN 'Ensemble' ELSE source END"""
MODELS_SQL = f"models AS (SELECT doc_id, {MODEL_NAME} AS m, concat({MODEL_NAME}, CASE WHEN lang = 'en' THEN '_BCE' ELSE '_focal_with_title' END, CASE WHEN n_chars > 2000 THEN '_opt_neg-500' ELSE '' END) AS run FROM documents)"
FAMILY = """CASE WHEN lower(m) LIKE '%ensemble%' THEN 'Ensemble' WHEN lower(m) LIKE '%roberta%' THEN 'RoBERTa'
  WHEN lower(m) LIKE '%biomedbert-base-uncased-abstract-fulltext%' THEN 'BiomedBERT-AF' WHEN lower(m) LIKE '%biomedbert%' THEN 'BiomedBERT-A'
  WHEN lower(m) LIKE '%biobert%' THEN 'BioBERT' WHEN lower(m) LIKE '%bert-base-uncased%' THEN 'BERT' ELSE 'Other' END"""


def _models(spark, sf):
    docs = table(spark, sf, "documents").withColumn("m", F.expr(MODEL_NAME))
    loss = F.when(F.col("lang") == "en", "_BCE").otherwise("_focal_with_title")
    return docs.select("doc_id", "m", F.concat("m", loss, F.when(F.col("n_chars") > 2000, "_opt_neg-500").otherwise("")).alias("run"))


@query(
    "model_family",
    with_(MODELS_SQL)
    + f"""SELECT doc_id, {FAMILY} AS family, CASE m WHEN 'FacebookAI/roberta-base' THEN 'roberta-base' WHEN 'dmis-lab/biobert-v1.1' THEN 'biobert-v1'
      WHEN 'google-bert/bert-base-uncased' THEN 'bert-base' WHEN 'microsoft/BiomedNLP-BiomedBERT-base-uncased-abstract' THEN 'BiomedBERT-abs'
      WHEN 'microsoft/BiomedNLP-BiomedBERT-base-uncased-abstract-fulltext' THEN 'BiomedBERT-abs-ft' ELSE m END AS short,
      concat({FAMILY}, CASE WHEN run LIKE '%BCE%' THEN ' +BCE' ELSE ' +FL' END, CASE WHEN run LIKE '%with_title%' THEN ' +T' ELSE '' END,
             CASE WHEN run LIKE '%opt_neg-500%' THEN ' (N500)' ELSE '' END) AS abbreviation FROM models""",
)
def _(spark, sf):
    return _models(spark, sf).select(
        "doc_id", text.model_family("m").alias("family"), text.short_name("m").alias("short"), text.model_abbreviation("run").alias("abbreviation")
    )


@query("config_label", with_(MODELS_SQL) + "SELECT doc_id, concat(m, ' (', run, ')') AS config, replace(m, '/', '_') AS path FROM models")
def _(spark, sf):
    return _models(spark, sf).select("doc_id", text.config_label("m", "run").alias("config"), text.path_part("m").alias("path"))


@query(
    "prompt_text",
    """SELECT doc_id, concat('Say it anew: <', text, '>') AS paraphrase, concat('On ', source, ', in the manner of', chr(10), text) AS writing
    FROM documents""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        text.prompt_text("Say it anew: <{text}>", "text").alias("paraphrase"),
        text.prompt_text("On {topic}, in the manner of\n{text}", "text", "source").alias("writing"),
    )


VECTOR_PAIRS = """pairs AS (SELECT a.vec_id, a.embedding AS o, b.embedding AS p, a.label AS lo, b.label AS lp
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
sims AS (SELECT vec_id, lo, lp, list_sum(list_transform(list_zip(o, p), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))
   / (sqrt(list_sum(list_transform(o, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(p, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS cosine FROM pairs)"""


def _pairs(spark, sf):
    vectors = table(spark, sf, "embeddings")
    original = vectors.select("vec_id", F.col("embedding").alias("original"), F.col("label").alias("label_original"))
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("paraphrase"), F.col("label").alias("label_paraphrase"))
    paired = ops.pair_paraphrases(original, following, "vec_id")
    return paired.withColumn("cosine", cosine_similarity("original", "paraphrase"))


@query("pair_paraphrases", with_(VECTOR_PAIRS) + "SELECT vec_id, lo AS label_original, lp AS label_paraphrase FROM pairs")
def _(spark, sf):
    return _pairs(spark, sf).select("vec_id", "label_original", "label_paraphrase")


@query("cosine_similarity", with_(VECTOR_PAIRS) + "SELECT vec_id, round(cosine, 8) AS cosine FROM sims")
def _(spark, sf):
    return rounded(_pairs(spark, sf).select("vec_id", "cosine"), "cosine")


@query("paraphrase_gate", with_(VECTOR_PAIRS) + "SELECT vec_id, CASE WHEN cosine >= 0.2e0 THEN lp ELSE lo END AS label FROM sims")
def _(spark, sf):
    gated = paraphrase_gate(F.col("label_paraphrase"), F.col("label_original"), F.col("cosine"), 0.2)
    return _pairs(spark, sf).select("vec_id", gated.alias("label"))


# --- projections and filters -----------------------------------------------------------------------


@query("rename_positives", with_(POSITIVES) + f'SELECT doi, {clean_sql("title")} AS title, {clean_sql("abstract")} AS abstract, item_type AS "Item Type", year AS "Publication Year" FROM positives')
def _(spark, sf):
    return ops.rename_positives(positives(spark, sf))


@query("rename_negatives", with_(CORPUS) + f"SELECT doi, {clean_sql('display_name')} AS title, {clean_sql('ab')} AS abstract FROM corpus")
def _(spark, sf):
    return ops.rename_negatives(corpus(spark, sf))


@query(
    "add_binary_label",
    with_(CORPUS, POSITIVES)
    + f"""SELECT doi, {clean_sql("title")} AS title, 1 AS labels FROM positives UNION ALL SELECT doi, {clean_sql("display_name")}, 0 FROM corpus""",
)
def _(spark, sf):
    pos = ops.rename_positives(positives(spark, sf)).select("doi", "title")
    neg = ops.rename_negatives(corpus(spark, sf)).select("doi", "title")
    return ops.add_binary_label(pos, neg)


@query("filter_item_type", with_(PUBS) + "SELECT doc_id, item_type FROM pubs WHERE item_type = 'journalArticle'")
def _(spark, sf):
    return ops.filter_item_type(pubs(spark, sf)).select("doc_id", "item_type")


@query("filter_doi_present", with_(PUBS) + "SELECT doc_id, doi FROM pubs WHERE doi IS NOT NULL")
def _(spark, sf):
    return ops.filter_doi_present(pubs(spark, sf)).select("doc_id", "doi")


@query("filter_complete", with_(PUBS) + "SELECT doc_id, doi, title FROM pubs WHERE title IS NOT NULL AND abstract IS NOT NULL AND doi IS NOT NULL")
def _(spark, sf):
    return ops.filter_complete(pubs(spark, sf)).select("doc_id", "doi", "title")


@query(
    "identify_missing_metadata",
    with_(PUBS) + "SELECT doc_id, doi FROM pubs WHERE doi IS NOT NULL AND (title IS NULL OR title = '' OR abstract IS NULL OR abstract = '')",
)
def _(spark, sf):
    return ops.identify_missing_metadata(pubs(spark, sf), "doc_id")


@query("is_pos", with_(PUBS) + "SELECT doc_id FROM pubs WHERE quality = 1 OR toxic = 1")
def _(spark, sf):
    return pubs(spark, sf).where(ops.any_positive(LABELS)).select("doc_id")


@query("is_neg", with_(PUBS) + "SELECT doc_id FROM pubs WHERE quality = 0 AND toxic = 0")
def _(spark, sf):
    return pubs(spark, sf).where(~ops.any_positive(LABELS)).select("doc_id")


@query("multi_hot", with_(PUBS) + "SELECT doc_id, concat('[', quality, ',', toxic, ']') AS vector, quality + toxic AS n_labels, toxic AS second FROM pubs")
def _(spark, sf):
    encoded = pubs(spark, sf).select("doc_id", vectors.multi_hot(LABELS).alias("v"))
    return encoded.select("doc_id", "v", *vectors.from_multi_hot("v", LABELS)).select(
        "doc_id",
        F.concat(F.lit("["), F.array_join(F.col("v").cast("array<string>"), ","), F.lit("]")).alias("vector"),
        sum((F.col(n) for n in LABELS), F.lit(0)).alias("n_labels"),
        F.col(LABELS[1]).alias("second"),
    )


@query(
    "eda_filters",
    with_(PUBS)
    + """, t AS (SELECT *, TRY_CAST(year AS INTEGER) AS y, item_type = 'journalArticle' AS art FROM pubs)
    SELECT count(*) FILTER (WHERE art AND doi IS NULL AND (title IS NOT NULL OR abstract IS NOT NULL)) AS no_doi_with_text,
           count(*) FILTER (WHERE art AND doi IS NOT NULL) AS article_with_doi,
           count(*) FILTER (WHERE art AND doi IS NOT NULL AND title IS NOT NULL AND abstract IS NOT NULL) AS complete,
           count(*) FILTER (WHERE art AND doi IS NOT NULL AND (title IS NULL OR abstract IS NULL)) AS doi_without_text,
           count(*) FILTER (WHERE art AND doi IS NOT NULL AND title IS NOT NULL AND abstract IS NOT NULL AND y >= 2021) AS recent FROM t""",
)
def _(spark, sf):
    return ops.eda_counts(pubs(spark, sf).withColumn("year", F.expr("try_cast(year as int)")))


@query("distinct_values", with_(PUBS) + "SELECT DISTINCT item_type FROM pubs")
def _(spark, sf):
    return ops.distinct_values(pubs(spark, sf), "item_type")


# --- joins -----------------------------------------------------------------------------------------

TEXT_ANTI = f"""kept AS (SELECT c.* FROM corpus c WHERE ab IS NOT NULL AND display_name IS NOT NULL
  AND {strip_sql("ab")} NOT IN (SELECT {strip_sql("abstract")} FROM positives) AND {strip_sql("display_name")} NOT IN (SELECT {strip_sql("title")} FROM positives))"""
SUFFIX = "SELECT DISTINCT c.id FROM {0} c JOIN positives p ON ends_with(c.doi, p.doi)"


@query("anti_join_positives", with_(CORPUS, POSITIVES, TEXT_ANTI) + "SELECT id, doi FROM kept")
def _(spark, sf):
    pairs = {"ab": "Abstract Note", "display_name": "Title"}
    return ops.anti_join_positives(corpus(spark, sf), positives(spark, sf), pairs).select("id", "doi")


@query("doi_suffix_anti_join", with_(CORPUS, POSITIVES) + f"SELECT id, doi FROM corpus WHERE id NOT IN ({SUFFIX.format('corpus')})")
def _(spark, sf):
    return ops.doi_suffix_anti_join(corpus(spark, sf), positives(spark, sf), "id", "doi", "DOI").select("id", "doi")


@query("doi_suffix_semi_join", with_(CORPUS, POSITIVES) + f"SELECT id, doi FROM corpus WHERE id IN ({SUFFIX.format('corpus')})")
def _(spark, sf):
    return ops.doi_suffix_semi_join(corpus(spark, sf), positives(spark, sf), "id", "doi", "DOI").select("id", "doi")


@query(
    "delete_conflicts",
    with_(CORPUS, POSITIVES, TEXT_ANTI)
    + f"SELECT doi, {clean_sql('display_name')} AS title, {clean_sql('ab')} AS abstract FROM kept WHERE id NOT IN ({SUFFIX.format('kept')})",
)
def _(spark, sf):
    return ops.delete_conflicts(corpus(spark, sf), positives(spark, sf))


LISTS = """lists AS (SELECT doi, label FROM pubs, (VALUES ('quality'), ('toxic')) v(label) WHERE CASE label WHEN 'quality' THEN quality ELSE toxic END = 1)"""


@query(
    "label_membership",
    with_(PUBS, LISTS)
    + """SELECT doc_id, doi, CASE WHEN doi IN (SELECT doi FROM lists WHERE label = 'quality' AND doi IS NOT NULL) THEN 1 ELSE 0 END AS quality,
         CASE WHEN doi IN (SELECT doi FROM lists WHERE label = 'toxic' AND doi IS NOT NULL) THEN 1 ELSE 0 END AS toxic FROM pubs""",
)
def _(spark, sf):
    data = pubs(spark, sf)
    lists = data.unpivot(["doi"], list(LABELS), "label", "flag").where("flag = 1").select("doi", "label")
    return ops.label_membership(data.select("doc_id", "doi"), lists, LABELS)


METADATA = f"""metadata AS (SELECT doi, max(title) AS title, max(abstract) AS abstract FROM (
  SELECT concat('10.5555/', source, '.', n_chars) AS doi, concat('T ', source, ' ', n_chars) AS title, concat('A ', source, ' ', n_chars) AS abstract
  FROM documents WHERE lang <> 'de') GROUP BY doi)"""


def _metadata(spark, sf):
    tail = F.concat(F.lit(" "), "source", F.lit(" "), "n_chars")
    return table(spark, sf, "documents").where("lang <> 'de'").select(
        F.concat(F.lit("10.5555/"), "source", F.lit("."), "n_chars").alias("doi"),
        F.concat(F.lit("T"), tail).alias("title"),
        F.concat(F.lit("A"), tail).alias("abstract"),
    )


@query(
    "enrich_metadata",
    with_(PUBS, METADATA)
    + """SELECT doc_id, p.doi, coalesce(nullif(p.title, ''), m.title, p.title) AS title, coalesce(nullif(p.abstract, ''), m.abstract, p.abstract) AS abstract,
      concat_ws(',', CASE WHEN nullif(p.title, '') IS NULL AND m.title IS NOT NULL THEN 'title' END,
                CASE WHEN nullif(p.abstract, '') IS NULL AND m.abstract IS NOT NULL THEN 'abstract' END) AS updated
    FROM pubs p LEFT JOIN metadata m ON p.doi = m.doi""",
)
def _(spark, sf):
    data = pubs(spark, sf).select("doc_id", "doi", "title", "abstract")
    enriched = ops.enrich_metadata(data, _metadata(spark, sf))
    return enriched.withColumn("updated", F.array_join("updated_fields", ",")).drop("updated_fields")


CONFLICTS = """conflicts AS (SELECT abstract FROM pubs WHERE abstract IS NOT NULL GROUP BY abstract
  HAVING max(greatest(quality, toxic)) = 1 AND min(greatest(quality, toxic)) = 0)"""


@query("conflict_semi", with_(PUBS, CONFLICTS) + "SELECT doc_id, quality, toxic FROM pubs WHERE abstract IN (SELECT abstract FROM conflicts)")
def _(spark, sf):
    return ops.conflict_semi(pubs(spark, sf), LABELS).select("doc_id", "quality", "toxic")


# Sequential scan in key order, the definition of greedy first-wins.
GREEDY = """ordered AS (SELECT doc_id, md5(abstract) AS t, md5(doi) AS d, row_number() OVER (ORDER BY doc_id) AS rn FROM {0}),
scan(rn, texts, dois, doc_id, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT), false
  UNION ALL
  SELECT o.rn, CASE WHEN list_contains(texts, o.t) OR list_contains(dois, o.d) THEN texts ELSE list_append(texts, o.t) END,
         CASE WHEN list_contains(texts, o.t) OR list_contains(dois, o.d) THEN dois ELSE list_append(dois, o.d) END,
         o.doc_id, NOT (list_contains(texts, o.t) OR list_contains(dois, o.d))
  FROM scan s JOIN ordered o ON o.rn = s.rn + 1)"""
# Short DOIs, shared by many documents, so that text and DOI conflicts interact.
CHAINED = """chained AS (SELECT doc_id, abstract, concat('10.5555/', (doc_id * 7919) % 613) AS doi FROM pubs WHERE abstract IS NOT NULL)"""


@query(
    "dedup_text_doi",
    with_(PUBS, CHAINED, GREEDY.format("chained")).replace("WITH", "WITH RECURSIVE", 1) + "SELECT doc_id FROM scan WHERE kept",
)
def _(spark, sf):
    chained = pubs(spark, sf).where("abstract is not null").withColumn(
        "doi", F.concat(F.lit("10.5555/"), (F.col("doc_id") * 7919) % 613)
    )
    return ops.dedup_text_doi(chained, "doc_id").select("doc_id")


@query(
    "dedup_two_pass",
    with_(PUBS)
    + """, a AS (SELECT * FROM pubs WHERE abstract IS NOT NULL AND doi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY abstract ORDER BY doc_id) = 1)
    SELECT doc_id FROM a QUALIFY row_number() OVER (PARTITION BY doi ORDER BY doc_id) = 1""",
)
def _(spark, sf):
    return ops.dedup_two_pass(pubs(spark, sf), "doc_id").select("doc_id")


CLEAN_ROWS = """clean_rows AS (SELECT * FROM pubs WHERE title IS NOT NULL AND abstract IS NOT NULL AND doi IS NOT NULL
  AND abstract NOT IN (SELECT abstract FROM conflicts))"""


@query(
    "clean_corpus",
    with_(PUBS, CONFLICTS, CLEAN_ROWS, GREEDY.format("clean_rows")).replace("WITH", "WITH RECURSIVE", 1)
    + "SELECT p.doc_id, p.doi, p.title, p.quality, p.toxic FROM scan s JOIN pubs p ON p.doc_id = s.doc_id WHERE kept",
)
def _(spark, sf):
    return ops.clean_corpus(pubs(spark, sf), "doc_id", LABELS).select("doc_id", "doi", "title", "quality", "toxic")


@query("drop_full_duplicates", "SELECT DISTINCT text, lang, source FROM documents")
def _(spark, sf):
    return ops.drop_full_duplicates(table(spark, sf, "documents").select("text", "lang", "source"))


# --- numbering and sampling ------------------------------------------------------------------------


@query(
    "undersample_negatives",
    with_(PUBS)
    + """, neg AS (SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY md5(concat('42-', doc_id))) AS rn FROM pubs WHERE quality = 0 AND toxic = 0)
    SELECT doc_id, quality, toxic FROM pubs WHERE quality = 1 OR toxic = 1
    UNION ALL SELECT doc_id, quality, toxic FROM neg WHERE rn <= (SELECT count(*) FROM pubs WHERE quality = 1 OR toxic = 1)""",
)
def _(spark, sf):
    return ops.undersample_negatives(pubs(spark, sf), "doc_id", LABELS, coeff=1).select("doc_id", "quality", "toxic")


@query("shuffle_seeded", "SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42-', doc_id))) - 1 AS shuffle_pos FROM documents")
def _(spark, sf):
    return ops.shuffle_positions(table(spark, sf, "documents").select("doc_id"), "doc_id", 42)


@query("row_index", "SELECT doc_id, row_number() OVER (ORDER BY md5(concat('0-', doc_id))) - 1 AS row_index FROM documents")
def _(spark, sf):
    return ops.row_index(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "cycle_sample",
    """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42-', doc_id))) - 1 AS pos, count(*) OVER () AS n FROM labels WHERE quality = 1)
    SELECT t.t * n + pos AS sample_id, doc_id FROM p, (VALUES (0), (1), (2)) t(t)""",
)
def _(spark, sf):
    positive = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return ops.cycle_sample(positive, "doc_id", 3).select("sample_id", "doc_id")


@query("first_n", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 1000")
def _(spark, sf):
    return ops.first_n(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 1000)


# --- unions and reports ----------------------------------------------------------------------------


@query(
    "union_sets",
    """SELECT doc_id, text, NULL::VARCHAR AS role, lang FROM documents UNION ALL SELECT conv_id, text, role, NULL FROM conversations
    UNION ALL SELECT item_id, text, NULL, NULL FROM benchmark""",
)
def _(spark, sf):
    return ops.union_sets(
        table(spark, sf, "documents").select("doc_id", "text", "lang"),
        table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "text", "role"),
        table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text"),
    )


@query(
    "augment_union",
    """SELECT d.doc_id, d.text, l.quality AS labels, NULL::VARCHAR AS domain FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    UNION ALL SELECT item_id, text, 1, 'pos' FROM benchmark""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    synthetic = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return ops.augment_union(docs.select("doc_id", "text", F.col("quality").alias("labels")), synthetic, "labels")


@query(
    "pipeline_counts",
    with_(PUBS)
    + """SELECT 'all' AS stage, count(*) AS n_rows FROM pubs UNION ALL SELECT 'article', count(*) FROM pubs WHERE item_type = 'journalArticle'
    UNION ALL SELECT 'complete', count(*) FROM pubs WHERE item_type = 'journalArticle' AND title IS NOT NULL AND abstract IS NOT NULL AND doi IS NOT NULL
    UNION ALL SELECT 'labelled', count(*) FROM pubs WHERE item_type = 'journalArticle' AND title IS NOT NULL AND abstract IS NOT NULL AND doi IS NOT NULL
        AND (quality = 1 OR toxic = 1)""",
)
def _(spark, sf):
    """Counts of a build's stages from the one job that writes its result."""
    seen = ops.StageCounts()
    rows = seen.mark("all", pubs(spark, sf))
    rows = seen.mark("article", ops.filter_item_type(rows))
    rows = seen.mark("complete", ops.filter_complete(rows))
    rows = seen.mark("labelled", rows.where(ops.any_positive(LABELS)))
    stage_table(rows, "labelled")
    return seen.counts(spark)


@query(
    "stage_counts",
    with_(PUBS, CONFLICTS)
    + """SELECT 'all' AS stage, count(*) AS n_rows FROM pubs UNION ALL SELECT 'article', count(*) FROM pubs WHERE item_type = 'journalArticle'
    UNION ALL SELECT 'complete', count(*) FROM pubs WHERE title IS NOT NULL AND abstract IS NOT NULL AND doi IS NOT NULL
    UNION ALL SELECT 'no_conflict', count(*) FROM pubs WHERE abstract IS NULL OR abstract NOT IN (SELECT abstract FROM conflicts)""",
)
def _(spark, sf):
    data = pubs(spark, sf)
    return ops.stage_counts(
        {
            "all": data,
            "article": ops.filter_item_type(data),
            "complete": ops.filter_complete(data),
            "no_conflict": ops.conflict_semi(data, LABELS, keep=False),
        }
    )
