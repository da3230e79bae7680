"""Building the labelled set: conflicts, membership, enrichment, de-duplication, balance, unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.functions.text import blank_to_null, clean_html, normalize_doi, strip
from labelloom.operators.ordering import digest_positions, seeded_digest
from labelloom.session import broadcast_if_small, cut_lineage

# Column names of the input lists.
POSITIVE_NAMES = {"DOI": "doi", "Title": "title", "Abstract Note": "abstract"}
# Column names of the input lists.
CORPUS_NAMES = {"display_name": "title", "ab": "abstract"}


def text_key(text: Column | str) -> Column:
    """Content digest that stands for a long text in joins and groups, so texts are not shuffled."""
    return F.unhex(F.sha2(F.col(text) if isinstance(text, str) else text, 256))


def any_positive(labels: Sequence[str]) -> Column:
    """True where at least one label is 1."""
    flags = [F.coalesce(F.col(name), F.lit(0)) == 1 for name in labels]
    return reduce(lambda a, b: a | b, flags)


# --- projections and filters -----------------------------------------------------------------------


def rename_positives(df: DataFrame, drop: Sequence[str] = ("Language",)) -> DataFrame:
    """Curated list in the common shape, title and abstract cleaned of tags."""
    renamed = df.withColumnsRenamed(POSITIVE_NAMES).drop(*drop)
    return renamed.withColumns({c: clean_html(c) for c in ("title", "abstract")})


def rename_negatives(df: DataFrame, drop: Sequence[str] = ("id", "author", "author_abbr", "topics")) -> DataFrame:
    """Background corpus in the common shape, title and abstract cleaned of tags."""
    renamed = df.withColumnsRenamed(CORPUS_NAMES).drop(*drop)
    return renamed.withColumns({c: clean_html(c) for c in ("title", "abstract")})


def add_binary_label(positives: DataFrame, negatives: DataFrame, label: str = "labels") -> DataFrame:
    """Union of both sides with 1 for positives and 0 for negatives."""
    return positives.withColumn(label, F.lit(1)).unionByName(
        negatives.withColumn(label, F.lit(0)), allowMissingColumns=True
    )


def union_sets(*sets: DataFrame) -> DataFrame:
    """Concatenation by name; columns a set lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)


def augment_union(original: DataFrame, synthetic: DataFrame, label: str, value: int = 1, domain: str = "pos") -> DataFrame:
    """Original rows and synthetic rows tagged with a label and a domain."""
    tagged = synthetic.withColumns({label: F.lit(value), "domain": F.lit(domain)})
    return original.unionByName(tagged, allowMissingColumns=True)


def filter_item_type(df: DataFrame, item_type: str = "journalArticle", column: str = "item_type") -> DataFrame:
    return df.where(F.col(column) == item_type)


def filter_doi_present(df: DataFrame, column: str = "doi") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def filter_complete(df: DataFrame, columns: Sequence[str] = ("title", "abstract", "doi")) -> DataFrame:
    return df.dropna(subset=list(columns))


def identify_missing_metadata(df: DataFrame, key: str) -> DataFrame:
    """(key, trimmed doi) of rows with a DOI but without a title or an abstract."""
    lacking = blank_to_null("title").isNull() | blank_to_null("abstract").isNull()
    return df.select(key, normalize_doi("doi").alias("doi"), lacking.alias("__lacking")).where(
        F.col("doi").isNotNull() & F.col("__lacking")
    ).drop("__lacking")


def drop_full_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


# --- positives against the corpus ------------------------------------------------------------------


def _digests(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(text_key(strip(column)).alias("__text")).distinct()


def anti_join_positives(
    corpus: DataFrame,
    positives: DataFrame,
    text_pairs: Mapping[str, str],
) -> DataFrame:
    """Corpus rows whose trimmed texts occur in no positive; rows with a null text are dropped.

    `text_pairs` maps corpus columns to positive columns. The pairs are unfolded to rows (pair, digest), so one
    equi-join finds the listed digests of the corpus, a set as small as the lists; rows that hold one go. The
    corpus passes that filter without a shuffle while the set can be broadcast.
    """
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in text_pairs])
    listed = reduce(
        DataFrame.union, [_digests(positives, p).select(F.lit(k).alias("__pair"), "__text") for k, p in enumerate(text_pairs.values())]
    )
    pairs = F.array(
        *[F.struct(F.lit(k).alias("pair"), text_key(strip(F.col(c))).alias("text")) for k, c in enumerate(text_pairs)]
    )
    digests = corpus.where(complete).select(F.inline(pairs))
    same = (F.col("pair") == F.col("__pair")) & (F.col("text") == F.col("__text"))
    found = broadcast_if_small(digests.join(broadcast_if_small(listed), same, "left_semi").distinct())
    kept = corpus.where(complete)
    for k, column in enumerate(text_pairs):
        gone = found.where(F.col("pair") == k).select(F.col("text").alias("__gone"))
        kept = kept.join(gone, text_key(strip(F.col(column))) == F.col("__gone"), "left_anti")
    return kept


def _suffix_matches(corpus: DataFrame, positives: DataFrame, key: str, doi: str, positive_doi: str) -> DataFrame:
    """Keys of corpus rows whose DOI ends with a listed DOI.

    A row has one blocking key, its last characters in the shortest listed length. A block holds the lengths
    of the listed DOIs that end in its key; only rows of a block go on, expanded to these lengths and
    matched by equality. Null keys and blank entries match nothing.
    """
    listed = positives.select(normalize_doi(positive_doi).alias("__suffix")).where("__suffix is not null").distinct()
    listed = cut_lineage(listed)
    shortest = listed.agg(F.coalesce(F.min(F.length("__suffix")), F.lit(1))).scalar()
    tail = lambda c: F.right(F.col(c), shortest).alias("__tail")
    # a block has at most as many lengths as the longest DOI has characters
    blocks = listed.groupBy(tail("__suffix")).agg(F.collect_set(F.length("__suffix")).alias("__lengths"))
    trimmed = corpus.select(key, normalize_doi(doi).alias("__doi")).where("__doi is not null").select("*", tail("__doi"))
    expanded = trimmed.join(broadcast_if_small(blocks), "__tail").withColumn("__len", F.explode("__lengths"))
    suffixes = expanded.where("__len <= length(__doi)").select(key, F.expr("right(__doi, __len)").alias("__suffix"))
    return suffixes.join(broadcast_if_small(listed), "__suffix", "left_semi").select(key).distinct()


def doi_suffix_anti_join(
    corpus: DataFrame, positives: DataFrame, key: str, doi: str = "doi", positive_doi: str = "doi"
) -> DataFrame:
    """Corpus rows with a DOI that ends with no listed DOI; rows without a DOI are dropped."""
    matched = broadcast_if_small(_suffix_matches(corpus, positives, key, doi, positive_doi))
    return corpus.where(F.col(doi).isNotNull()).join(matched, key, "left_anti")


def doi_suffix_semi_join(
    corpus: DataFrame, positives: DataFrame, key: str, doi: str = "doi", positive_doi: str = "doi"
) -> DataFrame:
    """Corpus rows with a DOI that ends with a listed DOI."""
    matched = broadcast_if_small(_suffix_matches(corpus, positives, key, doi, positive_doi))
    return corpus.join(matched, key, "left_semi")


def delete_conflicts(
    corpus: DataFrame,
    positives: DataFrame,
    key: str = "id",
    drop: Sequence[str] = ("id", "author", "author_abbr", "topics"),
) -> DataFrame:
    """Corpus rows that are no positive by abstract, title or DOI suffix, in the common shape."""
    # DOIs are matched first, on the raw corpus, so that this match reads two columns only; all the
    # anti-joins then run in one pass over the texts.
    kept = doi_suffix_anti_join(corpus, positives, key, "doi", "DOI")
    kept = anti_join_positives(kept, positives, {"ab": "Abstract Note", "display_name": "Title"})
    return rename_negatives(kept, drop)


def label_membership(df: DataFrame, lists: DataFrame, labels: Sequence[str], doi: str = "doi", label: str = "label") -> DataFrame:
    """0/1 flag per label: is the DOI in that label's list? Null DOIs belong to none.

    `lists` is long: (doi, label). It is reduced to one row per DOI first, so the join cannot fan out.
    """
    flags = lists.where(F.col(doi).isNotNull()).groupBy(doi).agg(
        *[F.max((F.col(label) == name).cast("int")).alias(name) for name in labels]
    )
    joined = df.join(broadcast_if_small(flags), doi, "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in labels})


def enrich_metadata(df: DataFrame, metadata: DataFrame, doi: str = "doi") -> DataFrame:
    """Missing titles and abstracts filled from landed metadata by DOI; nothing is overwritten.

    `metadata(doi, title, abstract)` may hold several rows per DOI; the fullest, then smallest, is
    taken. `updated_fields` names what was filled.
    """
    lacks = (blank_to_null("title").isNull() | blank_to_null("abstract").isNull()) & F.coalesce(normalize_doi(doi).isNotNull(), F.lit(False))
    open_rows = df.where(lacks).withColumn("__doi", normalize_doi(doi))
    found = (
        metadata.select(
            normalize_doi(doi).alias("__doi"),
            F.struct(
                blank_to_null("title").isNull().alias("no_title"),
                blank_to_null("abstract").isNull().alias("no_abstract"),
                blank_to_null("title").alias("title"),
                blank_to_null("abstract").alias("abstract"),
            ).alias("__found"),
        )
        .join(open_rows.select("__doi").distinct(), "__doi", "left_semi")
        .groupBy("__doi")
        .agg(F.min("__found").alias("__found"))
    )
    filled = {c: blank_to_null(c).isNull() & F.col(f"__found.{c}").isNotNull() for c in ("title", "abstract")}
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in filled.items()]))
    columns = [F.when(filled[c], F.col(f"__found.{c}")).otherwise(F.col(c)).alias(c) if c in filled else F.col(c) for c in df.columns]
    completed = open_rows.join(found, "__doi", "left").select(*columns, names.alias("updated_fields"))
    # Complete rows, nearly all of a corpus, and rows without a DOI pass without a shuffle.
    untouched = df.where(~lacks).withColumn("updated_fields", F.array().cast("array<string>"))
    return untouched.unionByName(completed)


# --- conflicts and duplicates ----------------------------------------------------------------------


def _conflicting(marked: DataFrame) -> DataFrame:
    """Digests that `marked(__t, __pos)` holds both with and without a positive label."""
    return (
        marked.where("__t is not null")
        .groupBy("__t")
        .agg(F.max("__pos").alias("__some"), F.min("__pos").alias("__all"))
        .where("__some and not __all")
        .select("__t")
    )


def conflict_texts(df: DataFrame, labels: Sequence[str], text: str = "abstract") -> DataFrame:
    """Digests `__t` of texts that occur both with and without a positive label."""
    return _conflicting(df.select(text_key(text).alias("__t"), any_positive(labels).alias("__pos")))


def conflict_semi(df: DataFrame, labels: Sequence[str], text: str = "abstract", keep: bool = True) -> DataFrame:
    """Rows whose text is in conflict (`keep=False`: the other rows)."""
    conflicts = broadcast_if_small(conflict_texts(df, labels, text))
    return df.join(conflicts, text_key(F.col(text)) == conflicts["__t"], "left_semi" if keep else "left_anti")


def _greedy_kept(keyed: DataFrame) -> DataFrame:
    """Keys kept by the greedy scan over `keyed(__key, __t, __d)`.

    In every round the rows that are first both in their text group and in their DOI group are kept,
    and the rows that share either with a kept row are dropped; undecided rows go on.
    """
    # Copies with equal text and DOI can never outlive the first of them.
    open_rows = cut_lineage(keyed.groupBy("__t", "__d").agg(F.min("__key").alias("__key")))
    kept_parts = [open_rows.select("__key").limit(0)]
    while not open_rows.isEmpty():
        first_text = open_rows.groupBy("__t").agg(F.min(F.struct("__key", "__d")).alias("__m")).select(
            "__t", "__m.__key", "__m.__d"
        )
        first_doi = open_rows.groupBy("__d").agg(F.min("__key").alias("__key"))
        kept = cut_lineage(first_text.join(first_doi, ["__d", "__key"], "left_semi"))
        kept_parts.append(kept.select("__key"))
        rest = open_rows.join(kept.select("__t"), "__t", "left_anti").join(kept.select("__d"), "__d", "left_anti")
        open_rows = cut_lineage(rest)
    return reduce(DataFrame.unionByName, kept_parts)


def _drop_others(df: DataFrame, key: str, keyed: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of `df` whose key is not among the dropped ones (`keyed` without `kept`).

    Keys are compared without texts to find those to drop, usually the smaller set: while it is
    small enough to broadcast, the wide rows are only filtered.
    """
    dropped = broadcast_if_small(keyed.select("__key").join(kept, "__key", "left_anti"))
    return df.join(dropped, df[key] == dropped["__key"], "left_anti")


def dedup_text_doi(df: DataFrame, key: str, text: str = "abstract", doi: str = "doi") -> DataFrame:
    """Greedy first-wins in key order: a row goes if a *kept* row has its text or its DOI.

    Exact: the rounds are the parallel form of the sequential scan, and few are needed. They work on
    (key, digest, digest) and never move a text. Rows lacking text or DOI are dropped. Keys must be
    unique.
    """
    complete = df.where(F.col(text).isNotNull() & F.col(doi).isNotNull())
    keyed = cut_lineage(
        complete.select(F.col(key).alias("__key"), text_key(text).alias("__t"), text_key(doi).alias("__d"))
    )
    return _drop_others(complete, key, keyed, _greedy_kept(keyed))


def dedup_two_pass(df: DataFrame, key: str, text: str = "abstract", doi: str = "doi") -> DataFrame:
    """Cheap form: first row per text, then first row per DOI among those.

    Differs from the greedy scan where a row loses its DOI to a row that itself would have lost its
    text, so it may keep fewer rows.
    """
    complete = df.where(F.col(text).isNotNull() & F.col(doi).isNotNull())
    keyed = complete.select(F.col(key).alias("__key"), text_key(text).alias("__t"), F.col(doi).alias("__d"))
    per_text = keyed.groupBy("__t").agg(F.min(F.struct("__key", "__d")).alias("__m")).select("__m.*")
    survivors = per_text.groupBy("__d").agg(F.min("__key").alias("__key")).select("__key")
    return _drop_others(complete, key, keyed, survivors)


def check_unique(df: DataFrame, key: str) -> None:
    """Raises if a key occurs twice; the operators above identify rows by their key."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    if not repeated.isEmpty():
        raise ValueError(f"{key} is not unique, drop full duplicates or choose another key")


def clean_corpus(df: DataFrame, key: str, labels: Sequence[str], text: str = "abstract", doi: str = "doi") -> DataFrame:
    """Complete rows without conflicts and without repeated texts or DOIs.

    The texts are read twice: once for a narrow table of keys, digests and flags, on which all
    decisions are made, and once to filter the rows. A text is in conflict if any row of the input
    says so, complete or not.
    """
    complete = F.col("title").isNotNull() & F.col(text).isNotNull() & F.col(doi).isNotNull()
    narrow = cut_lineage(
        df.select(
            F.col(key).alias("__key"),
            text_key(text).alias("__t"),
            text_key(doi).alias("__d"),
            any_positive(labels).alias("__pos"),
            complete.alias("__complete"),
        )
    )
    keyed = narrow.where("__complete").select("__key", "__t", "__d")
    candidates = keyed.join(_conflicting(narrow), "__t", "left_anti")
    return _drop_others(df.where(complete), key, keyed, _greedy_kept(candidates))


# --- sampling --------------------------------------------------------------------------------------


def seeded_cut(df: DataFrame, key: str, n: Column, seed: int, prefix: int = 5) -> DataFrame:
    """One row `(cut)`: the digest of the n-th row in the seeded shuffle order, null if all rows fit.

    Bucket counts locate the digest prefix in which the n-th row lies; only that bucket, a millionth
    of the rows, is sorted.
    """
    return _nth_digest(df.select(seeded_digest(seed, key).alias("__digest")), n, prefix)


def _nth_digest(digests: DataFrame, n: Column, prefix: int = 5) -> DataFrame:
    digests = digests.withColumn("__piece", F.substring("__digest", 1, prefix))
    # At most 16^prefix rows.
    upto = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = digests.groupBy("__piece").agg(F.count(F.lit(1)).alias("__n")).withColumn("__upto", F.sum("__n").over(upto))
    edge = buckets.where((F.col("__upto") >= n) & (F.col("__upto") - F.col("__n") < n)).select(
        "__piece", (n - F.col("__upto") + F.col("__n")).alias("__take")
    )
    in_edge = digests.join(F.broadcast(edge), "__piece")
    numbered = in_edge.withColumn("__rn", F.row_number().over(Window.partitionBy("__piece").orderBy("__digest")))
    return numbered.agg(F.max(F.when(F.col("__rn") == F.col("__take"), F.col("__digest"))).alias("cut"))


def undersample_negatives(df: DataFrame, key: str, labels: Sequence[str], coeff: int = 5, seed: int = 42) -> DataFrame:
    """All positives and `coeff` times as many negatives (or all there are), chosen by seeded digest.

    The input is read twice: once for a narrow table of digests and flags, from which both counts and the
    cut follow, and once for the sample `digest <= cut`, a filter inside the scan.
    """
    is_pos = any_positive(labels)
    narrow = cut_lineage(df.select(is_pos.alias("__pos"), seeded_digest(seed, key).alias("__digest")))
    positives, negatives = narrow.agg(F.count_if("__pos"), F.count_if(~F.col("__pos"))).first()
    if negatives <= positives * coeff:
        return df
    cut = _nth_digest(narrow.where(~F.col("__pos")).select("__digest"), F.lit(positives * coeff)).scalar()
    return df.where(is_pos | (seeded_digest(seed, key) <= cut))


def shuffle_positions(df: DataFrame, key: str, seed: int = 42, out: str = "shuffle_pos") -> DataFrame:
    """`(key, position)` of every row in a seeded shuffle that no partitioning can change.

    Only keys are numbered; join the result by key where other columns are wanted.
    """
    placed = df.select(key, seeded_digest(seed, key).alias("__digest"))
    return digest_positions(placed, "__digest", (), out).drop("__digest")


def row_index(df: DataFrame, key: str, out: str = "row_index") -> DataFrame:
    """`(key, row number)`: dense, repeatable and tied to the key (a DataFrame has no order of its own)."""
    return shuffle_positions(df, key, 0, out)


def cycle_sample(df: DataFrame, key: str, factor: int, seed: int = 42) -> DataFrame:
    """`(key, sample_id)` of `factor * n` samples that cycle over the n rows: sample i is row `i % n`."""
    size = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = shuffle_positions(df, key, seed, "__pos")
    turns = F.sequence(F.lit(0), F.lit(factor - 1))
    return placed.withColumn("__turn", F.explode(turns)).withColumn(
        "sample_id", (F.col("__turn") * size + F.col("__pos")).cast("bigint")
    ).drop("__turn", "__pos")


def first_n(df: DataFrame, key: str, n: int = 1000) -> DataFrame:
    """The first n rows by key (top-n per task, then a merge)."""
    return df.orderBy(key).limit(n)


# --- reports ---------------------------------------------------------------------------------------


def stage_counts(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every stage of a build, one aggregate each."""
    counted = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows") for name, df in stages.items()]
    return reduce(DataFrame.unionByName, counted)


class StageCounts:
    """Row counts of the stages of a build, observed while its one job runs.

    `mark` passes a stage on and counts what goes through it; `counts` is known once the job that the marks are
    part of has ended. Nothing is read again for the counts. A stage that is computed twice, in two jobs or
    after an executor was lost, is reported by the first complete run.
    """

    def __init__(self):
        self.observed: dict[str, Observation] = {}

    def mark(self, name: str, df: DataFrame) -> DataFrame:
        if name in self.observed:
            raise ValueError(f"stage {name} is marked twice")
        self.observed[name] = Observation(f"stage-{name}")
        return df.observe(self.observed[name], F.count(F.lit(1)).alias("n_rows"))

    def counts(self, spark: SparkSession) -> DataFrame:
        rows = [(name, int(seen.get["n_rows"])) for name, seen in self.observed.items()]
        return spark.createDataFrame(rows, "stage string, n_rows bigint")


def eda_counts(df: DataFrame, recent: int = 2021) -> DataFrame:
    """Null and recency counts of a curated list in one scan (year as int)."""
    article = F.col("item_type") == "journalArticle"
    has = {c: F.col(c).isNotNull() for c in ("doi", "title", "abstract")}
    complete = article & has["doi"] & has["title"] & has["abstract"]
    return df.agg(
        F.count_if(article & ~has["doi"] & (has["title"] | has["abstract"])).alias("no_doi_with_text"),
        F.count_if(article & has["doi"]).alias("article_with_doi"),
        F.count_if(complete).alias("complete"),
        F.count_if(article & has["doi"] & ~(has["title"] & has["abstract"])).alias("doi_without_text"),
        F.count_if(complete & (F.col("year") >= recent)).alias("recent"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def pair_paraphrases(original: DataFrame, paraphrased: DataFrame, key: str) -> DataFrame:
    """Original and paraphrase side by side, matched on the key."""
    return original.join(paraphrased, key)
