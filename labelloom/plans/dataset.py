"""The data-set build from raw inputs to stored folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators import corpus, folds
from labelloom.session import stage_table
from labelloom.sources import writers


@dataclass
class BuildSettings:
    labels: Sequence[str]
    n_folds: int = 5
    n_runs: int = 2
    seed: int = 42
    dev_percent: int = 30
    balance_coeff: int | None = None
    item_type: str = "journalArticle"


def unify(lists: DataFrame, background: DataFrame, labels: Sequence[str], item_type: str = "journalArticle") -> DataFrame:
    """Curated rows and background rows in one set with a 0/1 column per label and a `row_key`.

    `lists` is the reader's output with a `label` column; `background` is in the common shape and
    has its key. Curated rows, which come without one, are keyed by their content.
    """
    renamed = corpus.rename_positives(lists).withColumnsRenamed({"Item Type": "item_type", "Publication Year": "year"})
    articles = corpus.filter_doi_present(corpus.filter_item_type(renamed, item_type))
    positives = corpus.drop_full_duplicates(articles.drop("label"))
    content = F.sha2(F.to_json(F.struct(*sorted(positives.columns))), 256)
    keyed = positives.withColumn("row_key", F.concat(F.lit("list:"), content))
    return corpus.label_membership(corpus.union_sets(keyed, background), renamed.select("doi", "label"), labels)


def build_dataset(
    lists: DataFrame, raw_corpus: DataFrame, settings: BuildSettings, metadata: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(cleaned set with `row_key`, splits by `row_key`). Corpus ids must be unique.

    The cleaned set is staged as a table: the folds read its labels, the sink all of it. So are the lists, whose files
    several steps read whole, and the unified set, so that its texts are cleaned and matched once.
    """
    corpus.check_unique(raw_corpus, "id")
    if metadata is not None:
        names = {"DOI": "doi", "Title": "title", "Abstract Note": "abstract"}
        filled = corpus.enrich_metadata(lists.withColumnsRenamed(names), metadata).drop("updated_fields")
        lists = filled.withColumnsRenamed({new: old for old, new in names.items()})
    lists = stage_table(lists, "lists")
    background = corpus.delete_conflicts(raw_corpus, lists, drop=("author", "author_abbr", "topics"))
    unified = unify(lists, background.withColumnRenamed("id", "row_key"), settings.labels, settings.item_type)
    clean = corpus.clean_corpus(stage_table(unified, "unified"), "row_key", settings.labels)
    if settings.balance_coeff is not None:
        clean = corpus.undersample_negatives(clean, "row_key", settings.labels, settings.balance_coeff, settings.seed)
    clean = stage_table(clean, "cleaned")
    splits = folds.train_dev_test(
        clean, "row_key", settings.labels, settings.n_folds, settings.n_runs, settings.seed, settings.dev_percent
    )
    return clean, splits


def store_dataset(clean: DataFrame, splits: DataFrame, path: str) -> None:
    writers.write_cleaned(clean, f"{path}/cleaned")
    writers.write_folds(splits, f"{path}/folds")
