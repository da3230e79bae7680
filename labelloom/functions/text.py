"""Text and name expressions; null stays null unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode text defines it, with the ASCII separators.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set for patterns.
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Marks that end a sentence, optionally followed by a closing quote or bracket.
SENTENCE_END = r"""[.?!…]["')\]]?$"""
# Headers that carry no content of their own.
GENERIC_HEADERS = ("title", "abstract")

# Model-name fragments and the family they stand for; the first match wins.
MODEL_FAMILIES = (
    ("ensemble", "Ensemble"),
    ("roberta", "RoBERTa"),
    ("biomedbert-base-uncased-abstract-fulltext", "BiomedBERT-AF"),
    ("biomedbert", "BiomedBERT-A"),
    ("biobert", "BioBERT"),
    ("bert-base-uncased", "BERT"),
)
# Hub names and the short names used in result tables.
SHORT_NAMES = {
    "microsoft/BiomedNLP-BiomedBERT-base-uncased-abstract": "BiomedBERT-abs",
    "microsoft/BiomedNLP-BiomedBERT-base-uncased-abstract-fulltext": "BiomedBERT-abs-ft",
    "FacebookAI/roberta-base": "roberta-base",
    "dmis-lab/biobert-v1.1": "biobert-v1",
    "google-bert/bert-base-uncased": "bert-base",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Trim white space of every kind, not only blanks."""
    return F.btrim(_col(text), F.lit(WHITE_SPACE))


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(_col(text), F.lit(""))


def clean_html(text: Column | str) -> Column:
    """Drop tags, collapse white space to single blanks, trim."""
    bare = F.regexp_replace(_col(text), "<[^>]+>", "")
    return F.trim(F.regexp_replace(bare, f"{_SPACE}+", " "))


def clean_jats(text: Column | str) -> Column:
    """Drop one leading and one trailing JATS paragraph mark."""
    inner = F.regexp_replace(strip(text), "^<jats:p>", "")
    return strip(F.regexp_replace(inner, "</jats:p>$", ""))


def normalize_id(identifier: Column | str, prefix: str = "https://openalex.org/") -> Column:
    """Work id without its URL prefix; blank becomes null."""
    return blank_to_null(F.replace(_col(identifier), F.lit(prefix), F.lit("")))


def normalize_doi(doi: Column | str) -> Column:
    """Trimmed DOI; blank becomes null."""
    return blank_to_null(strip(doi))


def ensure_punctuated(text: Column | str) -> Column:
    """Trimmed text, closed with a full stop unless it already ends a sentence; blank stays blank."""
    bare = strip(text)
    # The pattern can only match the last two characters.
    closed = F.right(bare, F.lit(2)).rlike(SENTENCE_END)
    return F.when((bare == "") | closed, bare).otherwise(F.concat(bare, F.lit(".")))


def valid_header(text: Column | str) -> Column:
    """True for headers worth keeping: not blank and not generic."""
    lowered = F.lower(strip(text))
    return F.coalesce((lowered != "") & ~lowered.isin(*GENERIC_HEADERS), F.lit(False))


# Fixed values of the assembled layout.
BOX_MARK, FOOTNOTE_MARK = "Box:", "Footnotes:"


def assemble_fulltext(sections: Column | str) -> Column:
    """One text from `array<struct<label,caption,title,contents:array<struct<tag,text>>>>`.

    Boxed sections are marked, generic headers dropped, list items bulleted, every part closed with
    punctuation; footnotes are collected at the end.
    """
    nothing = F.array().cast("array<string>")

    def filled(value: Column) -> Column:
        return strip(F.coalesce(value, F.lit("")))

    def header(value: Column, skip_box: bool) -> Column:
        keep = valid_header(value)
        if skip_box:
            keep = keep & (F.lower(filled(value)) != "box")
        return F.when(keep, F.array(ensure_punctuated(value))).otherwise(nothing)

    def contents(section: Column) -> Column:
        present = F.coalesce(section["contents"], F.array().cast("array<struct<tag:string,text:string>>"))
        return F.filter(present, lambda c: filled(c["text"]) != "")

    def is_note(content: Column) -> Column:
        return F.coalesce(content["tag"], F.lit("")) == "fn"

    def body(content: Column) -> Column:
        text = ensure_punctuated(content["text"])
        return F.when(content["tag"] == "list-item", F.concat(F.lit("- "), text)).otherwise(text)

    def one(section: Column) -> Column:
        box = F.when(F.lower(filled(section["label"])) == "box", F.array(F.lit(BOX_MARK))).otherwise(nothing)
        parts = F.concat(
            box,
            header(section["label"], True),
            header(section["caption"], True),
            header(section["title"], False),
            F.transform(F.filter(contents(section), lambda c: ~is_note(c)), body),
        )
        return F.array_join(parts, " ")

    sections = _col(sections)
    main = F.array_join(F.filter(F.transform(sections, one), lambda t: t != ""), " ")
    notes = F.flatten(
        F.transform(
            sections, lambda s: F.transform(F.filter(contents(s), is_note), lambda c: F.concat(F.lit("- "), ensure_punctuated(c["text"])))
        )
    )
    tail = F.when(F.size(notes) > 0, F.concat(F.lit(f"\n\n{FOOTNOTE_MARK}\n"), F.array_join(notes, "\n"))).otherwise("")
    return F.concat(main, tail)


def model_input_text(
    abstract: Column | str,
    title: Column | str | None = None,
    keywords: Column | str | None = None,
    separator: str = "[SEP]",
    strict: bool = True,
) -> Column:
    """Model input from the parts in use: title, keywords and abstract, or abstract and keywords.

    A missing part is an error, or gives null with `strict=False` so that it can be quarantined.
    """
    if title is None:
        parts = [abstract, keywords] if keywords is not None else [abstract]
    else:
        parts = [title, abstract] if keywords is None else [title, keywords, abstract]
    parts = [_col(p) for p in parts]
    joined = F.concat_ws(separator, *parts)
    missing = parts[0].isNull()
    for part in parts[1:]:
        missing = missing | part.isNull()
    if strict:
        return F.when(missing, F.raise_error(F.lit("model input misses a required part")).cast("string")).otherwise(joined)
    return F.when(~missing, joined)


def short_name(model: Column | str) -> Column:
    """Result-table name of a hub model; unknown names pass through."""
    model = _col(model)
    picked = model
    for full, short in SHORT_NAMES.items():
        picked = F.when(model == full, short).otherwise(picked)
    return picked


def model_family(model: Column | str) -> Column:
    """Family of a model name."""
    lowered = F.lower(_col(model))
    chain = None
    for fragment, family in MODEL_FAMILIES:
        hit = F.contains(lowered, F.lit(fragment))
        chain = F.when(hit, family) if chain is None else chain.when(hit, family)
    return chain.otherwise("Other")


# Marks that result tables put behind a family, by what a run's name holds. Of the rows of one
# kind the first that fits counts.
RUN_MARKS = (
    ("loss", "BCE", " +BCE"),
    ("loss", "focal", " +FL"),
    ("title", "with_title", " +T"),
    ("negatives", "opt_neg-1000", " (N1k)"),
    ("negatives", "opt_neg-500", " (N500)"),
)


def model_abbreviation(run: Column | str) -> Column:
    """Family with the marks of its run; an attribute, never a key."""
    run = _col(run)
    marks = []
    for kind in dict.fromkeys(k for k, _, _ in RUN_MARKS):
        fits = [F.when(run.contains(part), F.lit(mark)) for k, part, mark in RUN_MARKS if k == kind]
        marks.append(F.coalesce(*fits, F.lit("")))
    return F.concat(model_family(run), *marks)


def config_label(model: Column | str, detail: Column | str) -> Column:
    """`model (detail)`, the name of a configuration in rankings."""
    return F.concat(_col(model), F.lit(" ("), _col(detail).cast("string"), F.lit(")"))


def path_part(name: Column | str) -> Column:
    """A name as one path element."""
    return F.translate(_col(name), "/", "_")


def fill_template(template: str, **values: Column | str) -> Column:
    """Text of a template with `{name}` slots filled from columns."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        slot, _, rest = rest.partition("}")
        pieces += [F.lit(before), _col(values[slot])]
    pieces.append(F.lit(rest))
    return F.concat(*pieces)


def prompt_text(template: str, text: Column | str, topic: Column | str | None = None) -> Column:
    """Prompt of a sample from a template of the caller with the slots `{text}` and, if given, `{topic}`."""
    return fill_template(template, text=text) if topic is None else fill_template(template, text=text, topic=topic)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column | str) -> Column:
    """Lower-case word tokens of two or more characters."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def token_features(text: Column | str, stop_words: Sequence[str] = (), bigrams: bool = True) -> Column:
    """Words without stop words, then the 2-grams of what is left."""
    kept = words(text)
    if stop_words:
        kept = F.filter(kept, lambda w: ~w.isin(*stop_words))
    if not bigrams:
        return kept

    def with_pairs(k: Column) -> Column:
        rest = F.greatest(F.size(k) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(k, 1, rest), F.slice(k, 2, rest), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(k, pairs)

    return let(kept, with_pairs)


def count_terms(tokens: Column) -> Column:
    """`array<struct<term, tf>>` of a token array: sorted, then cut where the term changes."""
    empty = F.array().cast("array<struct<term:string,tf:bigint>>")

    def cut(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def measure(st: Column) -> Column:
            ends = F.concat(F.slice(st, F.lit(2), F.size(st)), F.array(F.size(s)))
            return F.zip_with(st, ends, lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).cast("bigint").alias("tf")))

        return F.when(F.size(s) == 0, empty).otherwise(let(starts, measure))

    return let(F.sort_array(tokens), cut)
