import re

import pytest
from pyspark.sql import functions as F

from labelloom.functions import text, vectors

SAMPLES = ["<p>A <b>b</b></p>", " x  y\x1d z ", "", None, "a < b", "<a\nb>c", "\t　", "no tags."]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in df.orderBy("i").select(expression.alias("o")).collect()]


def test_clean_html(spark):
    want = [v and re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", v)).strip() for v in SAMPLES]
    assert column(spark, SAMPLES, text.clean_html("t")) == want


def test_strip(spark):
    assert column(spark, SAMPLES, text.strip("t")) == [v if v is None else v.strip() for v in SAMPLES]


def test_clean_jats(spark):
    values = ["<jats:p>a</jats:p>", " <jats:p> a", "a<jats:p>b</jats:p>c", None, "<jats:p><jats:p>x"]
    assert column(spark, values, text.clean_jats("t")) == ["a", "a", "a<jats:p>b</jats:p>c", None, "<jats:p>x"]


def test_ensure_punctuated(spark):
    values = ["a", "a.", "a?)", "a…\"", " b! ", "", "a.x", "a.\n", "(a)", "a.))"]
    assert column(spark, values, text.ensure_punctuated("t")) == ["a.", "a.", "a?)", "a…\"", "b!", "", "a.x.", "a.", "(a).", "a.))."]


def test_fulltext(spark):
    schema = "s array<struct<label:string,caption:string,title:string,contents:array<struct<tag:string,text:string>>>>"
    body = [
        (" Box ", "Title", "Intro", [("p", "one"), ("fn", "note"), ("list-item", "item!")]),
        ("Fig 1", None, "Abstract", [("p", " "), (None, "two.")]),
        ("", "", "", [("fn", "last?")]),
        (None, None, None, None),
    ]
    df = spark.createDataFrame([(body,), ([],)], schema)
    got = [r.o for r in df.select(text.assemble_fulltext("s").alias("o")).collect()]
    assert got == ["Box: Intro. one. - item! Fig 1. two.\n\nFootnotes:\n- note.\n- last?", ""]


def test_model_input(spark):
    df = spark.createDataFrame([("a", "t", None)], "a string, t string, k string")
    assert df.select(text.model_input_text("a", "t")).first()[0] == "t[SEP]a"
    assert df.select(text.model_input_text("a", "t", "k", strict=False)).first()[0] is None
    with pytest.raises(Exception, match="misses a required part"):
        df.select(text.model_input_text("a", "t", "k")).collect()


def test_families(spark):
    names = ["microsoft/BiomedNLP-BiomedBERT-base-uncased-abstract-fulltext", "x/BiomedBERT", "FacebookAI/roberta-base", "biobert_BCE_with_title", "svm"]
    assert column(spark, names, text.model_family("t")) == ["BiomedBERT-AF", "BiomedBERT-A", "RoBERTa", "BioBERT", "Other"]
    assert column(spark, names, text.model_abbreviation("t"))[3] == "BioBERT +BCE +T"


def test_token_counts(spark):
    values = ["The cat, the CAT sat; a été là", "", "x", "a-b cc"]
    def features(v):
        words = [w for w in re.findall(r"\b\w\w+\b", v.lower()) if w != "the"]
        grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        return {g: grams.count(g) for g in grams}
    got = column(spark, values, text.count_terms(text.token_features("t", ["the"])))
    assert [{c.term: c.tf for c in cells} for cells in got] == [features(v) for v in values]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r.c for r in df.select(vectors.cosine_similarity("a", "b").alias("c")).collect()]
    assert got == [pytest.approx(2**-0.5), 0.0]
    gate = vectors.paraphrase_gate(F.lit("new"), F.lit("old"), F.lit(0.85))
    assert df.select(gate).first()[0] == "new"
