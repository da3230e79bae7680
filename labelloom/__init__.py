"""Corpus labelling, fold assignment and evaluation as Spark DataFrame operators."""
