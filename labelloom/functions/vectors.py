"""Vector expressions over array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine_similarity(a: Column | str, b: Column | str, eps: float = 1e-8) -> Column:
    """Cosine in double precision; each norm is kept at or above `eps`."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    floor = F.lit(eps)
    return _dot(a, b) / (F.greatest(F.sqrt(_dot(a, a)), floor) * F.greatest(F.sqrt(_dot(b, b)), floor))


def multi_hot(labels: Sequence[str]) -> Column:
    """0/1 columns as one vector in label order; a null counts as 0."""
    return F.array(*[F.coalesce(F.col(name).cast("int"), F.lit(0)) for name in labels])


def from_multi_hot(vector: Column | str, labels: Sequence[str]) -> list[Column]:
    """The 0/1 columns of a vector, named in label order; a shorter vector leaves the rest null."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return [F.get(vector, F.lit(i)).alias(name) for i, name in enumerate(labels)]


def paraphrase_gate(paraphrase: Column, original: Column, similarity: Column, threshold: float = 0.85) -> Column:
    """The paraphrase where it is close enough to the original, otherwise the original."""
    return F.when(similarity >= threshold, paraphrase).otherwise(original)
