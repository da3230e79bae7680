"""Scores and losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(logit: Column | str) -> Column:
    x = F.col(logit) if isinstance(logit, str) else logit
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(score: Column | str) -> Column:
    p = F.col(score) if isinstance(score, str) else score
    return F.log(p / (F.lit(1.0) - p))


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce(logit_: Column, y: Column, pos_weight: Column | float = 1.0) -> Column:
    """Binary cross entropy of one cell from its logit, positives weighted."""
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    return weight * y * softplus(-logit_) + (F.lit(1.0) - y) * softplus(logit_)


def focal(logit_: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Sigmoid focal loss of one cell (Lin et al. 2017); a negative alpha switches the balance off."""
    p = sigmoid(logit_)
    right = p * y + (F.lit(1.0) - p) * (F.lit(1.0) - y)
    loss = bce(logit_, y) * F.pow(F.lit(1.0) - right, F.lit(float(gamma)))
    if alpha < 0:
        return loss
    return loss * (F.lit(float(alpha)) * y + F.lit(1.0 - alpha) * (F.lit(1.0) - y))
