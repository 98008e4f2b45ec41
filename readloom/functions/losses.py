"""Losses of a binary read classifier, and the learning-rate schedule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def cross_entropy(logit0: Column, logit1: Column, label: Column) -> Column:
    """-ln of the softmax of the label's logit."""
    return softplus(F.when(label == 1, logit0 - logit1).otherwise(logit1 - logit0))


def sigmoid_focal(logit: Column, target: Column, alpha: float = 0.1, gamma: float = 2.0) -> Column:
    """Binary cross-entropy times (1 - p_t)^gamma, weighted by alpha for targets and 1 - alpha for others;
    a negative alpha leaves the weight out."""
    p = 1 / (1 + F.exp(-logit))
    loss = softplus(-logit) * target + softplus(logit) * (1 - target)
    kept = p * target + (1 - p) * (1 - target)
    loss = loss * F.pow(1 - kept, F.lit(gamma))
    return loss if alpha < 0 else loss * (alpha * target + (1 - alpha) * (1 - target))


def reduced(loss: Column, how: str = "mean") -> Column:
    if how not in ("none", "mean", "sum"):
        raise ValueError("a reduction is none, mean or sum")
    return {"none": loss, "mean": F.avg(loss), "sum": F.sum(loss)}[how]


def rate_multiplier(step: Column, warmup: int, decrease: int, total: int) -> Column:
    """Rises over the warm-up, stays at 1, and falls to 0 at the total from `decrease` on."""
    falling = F.greatest(F.lit(0.0), (F.lit(total) - step) / float(max(1, total - decrease)))
    return F.when(step <= warmup, step / float(max(1, warmup))).when(step >= decrease, falling).otherwise(1.0)
