"""Central moments as aggregate columns."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = sys.float_info.epsilon
NAN = float("nan")


def moment(x: Column, order: int, mean: float | Column | None = None) -> Column:
    """The moment of an order about a mean: given, a constant of the group, or the group's own if None (then one pass is
    enough; beyond order 4 raw moments are expanded, which loses digits where the spread is small beside the mean). No rows: NaN.
    Order 0 is 1; order 1 about the own mean 0."""
    if order < 0:
        raise ValueError("the order must not be negative")
    some = F.count(x) > 0
    if order == 0:
        return F.when(some, 1.0).otherwise(NAN)
    if mean is None:
        if order == 1:
            return F.when(some, 0.0).otherwise(NAN)
        own = {1: None, 2: F.var_pop(x), 3: F.skewness(x) * F.pow(F.var_pop(x), 1.5), 4: (F.kurtosis(x) + 3) * F.pow(F.var_pop(x), 2)}.get(order)
        if own is None:
            own = sum((math.comb(order, k) * F.avg(F.pow(x, F.lit(k))) * F.pow(-F.avg(x), F.lit(order - k)) for k in range(order + 1)), F.lit(0.0))
        return F.when(some, F.when(F.var_pop(x) == 0, 0.0).otherwise(own)).otherwise(NAN)
    centre = F.lit(mean) if isinstance(mean, (int, float)) else mean
    return F.when(some, F.avg(F.pow(x - centre, F.lit(order)))).otherwise(NAN)


def skewness_about(x: Column, mean: float) -> Column:
    """Squared skewness about a fixed mean; NaN where the second moment is lost in rounding."""
    m2, m3 = moment(x, 2, mean), moment(x, 3, mean)
    return F.when(m2 <= (EPSILON * mean) ** 2, NAN).otherwise(F.pow(m3 / F.pow(m2, 1.5), 2))
