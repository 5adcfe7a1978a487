"""Scores from three integers: a = |q AND x|, w = |x|, m = |q|.

``num``/``den`` are exact; the ranking key is one DOUBLE. Up to 65,536 bits the quotients of different
scores of one query differ by far more than rounding, and equal scores give the same double, so the key
orders exactly. Cosine is ranked by its square and is never compared across queries.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument

METRICS = ("dot", "hamming", "jaccard", "cosine")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise InvalidArgument(f"unknown metric {metric!r}")
    return metric


@dataclass(frozen=True)
class Score:
    """An exact score; ``square_root``: the square root of num/den."""

    num: int
    den: int
    square_root: bool = False

    @property
    def key(self) -> Fraction:
        return Fraction(self.num, self.den) if self.den else Fraction(0)

    def __float__(self) -> float:
        value = self.num / self.den if self.den else 0.0
        return value**0.5 if self.square_root else value


def _ratio(num: int, den: int, root: bool = False) -> Score:
    return Score(num, den, root) if den else Score(0, 1, root)


def score(metric: str, a: int, w: int, m: int) -> Score:
    if metric == "dot":
        return Score(a, 1)
    if metric == "hamming":
        return Score(2 * a - m - w, 1)
    if metric == "jaccard":
        return _ratio(a, m + w - a)
    return _ratio(a * a, m * w, True)


def hamming_distance(a: int, w: int, m: int) -> int:
    return m + w - 2 * a


def bound(metric: str, a: int, m: int, w_min: int = 0) -> Score:
    """Nothing with intersection ``a`` and weight of at least ``w_min`` scores more."""
    if metric == "dot":
        return Score(a, 1)
    if metric == "hamming":
        return Score(a - m, 1)
    if metric == "jaccard":
        return _ratio(a, max(m, m + w_min - min(a, w_min)))
    return _ratio(a * a, m * max(a, w_min, 1), True)


def least_intersection(metric: str, tau: Score, m: int, w_min: int = 0) -> int:
    """The least a whose bound reaches tau; m if none does."""
    if metric == "dot":
        return max(tau.num, 0)
    if metric == "hamming":
        return max(tau.num + m, 0)
    if not w_min:
        return -(-tau.num * m // tau.den) if tau.den else 0
    return next((a for a in range(m + 1) if bound(metric, a, m, w_min).key >= tau.key), m)


def weight_range(metric: str, tau: Score, m: int) -> tuple[int, int] | None:
    """Inclusive weights that can still reach tau; None where nothing is ruled out."""
    if metric == "dot":
        return (tau.num, 1 << 16) if tau.num > 0 else None
    if metric == "hamming":
        return max(0, m + tau.num), m - tau.num
    if tau.num <= 0:
        return None
    return -(-tau.num * m // tau.den), m * tau.den // tau.num


# -- columns -------------------------------------------------------------------


def num_den(metric: str, a: Column, w: Column, m: int) -> tuple[Column, Column]:
    a, w = a.cast("long"), w.cast("long")
    one = F.lit(1).cast("long")
    if metric == "dot":
        return a, one
    if metric == "hamming":
        return 2 * a - F.lit(m) - w, one
    if metric == "jaccard":
        den, num = F.lit(m) + w - a, a
    else:
        den, num = F.lit(m) * w, a * a
    return F.when(den == 0, 0).otherwise(num).cast("long"), F.when(den == 0, 1).otherwise(den).cast("long")


def key(num: Column, den: Column) -> Column:
    return num.cast("double") / den.cast("double")


def shown(metric: str, num: Column, den: Column) -> Column:
    return F.sqrt(key(num, den)) if metric == "cosine" else key(num, den)


def bound_columns(metric: str, a: Column, m: int, w_min: Column | int = 0) -> tuple[Column, Column]:
    a = a.cast("long")
    w_min = (F.lit(w_min) if isinstance(w_min, int) else w_min).cast("long")
    one = F.lit(1).cast("long")
    if metric == "dot":
        return a, one
    if metric == "hamming":
        return a - F.lit(m), one
    if metric == "jaccard":
        num, den = a, F.greatest(F.lit(m).cast("long"), F.lit(m) + w_min - F.least(a, w_min))
    else:
        num, den = a * a, F.lit(m) * F.greatest(a, w_min, one)
    return F.when(den == 0, 0).otherwise(num).cast("long"), F.when(den == 0, 1).otherwise(den).cast("long")
