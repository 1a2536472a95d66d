"""Set-similarity metrics as Column expressions.

For a query of ``a`` grams, a value of ``b`` and an overlap ``i`` each metric
gives the sizes worth looking at, the least overlap, and the distance.  The
operand order is part of the contract: rounding up or down must fall alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest size that the overlap metric looks at.
MAX_SIZE = 32767


def _ceil(x: Column) -> Column:
    return F.ceil(x).cast("long")


def _double(x: Column) -> Column:
    return x.cast("double")


@dataclass(frozen=True)
class Metric:
    """Base class; subclass it for a metric of your own."""

    alpha: float = 1.0

    def __post_init__(self):
        if not 0 < self.alpha <= 1:
            raise ValueError("similarity must be in (0, 1]")

    def min_size(self, a: Column) -> Column:
        raise NotImplementedError

    def max_size(self, a: Column) -> Column:
        raise NotImplementedError

    def threshold(self, a: Column, b: Column) -> Column:
        raise NotImplementedError

    def distance(self, i: Column, a: Column, b: Column) -> Column:
        raise NotImplementedError

    def score(self, i: Column, a: Column, b: Column) -> Column:
        return F.lit(1.0) - self.distance(i, a, b)


class Jaccard(Metric):
    def min_size(self, a):
        return _ceil(F.lit(self.alpha) * _double(a))

    def max_size(self, a):
        return F.floor(_double(a) / F.lit(self.alpha)).cast("long")

    def threshold(self, a, b):
        return _ceil(F.lit(self.alpha) * _double(a + b) / F.lit(1 + self.alpha))

    def distance(self, i, a, b):
        return F.lit(1.0) - _double(i) / _double(a + b - i)


class Cosine(Metric):
    def min_size(self, a):
        return _ceil(F.lit(self.alpha * self.alpha) * _double(a))

    def max_size(self, a):
        return F.floor(_double(a) / F.lit(self.alpha * self.alpha)).cast("long")

    def threshold(self, a, b):
        return _ceil(F.lit(self.alpha) * F.sqrt(_double(a * b)))

    def distance(self, i, a, b):
        return F.lit(1.0) - _double(i) / F.sqrt(_double(a * b))


class Dice(Metric):
    def min_size(self, a):
        return _ceil(F.lit(self.alpha / (2 - self.alpha)) * _double(a))

    def max_size(self, a):
        return F.floor(F.lit((2 - self.alpha) / self.alpha) * _double(a)).cast("long")

    def threshold(self, a, b):
        return _ceil(F.lit(0.5 * self.alpha) * _double(a + b))

    def distance(self, i, a, b):
        return F.lit(1.0) - _double(i * 2) / _double(a + b)


class Overlap(Metric):
    def min_size(self, a):
        return F.lit(1).cast("long")

    def max_size(self, a):
        return F.lit(MAX_SIZE).cast("long")

    def threshold(self, a, b):
        return _ceil(F.lit(self.alpha) * _double(F.least(a, b)))

    def distance(self, i, a, b):
        return F.lit(1.0) - _double(i) / _double(F.least(a, b))


class Exact(Metric):
    def min_size(self, a):
        return a.cast("long")

    def max_size(self, a):
        return a.cast("long")

    def threshold(self, a, b):
        return a.cast("long")

    def distance(self, i, a, b):
        return F.lit(0.0)


METRICS = {"Jaccard": Jaccard, "Cosine": Cosine, "Dice": Dice, "Overlap": Overlap, "Exact": Exact}


def register(name: str, kind: type[Metric]) -> None:
    """Makes a metric of one's own known by name, to services and the HTTP front too."""
    METRICS[name] = kind


def metric(name: str, alpha: float) -> Metric:
    """A metric by its name (case matters) and least similarity."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; there are {', '.join(METRICS)}")
    if not isinstance(alpha, (int, float)) or math.isnan(alpha):
        raise ValueError("similarity must be a number")
    return METRICS[name](float(alpha))
