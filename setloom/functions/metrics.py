"""Measures of two sets from their sizes and what they share. More can be registered by name."""

from __future__ import annotations

from collections.abc import Callable
from math import exp

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (common, size of the row's set, size of the column's set, k) -> value
Measure = Callable[[Column, Column, Column, int], Column]


def _over(part: Column, whole: Column) -> Column:
    """A quotient; null where the whole is empty."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def _mash(share: Column, k: int) -> Column:
    # + 0.0 turns a negative zero into zero
    return F.when(share == 0, F.lit(1.0)).otherwise(F.log(2 * share / (1 + share)) * (-1.0 / k) + F.lit(0.0))


def _jaccard(c: Column, a: Column, b: Column, k: int) -> Column:
    return _over(c, a + b - c)


def _in_smaller(c: Column, a: Column, b: Column, k: int) -> Column:
    return _over(c, F.least(a, b))


MEASURES: dict[str, Measure] = {
    "jaccard": _jaccard,
    "min": _in_smaller,
    "max": lambda c, a, b, k: _over(c, F.greatest(a, b)),
    "cosine": lambda c, a, b, k: _over(c, F.sqrt(a.cast("double") * b.cast("double"))),
    "mash": lambda c, a, b, k: _mash(_jaccard(c, a, b, k), k),
    "ani": lambda c, a, b, k: 1 - _mash(_jaccard(c, a, b, k), k),
    "ani-shorter": lambda c, a, b, k: 1 - _mash(_in_smaller(c, a, b, k), k),
    "mash-query": lambda c, a, b, k: _mash(_over(c, a), k),
    "num-kmers": lambda c, a, b, k: c.cast("double"),
}


#: Measures whose value is 0, or none, of any two sets that share nothing.
ZERO_APART = {"jaccard", "min", "max", "cosine", "ani", "ani-shorter", "num-kmers"}


def register(name: str, measure: Measure) -> None:
    ZERO_APART.discard(name)
    MEASURES[name] = measure


def measure(name: str, common: Column, row_count: Column, col_count: Column, k: int) -> Column:
    if name not in MEASURES:
        raise ValueError(f"unknown measure {name!r}; there are {', '.join(MEASURES)}")
    return MEASURES[name](common, row_count, col_count, k)


def rounded(value: Column, digits: int = 6) -> Column:
    """``F.round`` of a double, which makes a decimal number of every value; here only of those near the middle between two results,
    where the decimal digits decide, and of those too large for the plain way. All others are exact quotients either way."""
    scaled = value * F.lit(10.0**digits)
    clear = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-4)
    return F.when(clear, F.floor(scaled + 0.5) / F.lit(10.0**digits)).otherwise(F.round(value, digits))


def least_share(name: str, bound: float, k: int, upper: bool = False) -> float:
    """If pairs within a bound share at least some part of the larger set: which part; else 0.

    The smaller set then has that part of the larger one's words too, as it holds what they share. For the cosine,
    common >= t sqrt(ab) and common <= b give b >= t² a, and so common >= t² a. Mash distances, bounded from above, and
    identities are monotone in Jaccard.
    """
    if upper:
        return _jaccard_at(bound, k) if name == "mash" else 0.0
    if name in ("jaccard", "max"):
        return max(0.0, bound)
    if name == "cosine":
        return max(0.0, bound) ** 2
    return _jaccard_at(1 - bound, k) if name == "ani" and bound > 0 else 0.0


def _jaccard_at(mash: float, k: int) -> float:
    """The Jaccard similarity of a mash distance; of 1 and more, which sets without a common word have, 0."""
    x = exp(-k * mash)  # 2j / (1 + j)
    return x / (2 - x) if mash < 1 else 0.0
