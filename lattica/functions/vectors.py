"""Arithmetic and comparisons of three-component vectors, given as columns or numbers per axis.

Comparisons hold only if they hold on every axis, so neither of two vectors need be the smaller one.
A null component makes the result null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spatial import DIGITS, _lits, all_of

Vector = Sequence[Column | float]


def _each(f: Callable[[Column, Column], Column]):
    def run(a: Vector, b: Vector | float | Column) -> list[Column]:
        other = list(b) if isinstance(b, (list, tuple)) else [b] * len(a)
        return [f(x, y) for x, y in zip(_lits(a), _lits(other))]

    return run


add = _each(lambda a, b: a + b)
subtract = _each(lambda a, b: a - b)
multiply = _each(lambda a, b: a * b)
divide = _each(lambda a, b: F.try_divide(a, b))
floor_divide = _each(lambda a, b: F.floor(F.try_divide(a, b)))
modulo = _each(lambda a, b: a - b * F.floor(F.try_divide(a, b)))
power = _each(lambda a, b: F.pow(a, b))


def less(a: Vector, b: Vector) -> Column:
    return all_of(x < y for x, y in zip(_lits(a), _lits(b)))


def less_equal(a: Vector, b: Vector) -> Column:
    return all_of(x <= y for x, y in zip(_lits(a), _lits(b)))


def close(a: Vector, b: Vector, relative: float = 1e-5, absolute: float = 1e-8) -> list[Column]:
    """Per axis, whether two components differ by no more than a share of the larger one, or by ``absolute``."""
    return [F.abs(x - y) <= F.greatest(F.lit(relative) * F.greatest(F.abs(x), F.abs(y)), F.lit(absolute)) for x, y in zip(_lits(a), _lits(b))]


def all_close(a: Vector, b: Vector, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    return all_of(close(a, b, relative, absolute))


def converted(point: Vector, resolution: Vector, wanted: Vector) -> list[Column]:
    """Coordinates in units of another resolution, to ten digits."""
    return [F.round(p * F.lit(float(r)) / F.lit(float(w)), DIGITS) for p, r, w in zip(_lits(point), resolution, wanted)]


def rounded(point: Vector, digits: int = 6) -> list[Column]:
    """Components rounded half to even, for comparisons."""
    return [F.bround(p, digits) for p in _lits(point)]


def scaled(point: Vector, factors: Sequence[float]) -> list[Column]:
    return [p * F.lit(float(f)) for p, f in zip(_lits(point), factors)]
