"""Boxes as pairs of columns lo_<attr>, hi_<attr>; low edges belong to a box, high edges don't. A missing attribute is unbounded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(side: str, attr: str) -> tuple[Column, Column]:
    return F.col(f"{side}.lo_{attr}"), F.col(f"{side}.hi_{attr}")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def intersects(a: str, b: str, attrs: list[str]) -> Column:
    return _all([F.greatest(_edges(a, x)[0], _edges(b, x)[0]) < F.least(_edges(a, x)[1], _edges(b, x)[1]) for x in attrs])


def covers(a: str, b: str, attrs: list[str]) -> Column:
    """Box a holds all of box b."""
    return _all([(_edges(a, x)[0] <= _edges(b, x)[0]) & (_edges(b, x)[1] <= _edges(a, x)[1]) for x in attrs])


def intersection(a: str, b: str, attr: str) -> tuple[Column, Column]:
    return F.greatest(_edges(a, attr)[0], _edges(b, attr)[0]), F.least(_edges(a, attr)[1], _edges(b, attr)[1])


def hull(a: str, b: str, attr: str) -> tuple[Column, Column]:
    return F.least(_edges(a, attr)[0], _edges(b, attr)[0]), F.greatest(_edges(a, attr)[1], _edges(b, attr)[1])


def contains(box: str, attrs: list[str]) -> Column:
    """The row's attributes lie in the box."""
    return _all([(F.col(x) >= _edges(box, x)[0]) & (F.col(x) < _edges(box, x)[1]) for x in attrs])


def locate(value: Column, lo: Column, hi: Column) -> Column:
    return F.when(value < lo, -1).when(value >= hi, 1).otherwise(0)


def edge_text(c: Column) -> Column:
    """For reports: two decimals, MIN and MAX for the unbounded edges."""
    return F.when(c <= -1e308, "MIN").when(c >= 1e308, "MAX").otherwise(F.format_number(c, 2))
