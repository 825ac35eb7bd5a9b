"""Range queries: `target;attr:[lo, hi];attr:[lo, hi]`, low edge included, high edge not."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HIGH, LOW

_RANGE = re.compile(r"\s*([^:\s]+)\s*:\s*\[\s*([^,\s]+)\s*,\s*([^\]\s]+)\s*\]\s*")


@dataclass(frozen=True)
class RangeQuery:
    target: str
    box: tuple[tuple[str, float, float], ...]

    @classmethod
    def parse(cls, text: str) -> RangeQuery:
        target, *ranges = text.strip().split(";")
        found = []
        for r in ranges:
            if not r.strip():
                continue
            m = _RANGE.fullmatch(r)
            if m is None:
                raise ValueError(f"not a range: {r!r}")
            found.append((m[1], float(m[2]), float(m[3])))
        if not target.strip():
            raise ValueError(f"no target in {text!r}")
        return cls(target.strip(), tuple(sorted(found)))

    def __str__(self) -> str:
        return ";".join([self.target, *(f"{a}:[{lo!r}, {hi!r}]" for a, lo, hi in self.box)])

    @property
    def hash(self) -> str:
        return hashlib.sha256(str(self).encode()).hexdigest()[:10]

    def edges(self, attr: str) -> tuple[float, float]:
        return next(((lo, hi) for a, lo, hi in self.box if a == attr), (LOW, HIGH))

    def predicate(self) -> Column:
        return reduce(lambda a, b: a & b, [(F.col(a) >= lo) & (F.col(a) < hi) for a, lo, hi in self.box], F.lit(True))

    def sql(self, table: str) -> str:
        where = " AND ".join(f"{a} >= {lo!r} AND {a} < {hi!r}" for a, lo, hi in self.box)
        return f"SELECT SUM({self.target}) AS total FROM {table}" + (f" WHERE {where}" if where else "")

    def within(self, box: dict[str, tuple[float, float]]) -> RangeQuery | None:
        """The part of the query in a box; None if they are disjoint."""
        out = []
        for a in sorted({*box, *(x[0] for x in self.box)}):
            lo, hi = self.edges(a)
            low, high = box.get(a, (LOW, HIGH))
            lo, hi = max(lo, low), min(hi, high)
            if lo >= hi:
                return None
            out.append((a, lo, hi))
        return RangeQuery(self.target, tuple(out))


def any_of(attr: str, ranges: list[tuple[float, float]]) -> Column:
    """One of several ranges of an attribute; and-ed over attributes this is a filter in disjunctive form for each."""
    return reduce(lambda a, b: a | b, [(F.col(attr) >= lo) & (F.col(attr) < hi) for lo, hi in ranges], F.lit(False))


def query_table(spark: SparkSession, queries: list[RangeQuery], attrs: list[str]) -> DataFrame:
    """A row for each query of a workload: qid, lo_<attr>, hi_<attr>. Workloads are lists that the driver holds (some thousand queries)."""
    rows = [(i, *(float(e) for a in attrs for e in q.edges(a))) for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "qid int, " + ", ".join(f"lo_{a} double, hi_{a} double" for a in attrs))
