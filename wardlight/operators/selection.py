"""Exact order statistics of a column of any size, by counting buckets and refining those that matter."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch

#: Buckets that a pass counts for each rank.
BUCKETS = 4096


def order_statistics(df: DataFrame, column: str, ranks: list[int], n: int, low, high) -> dict[int, float | int]:
    """The values with these ranks (from 1) among the n values of a column without nulls, which lie from low to high.

    A pass counts the values of each rank's interval in BUCKETS equal parts, with the least and the greatest in each;
    the part that holds the rank is the next interval, until its ends are equal. The ends of an interval have parts of their own,
    so every pass makes it smaller, also where infinities make the rest share one: two or three passes for whole numbers, a few more for uneven doubles. A task holds
    one row for each part and open rank, whatever the number of values, and so does the driver.
    """
    open_ranks = {r: (low, high, 0) for r in set(ranks)}  # with how many values lie before the interval
    found = {}
    while True:
        found |= {r: a for r, (a, b, _) in open_ranks.items() if a == b}
        open_ranks = {r: x for r, x in open_ranks.items() if r not in found}
        if not open_ranks:
            return found
        x, half = F.col(column), lambda v: float(v) / 2
        spans = {}
        for r, (a, b, before) in open_ranks.items():
            spans.setdefault((a, b, before), []).append(r)
        part = lambda a, b: F.least(F.lit(BUCKETS - 2), F.floor((x.cast("double") / 2 - half(a)) / (half(b) - half(a)) * BUCKETS)).cast("int")
        at = F.array_compact(F.array(*(F.when(x.between(a, b), F.struct(F.lit(i).alias("i"), F.when(x == a, 0).when(x == b, BUCKETS - 1).otherwise(F.greatest(F.lit(1), part(a, b))).alias("k"))) for i, (a, b, _) in enumerate(spans))))
        counted = df.select(column, F.explode(at).alias("p")).groupBy("p.i", "p.k").agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for i, ((_, _, before), mine) in enumerate(spans.items()):
            parts = sorted((c for c in counted if c["i"] == i), key=lambda c: c["k"])
            for r in mine:
                ahead = before
                for c in parts:
                    if ahead + c["n"] >= r:
                        open_ranks[r] = (c["lo"], c["hi"], ahead)
                        break
                    ahead += c["n"]


def percentiles(df: DataFrame, column: str, between: list[float] = (), nearest: list[float] = ()) -> dict:
    """{n, between: {p: value}, nearest: {p: value}}: interpolated percentiles, and nearest-rank ones (a value of the column itself).

    Nulls and NaN don't count; without values all are None. A whole-number column keeps whole numbers in ``nearest``.
    """
    kind = df.schema[column].dataType.simpleString()
    good = df.select(column).where(F.col(column).isNotNull())
    if kind in ("double", "float"):
        good = good.where(~F.isnan(column)).select((F.col(column) + F.lit(0.0)).cast("double").alias(column))  # -0.0 becomes 0.0
    scratch = Scratch(df.sparkSession, "selection")
    values = scratch.keep(good)
    ends = values.agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    n = ends["n"]
    if not n:
        scratch.drop()
        return {"n": 0, "between": dict.fromkeys(between), "nearest": dict.fromkeys(nearest)}
    places = {p: (n - 1) * p for p in between}
    near = {p: max(1, ceil(n * p)) for p in nearest}
    ranks = [*(floor(h) + 1 for h in places.values()), *(ceil(h) + 1 for h in places.values()), *near.values()]
    found = order_statistics(values, column, ranks, n, ends["lo"], ends["hi"])
    scratch.drop()
    mixed = {p: float(found[floor(h) + 1]) if h == floor(h) else (ceil(h) - h) * float(found[floor(h) + 1]) + (h - floor(h)) * float(found[ceil(h) + 1]) for p, h in places.items()}
    return {"n": n, "between": mixed, "nearest": {p: found[r] for p, r in near.items()}}
