"""Alias components: entities and names that mean one thing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from .components import connected_components


def alias_roots(edges: DataFrame) -> DataFrame:
    """(entity, root) for the ends of edges (a, b): the least name that can be reached.

    An edge without one of its ends says nothing; a name that is linked with itself alone is its own root. The names'
    table stays in the session's shared folder until ``storage.release``.
    """
    scratch = Scratch(edges.sparkSession, "aliases")
    known = edges.where("a is not null and b is not null").select(F.col("a").cast("string"), F.col("b").cast("string"))
    found = connected_components(known, scratch)
    ends = known.select(F.col("a").alias("entity")).unionByName(known.select(F.col("b").alias("entity"))).distinct()
    roots = ends.join(found, F.col("entity") == F.col("node"), "left").select("entity", F.coalesce("component", "entity").alias("root"))
    out = scratch.keep(roots)
    scratch.drop(*(t for t in scratch.held if t is not out))
    return out
