"""What a record is about: the detection behind it, and the names that the inventory has for its entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nz, one_line
from ..functions.urls import let
from ..sources.ledger import ORDER

#: Where a raw log may name the rule that fired, first one first. Fixed values.
RULE_PATHS = ("detection.rule_name", "detection.rule", "detection_rule", "signal.rule.name", "rule.name", "rule_name", "rule")
UNNAMED = "(unnamed detection)"


def _text_at(raw: Column, path: str) -> Column:
    """The string at a nested path, in one line; null for anything else."""
    nested = "$" + "".join(f"['{p}']" for p in path.split("."))
    return let(F.try_variant_get(raw, nested, "variant"), lambda v: F.when(F.schema_of_variant(v) == "STRING", nz(one_line(F.try_variant_get(v, "$", "string")))))


def detection_of(raw: Column, title: Column) -> Column:
    """struct(detection, provenance): the first rule name in a VARIANT raw log ('rule'), or else the title ('title').

    The provenance is part of the key, so an alert's title never counts for a rule of that name.
    """
    rule = F.coalesce(*(_text_at(raw, p) for p in RULE_PATHS))
    name = lambda r: F.struct(F.coalesce(r, nz(one_line(title)), F.lit(UNNAMED)).alias("detection"), F.when(r.isNotNull(), "rule").otherwise("title").alias("provenance"))
    return let(rule, name)


def with_detection(records: DataFrame, raw_json: str = "raw_log") -> DataFrame:
    """records with detection and provenance, from their raw log and title."""
    found = records.withColumn("_d", detection_of(F.try_parse_json(raw_json), F.col("title")))
    return found.withColumns({"detection": F.col("_d.detection"), "provenance": F.col("_d.provenance")}).drop("_d")


def asset_names(records: DataFrame, matches: str = "asset_matches") -> DataFrame:
    """(written_at, uid, place, entity, name, role): the inventory matches of all records, in order."""
    rows = records.select(*ORDER, F.posexplode(matches).alias("place", "m"))
    return rows.select(*ORDER, "place", F.nullif(F.col("m.entity"), F.lit("")).alias("entity"), F.nullif(F.col("m.name"), F.lit("")).alias("name"), F.nullif(F.col("m.role"), F.lit("")).alias("role"))


def inventory_roles(records: DataFrame, matches: str = "asset_matches") -> DataFrame:
    """(entity, role): the first role that the inventory gave a name of a thing, by record, place, and entity before name."""
    m = asset_names(records, matches).where("role is not null")
    both = m.select(*ORDER, "place", "role", F.posexplode(F.array("entity", "name")).alias("which", "entity")).where("entity is not null")
    return both.groupBy("entity").agg(F.min_by("role", F.struct(*ORDER, "place", "which")).alias("role"))


def alias_edges(records: DataFrame, matches: str = "asset_matches") -> DataFrame:
    """(a, b): entity and inventory name of each match, whatever the record's verdict."""
    return asset_names(records, matches).where("entity is not null and name is not null and entity <> name").select(F.col("entity").alias("a"), F.col("name").alias("b")).distinct()
