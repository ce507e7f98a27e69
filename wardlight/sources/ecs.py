"""Alerts and events in the Elastic common schema, as nested or dotted JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nz

RAW_KEYS = ("event", "host", "user", "source", "destination", "network", "process", "file", "url", "dns", "message", "labels", "tags")
SEVERITIES = ("low", "medium", "high", "critical")
PATHS = {
    "ips": ("source.ip", "destination.ip"), "users": ("user.name",), "domains": ("url.domain", "destination.domain", "dns.question.name"),
    "hashes": ("file.hash.sha256", "file.hash.sha1", "file.hash.md5", "process.hash.sha256"),
}


def get(doc: Column, path: str) -> Column:
    """The variant at a path, nested, or else under the dotted name."""
    nested = "$" + "".join(f"['{p}']" for p in path.split("."))
    return F.coalesce(F.try_variant_get(doc, nested, "variant"), F.try_variant_get(doc, f"$['{path}']", "variant"))


def text(doc: Column, path: str) -> Column:
    return F.try_variant_get(get(doc, path), "$", "string")


def strings(doc: Column, paths) -> Column:
    """All non-empty strings at some paths, once each, in order; a list gives its strings."""
    one = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string"))).otherwise(
        F.coalesce(F.transform(F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))
    )
    return F.array_distinct(F.filter(F.flatten(F.array(*(one(get(doc, p)) for p in paths))), lambda x: nz(x).isNotNull()))


def normalize_hits(hits: DataFrame, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Alerts from detection documents: (alert_id, timestamp, source, severity, title, raw_log, indicators)."""
    df = hits.withColumn("_d", F.try_parse_json(source))
    d = F.col("_d")
    severity = text(d, "kibana.alert.severity")
    detection = F.struct(*(text(d, f"kibana.alert.{p}").alias(n) for n, p in (("reason", "reason"), ("risk_score", "risk_score"), ("rule_name", "rule.name"), ("rule_description", "rule.description"))))
    raw = F.to_json(F.struct(*(F.try_variant_get(d, f"$['{k}']", "variant").alias(k) for k in RAW_KEYS), detection.alias("detection")))
    found = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, PATHS)), F.array(*(strings(d, p) for p in PATHS.values()))), lambda k, v: F.size(v) > 0)
    return df.select(
        F.coalesce(nz(text(d, "kibana.alert.uuid")), nz(F.col(doc_id)), F.lit("elastic-unknown")).alias("alert_id"), F.try_to_timestamp(text(d, "@timestamp")).alias("timestamp"), F.lit("elastic").alias("source"),
        F.when(severity.isin(*SEVERITIES), severity).otherwise("medium").alias("severity"), F.coalesce(nz(text(d, "kibana.alert.rule.name")), nz(text(d, "kibana.alert.reason")), F.lit("Elastic detection alert")).alias("title"),
        raw.alias("raw_log"), found.alias("indicators"),
    )


def open_alerts(hits: DataFrame, most: int, status: str = "open", source: str = "source") -> DataFrame:
    """The newest documents in a state: a bounded fetch by its nature."""
    d = hits.withColumn("_d", F.try_parse_json(source))
    return d.where(text(F.col("_d"), "kibana.alert.workflow_status") == status).orderBy(F.desc_nulls_last(F.try_to_timestamp(text(F.col("_d"), "@timestamp")))).limit(most).drop("_d")


def read_alert_files(spark: SparkSession, path: str) -> DataFrame:
    """Alert files, one JSON document each: those with ``_source`` are detection documents, others are alerts already."""
    whole = spark.read.text(path, wholetext=True).withColumn("_d", F.try_parse_json("value"))
    d = F.col("_d")
    inner = F.try_variant_get(d, "$['_source']", "variant")
    ecs = normalize_hits(whole.where(inner.isNotNull()).select(F.to_json(inner).alias("source"), text(d, "_id").alias("doc_id")))
    native = whole.where(inner.isNull()).select(
        text(d, "alert_id").alias("alert_id"), F.try_to_timestamp(text(d, "timestamp")).alias("timestamp"), text(d, "source").alias("source"), text(d, "severity").alias("severity"), text(d, "title").alias("title"),
        F.to_json(F.try_variant_get(d, "$.raw_log", "variant")).alias("raw_log"), F.try_variant_get(d, "$.indicators", "map<string,array<string>>").alias("indicators"),
    )
    return native.unionByName(ecs)


def host_of(raw: Column) -> Column:
    """A record's host: its name if it is an object, itself if it is a string."""
    h = F.try_variant_get(raw, "$.host", "variant")
    return nz(F.when(F.schema_of_variant(h) == "STRING", F.try_variant_get(h, "$", "string")).when(F.schema_of_variant(h).startswith("OBJECT"), F.try_variant_get(h, "$.name", "string")))


def indicators_of(m: Column) -> Column:
    """All indicators of a map, once each."""
    return F.array_distinct(F.filter(F.flatten(F.map_values(m)), lambda x: nz(x).isNotNull()))


def brute_force_events(spark: SparkSession, failures: int = 847, succeeded: bool = True) -> DataFrame:
    """A fixed scene for tests: many failed logins from one address, some ambient rows and, in one world, the success that follows."""
    start = F.timestamp_seconds(F.lit(1776567600))
    fails = spark.range(failures).select(F.timestamp_seconds(F.lit(1776567600) + F.col("id")).alias("ts"), F.lit("203.0.113.7").alias("source_ip"), F.concat(F.lit("user"), (F.col("id") % 9).cast("string")).alias("user_name"), F.lit("ssh_login").alias("action"), F.lit("authentication").alias("category"), F.lit("failure").alias("outcome"))
    ambient = spark.range(4).select(start.alias("ts"), F.concat(F.lit("10.0.0."), F.col("id").cast("string")).alias("source_ip"), F.lit("backup").alias("user_name"), F.lit("ssh_login").alias("action"), F.lit("authentication").alias("category"), F.lit("success").alias("outcome"))
    after = spark.range(3 if succeeded else 0).select(F.timestamp_seconds(F.lit(1776567600 + 900) + F.col("id")).alias("ts"), F.lit("203.0.113.7").alias("source_ip"), F.lit("user3").alias("user_name"), F.element_at(F.array(F.lit("ssh_login"), F.lit("sudo"), F.lit("useradd")), (F.col("id") + 1).cast("int")).alias("action"), F.lit("authentication").alias("category"), F.lit("success").alias("outcome"))
    return fails.unionByName(ambient).unionByName(after)
