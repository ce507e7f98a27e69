"""Recorded answers of outside services, joined instead of asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_domain(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"^https?://|/.*$|\.$", "")


def lookup(subjects: DataFrame, recorded: DataFrame, strict: bool = True) -> DataFrame:
    """subjects (namespace, subject, ...) with the recorded response. With ``strict`` a subject without a record is an error, never an empty answer."""
    j = subjects.join(recorded.select("namespace", "subject", "response"), ["namespace", "subject"], "left")
    if not strict:
        return j
    missing = F.raise_error(F.concat(F.lit("no recorded response for "), "namespace", F.lit(" "), "subject"))
    return j.withColumn("response", F.coalesce("response", missing))


def ip_reputation(response: Column) -> Column:
    v = F.parse_json(response)
    get = lambda p, t: F.try_variant_get(v, f"$.{p}", t)
    return F.struct(get("abuseConfidenceScore", "double").alias("score"), get("totalReports", "long").alias("reports"), F.coalesce(get("isWhitelisted", "boolean"), F.lit(False)).alias("whitelisted"))


def hash_reputation(response: Column) -> Column:
    """found, malicious, engines, names of at most 15 detections; a null response was a 404."""
    v = F.try_parse_json(response)
    stats = F.map_values(F.coalesce(F.try_variant_get(v, "$.last_analysis_stats", "map<string,long>"), F.create_map().cast("map<string,long>")))
    return F.struct(response.isNotNull().alias("found"), F.coalesce(F.try_variant_get(v, "$.last_analysis_stats.malicious", "long"), F.lit(0)).alias("malicious"), F.aggregate(stats, F.lit(0).cast("long"), lambda a, b: a + b).alias("engines"), F.slice(F.coalesce(F.try_variant_get(v, "$.detections", "array<string>"), F.array().cast("array<string>")), 1, 15).alias("detections"))


def domain_reputation(response: Column) -> Column:
    """found, malicious scans, scans returned (20 at most), total, and five different URLs seen."""
    v = F.try_parse_json(response)
    results = F.slice(F.coalesce(F.try_variant_get(v, "$.results", "array<struct<malicious:boolean,url:string>>"), F.array().cast("array<struct<malicious:boolean,url:string>>")), 1, 20)
    return F.struct((F.size(results) > 0).alias("found"), F.size(F.filter(results, lambda r: F.coalesce(r["malicious"], F.lit(False)))).alias("malicious"), F.size(results).alias("sampled"), F.coalesce(F.try_variant_get(v, "$.total", "long"), F.lit(0)).alias("total"), F.slice(F.array_distinct(F.transform(results, lambda r: r["url"])), 1, 5).alias("urls"))


#: State of an alert or case in the case tool, and the ruling that it stands for. Fixed values.
CASE_RULINGS = {"TruePositive": "true_positive", "FalsePositive": "false_positive", "Indeterminate": "inconclusive", "Ignored": "false_positive", "Duplicated": None}


def case_rulings(alerts: DataFrame, cases: DataFrame) -> DataFrame:
    """(alert_id, human_verdict, summary): an alert's ruling, that of its case if it was merged into one."""
    rule = lambda c: F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in CASE_RULINGS.items() if v), F.lit(None).cast("string"))
    j = alerts.join(cases.select("case_id", F.col("status").alias("_cs"), F.col("summary").alias("_sum")), "case_id", "left")
    return j.select("alert_id", F.coalesce(rule(F.col("_cs")), rule(F.col("status"))).alias("human_verdict"), F.coalesce("_sum", "summary").alias("summary")).where("human_verdict is not null")
