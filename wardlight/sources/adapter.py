"""Ledgers derived from the synthetic table ``events``, so that every report can run on it.

Each column is a fixed function of the event: k is the number in its JSON property, every fifth event looks at the
previous alert again, and investigation times step back now and then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ledgers:
    investigations: DataFrame
    dispositions: DataFrame
    closures: DataFrame
    created_alerts: DataFrame
    watch_progress: DataFrame
    probes: DataFrame


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


#: Users from this number on have an address that two octets, or one group, don't hold.
WIDE = 1 << 16


def _hex(n: Column) -> Column:
    return F.lower(F.hex(n.cast("long")))


def wide(prefix: str, u: Column, end: Column | str) -> Column:
    """The address, or with bits the network, that stands for such a user: the number in two groups behind a prefix."""
    return F.concat(F.lit(prefix), _hex(F.floor(u / WIDE)), F.lit(":"), _hex(u % WIDE), F.lit("::"), F.lit(end) if isinstance(end, str) else _hex(end))


def spelled(ip: Column) -> Column:
    """An address as the events' SQL spells it: those in fc00 and fd01 have the user's number in one piece."""
    part = lambda i: F.split_part(ip, F.lit(":"), F.lit(i))
    number = lambda c: F.conv(c, 16, 10).cast("long")
    u, text = number(part(2)) * WIDE + number(part(3)), lambda c: c.cast("string")
    four = F.concat(F.lit("10."), text(F.floor(u / 256)), F.lit("."), text(u % 256), F.lit("."), text(number(part(5))))
    return F.when(ip.startswith("fc00:"), four).when(ip.startswith("fd01:"), F.concat(F.lit("fd00:"), _hex(u), F.lit("::"), part(5))).otherwise(ip)


def ledgers(spark: SparkSession, sf_dir: str) -> Ledgers:
    e, eid, k, u = events(spark, sf_dir), F.col("event_id"), F.col("k"), F.col("user_id")
    text = lambda c: c.cast("string")
    stamp = [F.timestamp_millis(eid).alias("written_at"), F.lpad(text(eid), 12, "0").alias("uid")]
    alert_id = F.concat(F.lit("A"), text(eid - F.when(eid % 5 == 4, 1).otherwise(0)))
    minutes = lambda ts, n: F.timestamp_micros(F.unix_micros(ts) + n.cast("long") * 60_000_000)
    verdict = F.when((k % 20 == 3) | (F.col("event_type") == "error"), "true_positive").when(F.col("event_type") == "click", "inconclusive").otherwise("false_positive")
    confidence = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (eid % 3 + 1).cast("int"))
    severity = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), (k % 4 + 1).cast("int"))
    techniques = (
        F.when(F.col("event_type") == "error", F.array(F.lit("T1110.001"), F.lit("T1078")))
        .when(F.col("event_type") == "click", F.array(F.lit("T1566.002")))
        .when(F.col("event_type") == "purchase", F.array(F.lit("T1078")))
        .when(F.col("event_type") == "view", F.array(F.lit("T1059.001")))
        .otherwise(F.array(F.lit("T1136")))
    )
    octets = F.concat(F.lit("10."), text(F.floor(u / 256)), F.lit("."), text(u % 256), F.lit("."))
    rule = F.concat("event_type", F.lit("-"), text(k % 10))
    writer = F.when(eid % 4 == 0, "desk-b").when(eid % 4 != 3, "desk-a")
    inv = e.select(
        *stamp, alert_id.alias("alert_id"), F.col("ts").alias("timestamp"), minutes(F.col("ts"), k).alias("investigated_at"), F.concat(F.lit("Alert "), rule).alias("title"),
        severity.alias("severity"), verdict.alias("verdict"), confidence.alias("confidence"), F.concat(F.lit("host-"), text(u)).alias("host"),
        F.array(F.concat(octets, text(k))).alias("iocs"), F.array(F.concat(octets, F.lit("0"))).alias("net24s"), techniques.alias("attack_techniques"),
        F.when(eid % 6 != 0, (k * 500 / 1_000_000).cast("double")).alias("cost_usd"), (k * 1.5).alias("duration_seconds"),
        F.when((F.col("event_type") == "view") & (eid % 3 == 0), F.concat(F.lit("A"), text(eid - 1))).alias("duplicate_of"), writer.alias("writer"),
        rule.alias("detection"), F.lit("rule").alias("provenance"), F.concat(F.lit("scanner-"), text(k % 10)).alias("asset"),
        (eid % 9 == 0).alias("escalation_recommended"), F.when(eid % 50 == 0, 1).otherwise(0).alias("injection_flags"), (eid % 13 == 0).alias("is_campaign"),
        F.when(eid % 8 == 0, F.array(F.lit("ip_reputation"))).otherwise(F.array().cast("array<string>")).alias("failed_tools"),
        F.sha2(F.concat_ws("|", F.concat(F.lit("host-"), text(u)), rule, severity), 256).alias("fingerprint"),
    )
    human = F.element_at(F.array(*map(F.lit, ("true_positive", "false_positive", "inconclusive"))), (k % 3 + 1).cast("int"))
    day, two_hours = 24 * 60, 120
    return Ledgers(
        inv,
        e.where(eid % 7 == 0).select(*stamp, alert_id.alias("alert_id"), human.alias("human_verdict"), F.lit("analyst").alias("source"), F.concat(F.lit("k="), text(k)).alias("summary"), minutes(F.col("ts"), F.lit(day)).alias("recorded_at"), writer.alias("writer")),
        e.where((verdict == "false_positive") & (confidence == "high") & (eid % 11 == 0)).select(*stamp, alert_id.alias("alert_id"), F.lit("auto").alias("reason"), minutes(F.col("ts"), F.lit(two_hours)).alias("closed_at"), writer.alias("writer")),
        e.where(eid % 10 == 1).select(*stamp, alert_id.alias("alert_id"), F.concat(F.lit("C"), text(eid)).alias("case_id"), F.col("ts").alias("created_at"), writer.alias("writer")),
        e.select(*stamp, alert_id.alias("alert_id"), F.concat(F.lit("D"), text(eid)).alias("doc_id"), F.when(eid % 2 == 0, "started").otherwise("completed").alias("phase"), F.col("ts").alias("at"), writer.alias("writer")),
        inv.where(F.unix_millis("written_at") % 20 == 0),
    )


#: The same as DuckDB common table expressions: inv, rulings, closures, created, progress, probes. Put after WITH.
SQL = """
ev AS (SELECT event_id AS e, ts, user_id AS u, event_type AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
inv AS (
  SELECT e AS seq, 'A' || (e - CASE WHEN e % 5 = 4 THEN 1 ELSE 0 END) AS alert_id, ts AS event_ts, ts + to_minutes(k) AS investigated_at, 'Alert ' || t || '-' || (k % 10) AS title,
    ['low', 'medium', 'high', 'critical'][k % 4 + 1] AS severity,
    CASE WHEN k % 20 = 3 OR t = 'error' THEN 'true_positive' WHEN t = 'click' THEN 'inconclusive' ELSE 'false_positive' END AS verdict,
    ['high', 'medium', 'low'][e % 3 + 1] AS confidence, 'host-' || u AS host,
    '10.' || (u // 256) || '.' || (u % 256) || '.' || k AS ioc, '10.' || (u // 256) || '.' || (u % 256) || '.0' AS net24,
    CASE t WHEN 'error' THEN ['T1110.001', 'T1078'] WHEN 'click' THEN ['T1566.002'] WHEN 'purchase' THEN ['T1078'] WHEN 'view' THEN ['T1059.001'] ELSE ['T1136'] END AS attack_techniques,
    CASE WHEN e % 6 <> 0 THEN CAST(k * 500 AS DOUBLE) / 1000000 END AS cost_usd, k * 1.5::DOUBLE AS duration_seconds,
    CASE WHEN t = 'view' AND e % 3 = 0 THEN 'A' || (e - 1) END AS duplicate_of, CASE WHEN e % 4 = 0 THEN 'desk-b' WHEN e % 4 <> 3 THEN 'desk-a' END AS writer,
    t || '-' || (k % 10) AS detection, 'scanner-' || (k % 10) AS asset, e % 9 = 0 AS escalation_recommended, CASE WHEN e % 50 = 0 THEN 1 ELSE 0 END AS injection_flags,
    e % 13 = 0 AS is_campaign, e % 8 = 0 AS blind,
    sha256('host-' || u || '|' || t || '-' || (k % 10) || '|' || ['low', 'medium', 'high', 'critical'][k % 4 + 1]) AS fingerprint, t, k, u
  FROM ev),
rulings AS (
  SELECT seq, alert_id, ['true_positive', 'false_positive', 'inconclusive'][k % 3 + 1] AS human_verdict, 'k=' || k AS summary, event_ts + INTERVAL 1 DAY AS recorded_at, writer
  FROM inv WHERE seq % 7 = 0),
closures AS (SELECT seq, alert_id, event_ts + INTERVAL 2 HOUR AS closed_at, writer FROM inv WHERE verdict = 'false_positive' AND confidence = 'high' AND seq % 11 = 0),
created AS (SELECT seq, alert_id, 'C' || seq AS case_id FROM inv WHERE seq % 10 = 1),
progress AS (SELECT seq, alert_id, 'D' || seq AS doc_id, CASE WHEN seq % 2 = 0 THEN 'started' ELSE 'completed' END AS phase, event_ts AS started_at, writer FROM inv),
probes AS (SELECT * FROM inv WHERE seq % 20 = 0),
latest AS (SELECT * FROM inv QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) = 1),
ruled AS (SELECT * FROM rulings QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) = 1),
closed AS (SELECT * FROM closures QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) = 1)
"""
