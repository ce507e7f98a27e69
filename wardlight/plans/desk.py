"""Queries over the adapter's ledgers, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, feedback, memory, policy, reports
from ..sources import ledger as lg
from ..sources import sinks
from ..sources.adapter import SQL, ledgers

QUERIES: dict = {}
ORACLES: dict = {}
NOW = "2024-01-31 00:00:00"


def query(sql: str | None = None):
    """Registers a function under its name; ``sql`` goes after the adapter's table expressions."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            whole = re.sub(r"epoch_ms\(([^()]*)\)", r"(epoch_us(\1) // 1000)", sql)  # rounded down
            ORACLES[f.__name__] = f"WITH RECURSIVE {SQL} {whole}"
        return f

    return put


ms = F.unix_millis


# -- views and joins over the ledgers


@query("SELECT alert_id, seq, verdict, confidence, epoch_ms(investigated_at) AS investigated_ms FROM latest")
def latest_record(spark: SparkSession, sf: str) -> DataFrame:
    return lg.latest(ledgers(spark, sf).investigations, "alert_id", "uid", "verdict", "confidence", "investigated_at").select("alert_id", F.col("uid").cast("long").alias("seq"), "verdict", "confidence", ms("investigated_at").alias("investigated_ms"))


@query("SELECT alert_id, human_verdict, summary FROM ruled")
def latest_ruling(spark, sf):
    return lg.latest(ledgers(spark, sf).dispositions, "alert_id", "human_verdict", "summary")


@query("SELECT alert_id, epoch_ms(closed_at) AS closed_ms FROM closed")
def latest_closure(spark, sf):
    return lg.latest(ledgers(spark, sf).closures, "alert_id", "closed_at").select("alert_id", ms("closed_at").alias("closed_ms"))


@query("SELECT alert_id, case_id FROM created QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) = 1")
def latest_created_alert(spark, sf):
    return lg.latest(ledgers(spark, sf).created_alerts, "alert_id", "case_id")


@query("SELECT alert_id, doc_id, phase FROM progress QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) = 1")
def latest_progress(spark, sf):
    return lg.latest(ledgers(spark, sf).watch_progress, "alert_id", "doc_id", "phase")


@query("SELECT alert_id, seq FROM inv QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY seq) = 1")
def first_record(spark, sf):
    return lg.first_wins(ledgers(spark, sf).investigations, "alert_id").select("alert_id", F.col("uid").cast("long").alias("seq"))


@query("SELECT l.alert_id, l.verdict, r.human_verdict FROM latest l LEFT JOIN ruled r USING (alert_id)")
def latest_with_ruling(spark, sf):
    d = ledgers(spark, sf)
    return lg.latest(d.investigations, "alert_id", "verdict").join(lg.latest(d.dispositions, "alert_id", "human_verdict"), "alert_id", "left")


_SIGHT = """, sight AS (
  SELECT p.alert_id AS probe_id, i.alert_id, i.seq, i.event_ts, i.verdict, i.confidence, i.title, i.ioc
  FROM probes p JOIN inv i ON p.ioc = i.ioc AND p.alert_id <> i.alert_id
  QUALIFY row_number() OVER (PARTITION BY p.alert_id, i.alert_id ORDER BY i.seq DESC) = 1),
sightings AS (SELECT s.*, r.human_verdict, r.summary FROM sight s LEFT JOIN ruled r USING (alert_id))"""


@query(_SIGHT + " SELECT probe_id, alert_id, epoch_ms(event_ts) AS event_ms, verdict, confidence, title, ioc AS matched, human_verdict, summary AS human_summary FROM sightings")
def prior_sightings(spark, sf):
    d = ledgers(spark, sf)
    s = memory.prior_sightings(d.probes, d.investigations, d.dispositions)
    return s.select("probe_id", "alert_id", ms("timestamp").alias("event_ms"), "verdict", "confidence", "title", F.array_join("matched_iocs", ",").alias("matched"), "human_verdict", "human_summary")


_CORR = """, sig AS (
  SELECT p.alert_id AS probe_id, i.alert_id, i.seq, 'ioc:' || i.ioc AS signal FROM probes p JOIN inv i ON p.ioc = i.ioc AND p.alert_id <> i.alert_id AND abs(epoch_ms(p.event_ts) - epoch_ms(i.event_ts)) <= 259200000
  UNION ALL SELECT p.alert_id, i.alert_id, i.seq, 'host:' || i.host FROM probes p JOIN inv i ON p.host = i.host AND p.alert_id <> i.alert_id AND abs(epoch_ms(p.event_ts) - epoch_ms(i.event_ts)) <= 259200000
  UNION ALL SELECT p.alert_id, i.alert_id, i.seq, 'related_ip:' || i.net24 FROM probes p JOIN inv i ON p.net24 = i.net24 AND p.ioc <> i.ioc AND p.alert_id <> i.alert_id AND abs(epoch_ms(p.event_ts) - epoch_ms(i.event_ts)) <= 259200000),
rec AS (SELECT probe_id, alert_id, seq, string_agg(signal, ',' ORDER BY signal) AS signals FROM sig GROUP BY ALL),
rel AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY probe_id, alert_id ORDER BY seq) = 1),
camp AS (SELECT DISTINCT p.alert_id AS probe_id, coalesce(n, 0) AS related, coalesce(n, 0) >= 2 AS is_campaign FROM probes p LEFT JOIN (SELECT probe_id, count(*) AS n FROM rel GROUP BY probe_id) c ON p.alert_id = c.probe_id)"""


@query(_CORR + " SELECT probe_id, alert_id, seq, signals FROM rel")
def correlate_signals(spark, sf):
    d = ledgers(spark, sf)
    return memory.correlate(d.probes, d.investigations).select("probe_id", "alert_id", F.col("uid").cast("long").alias("seq"), F.array_join("signals", ",").alias("signals"))


@query(_CORR + " SELECT * FROM camp")
def correlate_campaign(spark, sf):
    d = ledgers(spark, sf)
    return memory.campaigns(d.probes, memory.correlate(d.probes, d.investigations))


@query(_CORR + """ SELECT r.probe_id, r.alert_id, r.signals || coalesce((SELECT string_agg(',technique:' || x, '' ORDER BY x) FROM unnest(list_intersect(p.attack_techniques, i.attack_techniques)) t(x)), '') AS signals
  FROM rel r JOIN probes p ON p.alert_id = r.probe_id JOIN inv i ON i.seq = r.seq""")
def correlate_techniques(spark, sf):
    d = ledgers(spark, sf)
    out = memory.with_techniques(memory.correlate(d.probes, d.investigations), d.probes, d.investigations)
    return out.select("probe_id", "alert_id", F.array_join("signals", ",").alias("signals"))


_TRIAGE = _SIGHT + _CORR + """, scored AS (
  SELECT p.alert_id AS probe_id, p.seq, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END * 10 + CASE WHEN c.is_campaign THEN 100 WHEN related > 0 THEN 25 ELSE 0 END + CASE WHEN recurs IS NOT NULL THEN 50 ELSE 0 END AS score,
    'severity=' || severity || CASE WHEN c.is_campaign THEN ', campaign-correlated' WHEN related > 0 THEN ', ' || related || ' related prior(s)' ELSE '' END || coalesce(', recurs a true positive (' || recurs || ')', '') AS reason
  FROM probes p JOIN camp c ON c.probe_id = p.alert_id
  LEFT JOIN (SELECT probe_id, alert_id AS recurs FROM sightings WHERE coalesce(human_verdict, verdict) = 'true_positive' QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY event_ts DESC, alert_id DESC) = 1) s ON s.probe_id = p.alert_id)"""


def _triage(spark, sf):
    d = ledgers(spark, sf)
    return memory.triage(d.probes, memory.prior_sightings(d.probes, d.investigations, d.dispositions), memory.correlate(d.probes, d.investigations))


@query(_TRIAGE + " SELECT probe_id, CAST(score AS BIGINT) AS score, reason, row_number() OVER (ORDER BY score DESC, seq) AS rank FROM scored")
def triage_queue(spark, sf):
    return memory.queue_rank(_triage(spark, sf)).select("probe_id", "score", "reason", "rank")


@query(_TRIAGE + " SELECT probe_id, CAST(score AS BIGINT) AS score FROM scored ORDER BY score DESC, seq LIMIT 10")
def queue_cycle_top10(spark, sf):
    """The alerts that one cycle of the desk takes: a top-k by its nature."""
    return memory.queue(_triage(spark, sf), 10).select("probe_id", "score")


# -- suppression

_ANCHOR = """, anc AS (
  SELECT p.alert_id AS probe_id, p.fingerprint, p.investigated_at AS now, i.seq AS a_seq, i.alert_id AS anchor_id, i.investigated_at AS a_at, i.verdict AS a_verdict, i.confidence AS a_confidence
  FROM probes p JOIN inv i ON p.fingerprint = i.fingerprint AND i.alert_id <> p.alert_id AND i.duplicate_of IS NULL AND i.investigated_at >= p.investigated_at - INTERVAL 240 HOUR AND i.investigated_at <= p.investigated_at
  QUALIFY row_number() OVER (PARTITION BY p.alert_id ORDER BY i.seq DESC) = 1),
anchor AS (SELECT a.*, (SELECT count(*) FROM inv s WHERE s.fingerprint = a.fingerprint AND s.duplicate_of IS NOT NULL AND s.investigated_at >= a.a_at AND s.investigated_at <= a.now) AS suppressions FROM anc a)"""


@query(_ANCHOR + " SELECT probe_id, anchor_id, a_seq AS anchor_seq, epoch_ms(a_at) AS anchor_ms, a_verdict AS anchor_verdict, suppressions FROM anchor")
def dedup_anchor(spark, sf):
    d = ledgers(spark, sf)
    a = dedup.find_anchor(d.probes, d.investigations, hours=240)
    return a.select("probe_id", "anchor_id", F.col("anchor_uid").cast("long").alias("anchor_seq"), ms("anchor_at").alias("anchor_ms"), "anchor_verdict", "suppressions")


_FPS = ", bad AS (SELECT DISTINCT fingerprint FROM inv WHERE alert_id IN (SELECT alert_id FROM ruled WHERE human_verdict <> 'false_positive'))"


@query(_FPS + " SELECT fingerprint FROM bad")
def overturned_fingerprints(spark, sf):
    d = ledgers(spark, sf)
    return dedup.overturned_fingerprints(d.investigations, d.dispositions)


_GATE = """CASE WHEN r.human_verdict <> 'false_positive' THEN 'ruled ' || r.human_verdict WHEN {v} <> 'false_positive' THEN 'verdict ' || {v} WHEN {c} <> 'high' THEN 'confidence ' || {c}
  WHEN i.escalation_recommended THEN 'escalated' WHEN i.injection_flags > 0 THEN 'injection' WHEN i.blind THEN 'blind: ip_reputation' WHEN r.human_verdict IS NOT NULL THEN 'confirmed' ELSE 'clean' END"""


@query(_ANCHOR + f" SELECT probe_id, anchor_id, {_GATE.format(v='a_verdict', c='a_confidence')} AS reason FROM anchor a JOIN inv i ON i.seq = a.a_seq LEFT JOIN ruled r ON r.alert_id = a.anchor_id")
def dedup_reuse_gate(spark, sf):
    d = ledgers(spark, sf)
    a = dedup.find_anchor(d.probes, d.investigations, hours=240)
    facts = d.investigations.select(F.col("uid").alias("anchor_uid"), "escalation_recommended", "injection_flags", "failed_tools")
    ruling = lg.latest(d.dispositions, "alert_id", "human_verdict").select(F.col("alert_id").alias("anchor_id"), "human_verdict")
    j = a.join(facts, "anchor_uid").join(ruling, "anchor_id", "left")
    gate = dedup.reuse_gate(F.col("anchor_verdict"), F.col("anchor_confidence"), F.col("human_verdict"), F.col("escalation_recommended"), F.col("injection_flags"), F.col("failed_tools"))
    return j.select("probe_id", "anchor_id", gate["reason"].alias("reason"))


_WATCHED = """, cand AS (SELECT * FROM inv WHERE t = 'view' AND seq % 3 = 0),
anc2 AS (
  SELECT p.alert_id AS probe_id, p.fingerprint, p.investigated_at AS now, i.seq AS a_seq, i.alert_id AS anchor_id, i.investigated_at AS a_at, i.verdict AS a_verdict, i.confidence AS a_confidence
  FROM cand p JOIN inv i ON p.fingerprint = i.fingerprint AND i.alert_id <> p.alert_id AND i.duplicate_of IS NULL AND i.investigated_at >= p.investigated_at - INTERVAL 480 HOUR AND i.investigated_at <= p.investigated_at
  QUALIFY row_number() OVER (PARTITION BY p.alert_id ORDER BY i.seq DESC) = 1),
anchor2 AS (SELECT a.*, (SELECT count(*) FROM inv s WHERE s.fingerprint = a.fingerprint AND s.duplicate_of IS NOT NULL AND s.investigated_at >= a.a_at AND s.investigated_at <= a.now) AS suppressions FROM anc2 a)"""


@query(_FPS + _WATCHED + f""" SELECT p.alert_id AS probe_id, a.anchor_id, coalesce(a.suppressions, 0) AS suppressions,
  CASE WHEN p.injection_flags > 0 THEN 'injected' WHEN p.alert_id IN (SELECT alert_id FROM inv WHERE duplicate_of IS NULL) THEN 'already investigated' WHEN a.anchor_id IS NULL THEN 'no anchor' WHEN a.suppressions >= 25 THEN 'cap' WHEN b.fingerprint IS NOT NULL THEN 'overturned' ELSE {_GATE.format(v='a.a_verdict', c='a.a_confidence')} END AS reason
  FROM cand p LEFT JOIN anchor2 a ON a.probe_id = p.alert_id LEFT JOIN bad b ON b.fingerprint = p.fingerprint LEFT JOIN inv i ON i.seq = a.a_seq LEFT JOIN ruled r ON r.alert_id = a.anchor_id""")
def dedup_suppress(spark, sf):
    """The whole suppression pipeline for alerts that came as duplicates."""
    d = ledgers(spark, sf)
    seq = F.col("uid").cast("long")
    probes = d.investigations.where(F.col("title").startswith("Alert view-") & (seq % 3 == 0))
    return dedup.suppress(probes, d.investigations, d.dispositions, hours=480).select("probe_id", "anchor_id", "suppressions", "reason")


@query(""", m AS (SELECT seq, fingerprint, duplicate_of IS NULL AS own, count(*) FILTER (duplicate_of IS NULL) OVER (PARTITION BY fingerprint ORDER BY seq) AS block FROM inv)
  SELECT seq, count(*) FILTER (NOT own) OVER (PARTITION BY fingerprint, block ORDER BY seq) AS since_real FROM m""")
def suppressions_since_real(spark, sf):
    return dedup.running_suppressions(ledgers(spark, sf).investigations).select(F.col("uid").cast("long").alias("seq"), "since_real")


@query("SELECT DISTINCT alert_id FROM inv WHERE duplicate_of IS NULL")
def real_record_ids(spark, sf):
    return dedup.real(ledgers(spark, sf).investigations).select("alert_id").distinct()


# -- gates

_SIGHT_ALL = _SIGHT.replace("FROM probes p", "FROM inv p")
_OVER = ", over AS (SELECT probe_id, alert_id AS oid FROM sightings WHERE human_verdict <> verdict QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY event_ts DESC, alert_id DESC) = 1)"


def _gated(spark, sf):
    d = ledgers(spark, sf)
    over = memory.newest_overturned(d.investigations, d.investigations, d.dispositions)
    return d.investigations.join(over.withColumnRenamed("probe_id", "alert_id"), "alert_id", "left").withColumn("seq", F.col("uid").cast("long"))


_TESTS = """WHEN verdict <> 'false_positive' THEN 'verdict is ' || verdict {o} WHEN confidence <> 'high' THEN 'confidence is ' || confidence WHEN blind THEN 'failed lookups: ip_reputation'
  WHEN escalation_recommended THEN 'escalation recommended' WHEN injection_flags > 0 THEN 'injection flags' WHEN is_campaign THEN 'campaign' ELSE 'clean' END AS reason"""


@query(_SIGHT_ALL + _OVER + " SELECT seq, CASE " + _TESTS.format(o="WHEN oid IS NOT NULL THEN 'overturned precedent ' || oid") + " FROM inv LEFT JOIN over ON probe_id = alert_id")
def closure_gate(spark, sf):
    c = F.col
    g = policy.auto_close(c("verdict"), c("confidence"), c("overturned_id"), c("failed_tools"), c("escalation_recommended"), c("injection_flags"), c("is_campaign"))
    return _gated(spark, sf).select("seq", g["reason"].alias("reason"))


@query(_SIGHT_ALL + _OVER + " SELECT seq, CASE WHEN severity = 'critical' THEN 'critical severity' WHEN oid IS NOT NULL THEN 'overturned precedent ' || oid " + _TESTS.format(o="") + " FROM inv LEFT JOIN over ON probe_id = alert_id")
def routing_gate(spark, sf):
    c = F.col
    g = policy.promote(c("severity"), c("verdict"), c("confidence"), c("overturned_id"), c("failed_tools"), c("escalation_recommended"), c("injection_flags"), c("is_campaign"))
    return _gated(spark, sf).select("seq", g["reason"].alias("reason"))


@query("""SELECT CASE WHEN escalation_recommended THEN 'escalation recommended' WHEN is_campaign THEN 'campaign' ELSE 'no signal' END AS reason, count(*) AS n FROM inv GROUP BY 1""")
def notify_gate(spark, sf):
    g = policy.notify(F.col("verdict"), F.col("confidence"), F.col("escalation_recommended"), F.col("is_campaign"))
    return ledgers(spark, sf).investigations.groupBy(g["reason"].alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT seq, CASE WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN escalation_recommended THEN 'escalation recommended' WHEN is_campaign THEN 'campaign' WHEN verdict = 'true_positive' THEN 'true positive' ELSE 'no signal' END AS reason,
  CAST(least(4, greatest(k % 4 + 1 + CASE WHEN is_campaign THEN 1 ELSE 0 END, CASE WHEN escalation_recommended THEN 2 ELSE 1 END)) AS BIGINT) AS case_severity FROM inv""")
def case_gate(spark, sf):
    c = F.col
    g = policy.open_case(c("verdict"), c("escalation_recommended"), c("is_campaign"), c("duplicate_of"))
    return ledgers(spark, sf).investigations.select(c("uid").cast("long").alias("seq"), g["reason"].alias("reason"), policy.case_severity(c("severity"), c("escalation_recommended"), c("is_campaign")).alias("case_severity"))


@query("SELECT seq FROM inv WHERE writer = 'desk-a'")
def provenance_filter(spark, sf):
    return ledgers(spark, sf).investigations.where(lg.ours(F.col("writer"), "desk-a", True)).select(F.col("uid").cast("long").alias("seq"))


@query(""", p AS (SELECT * FROM progress QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) = 1)
  SELECT p.alert_id, CASE WHEN phase <> 'started' THEN 'completed' WHEN epoch_ms(TIMESTAMP '2024-01-15 12:00:00') // 1000 - epoch_ms(started_at) // 1000 < -60 THEN 'started in the future' WHEN epoch_ms(TIMESTAMP '2024-01-15 12:00:00') // 1000 - epoch_ms(started_at) // 1000 > 86400 THEN 'too old'
    WHEN l.duplicate_of IS NOT NULL THEN 'suppressed' WHEN l.injection_flags > 0 THEN 'injection flags' ELSE 'resume' END AS reason
  FROM p JOIN latest l ON l.alert_id = p.alert_id""")
def resume_gate(spark, sf):
    d = ledgers(spark, sf)
    p, r = lg.last_wins(d.watch_progress, "alert_id"), lg.last_wins(d.investigations, "alert_id")
    return policy.resume_eligible(p, r, F.to_timestamp(F.lit("2024-01-15 12:00:00")), window_s=86400).select("alert_id", "reason")


# -- scorecard and digest

_SCORED = ", scored AS (SELECT l.*, r.human_verdict, l.verdict = r.human_verdict AS agrees FROM latest l JOIN ruled r USING (alert_id))"
_SUPER = """, lastreal AS (SELECT * FROM inv WHERE duplicate_of IS NULL QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) = 1),
superseded AS (SELECT c.alert_id, coalesce(r.recorded_at > c.closed_at AND r.human_verdict <> 'false_positive', false) AS by_ruling, coalesce(a.investigated_at > c.closed_at AND a.verdict <> 'false_positive', false) AS by_record
  FROM closed c LEFT JOIN ruled r USING (alert_id) LEFT JOIN lastreal a USING (alert_id))"""


@query(_SCORED + _SUPER + """ SELECT (SELECT count(*) FROM latest) AS alerts, (SELECT count(*) FROM latest WHERE duplicate_of IS NOT NULL) AS suppressed, (SELECT count(DISTINCT alert_id) FROM inv WHERE duplicate_of IS NULL) AS investigated,
  (SELECT count(*) FROM scored) AS ruled, (SELECT count(*) FROM scored WHERE agrees) AS agreed, (SELECT count(*) FROM closed) AS auto_closed,
  (SELECT count(*) FROM (SELECT alert_id FROM closed UNION SELECT alert_id FROM latest WHERE duplicate_of IS NOT NULL)) AS unattended, (SELECT count(*) FROM superseded WHERE by_ruling OR by_record) AS superseded,
  (SELECT CAST(count(*) FILTER (agrees) AS DOUBLE) / nullif(count(*), 0) FROM scored) AS agreement_rate,
  (SELECT CAST(count(*) AS DOUBLE) FROM (SELECT alert_id FROM closed UNION SELECT alert_id FROM latest WHERE duplicate_of IS NOT NULL)) / nullif((SELECT count(*) FROM latest), 0) AS automation_rate""")
def scorecard_summary(spark, sf):
    d = ledgers(spark, sf)
    return reports.scorecard(d.investigations, d.dispositions, d.closures)


@query(_SCORED + " SELECT confidence, count(*) FILTER (agrees) AS agreed, count(*) AS ruled, CAST(CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS BIGINT) AS place FROM scored GROUP BY confidence")
def scorecard_by_confidence(spark, sf):
    d = ledgers(spark, sf)
    return reports.agreement_by_confidence(reports.scored_rulings(d.investigations, d.dispositions))


@query(_SCORED + """ SELECT count(*) FILTER (escalation_recommended AND human_verdict = 'true_positive') AS confirmed, count(*) FILTER (escalation_recommended AND human_verdict = 'false_positive') AS dismissed,
  count(*) FILTER (escalation_recommended AND human_verdict = 'inconclusive') AS other, count(*) FILTER (NOT escalation_recommended AND human_verdict = 'true_positive') AS missed,
  CAST(count(*) FILTER (escalation_recommended AND human_verdict = 'true_positive') AS DOUBLE) / nullif(count(*) FILTER (escalation_recommended), 0) AS precision FROM scored""")
def scorecard_escalations(spark, sf):
    d = ledgers(spark, sf)
    return reports.escalation_precision(reports.scored_rulings(d.investigations, d.dispositions))


@query(_SCORED + " SELECT alert_id, verdict, human_verdict, agrees FROM scored")
def scorecard_rulings(spark, sf):
    d = ledgers(spark, sf)
    return reports.scored_rulings(d.investigations, d.dispositions).select("alert_id", "verdict", "human_verdict", "agrees")


@query(", f AS (SELECT * FROM inv WHERE duplicate_of IS NULL QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY seq) = 1), s AS (SELECT epoch_ms(investigated_at) - epoch_ms(event_ts) AS ms FROM f) SELECT count(*) AS n, median(ms) AS median_ms, quantile_disc(ms, 0.9) AS p90_ms FROM s WHERE ms >= 0")
def time_to_verdict(spark, sf):
    return reports.time_to_verdict(ledgers(spark, sf).investigations)


@query(_SUPER + " SELECT alert_id, by_ruling, by_record FROM superseded WHERE by_ruling OR by_record")
def superseded_closures(spark, sf):
    d = ledgers(spark, sf)
    return reports.superseded_closures(d.investigations, d.dispositions, d.closures)


@query(f""", lastreal AS (SELECT * FROM inv WHERE duplicate_of IS NULL QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) = 1),
w AS (SELECT l.*, coalesce(r.human_verdict, l.verdict) AS eff, c.alert_id IS NOT NULL AS shut, a.cost_usd AS anchor_cost FROM latest l LEFT JOIN ruled r USING (alert_id) LEFT JOIN closed c USING (alert_id) LEFT JOIN lastreal a ON a.alert_id = l.duplicate_of
  WHERE l.investigated_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND l.investigated_at <= TIMESTAMP '{NOW}')
SELECT count(*) AS alerts, count(*) FILTER (eff = 'true_positive') AS true_positive, count(*) FILTER (eff = 'false_positive') AS false_positive, count(*) FILTER (eff = 'inconclusive') AS inconclusive, count(*) FILTER (escalation_recommended) AS escalations,
  count(*) FILTER (is_campaign) AS campaigns, count(*) FILTER (shut) AS auto_closed, count(*) FILTER (duplicate_of IS NOT NULL) AS suppressed, count(cost_usd) FILTER (duplicate_of IS NULL) AS measured, count(*) FILTER (duplicate_of IS NULL AND cost_usd IS NULL) AS unmeasured,
  CAST(sum(CAST(cost_usd AS DECIMAL(18, 6))) FILTER (duplicate_of IS NULL) AS DOUBLE) AS spend_usd, CAST(sum(CAST(cost_usd AS DECIMAL(18, 6))) FILTER (duplicate_of IS NULL) AS DOUBLE) / nullif(count(cost_usd) FILTER (duplicate_of IS NULL), 0) AS mean_usd,
  CAST(sum(CAST(anchor_cost AS DECIMAL(18, 6))) FILTER (duplicate_of IS NOT NULL) AS DOUBLE) AS saved_usd FROM w""")
def digest_week(spark, sf):
    d = ledgers(spark, sf)
    return reports.digest(d.investigations, d.dispositions, d.closures, NOW, 7)


# -- tuning, inventory, retention

_CASES = ", cases AS (SELECT l.*, coalesce(r.human_verdict, l.verdict) AS eff, r.human_verdict IS NOT NULL AS ruled, c.alert_id IS NOT NULL AS shut, l.duplicate_of IS NOT NULL AS supp, l.injection_flags > 0 AS excl FROM latest l LEFT JOIN ruled r USING (alert_id) LEFT JOIN closed c USING (alert_id))"


def _cases(spark, sf):
    d = ledgers(spark, sf)
    return reports.judged(d.investigations, d.dispositions, d.closures)


def _detections_sql(where: str) -> str:
    return _CASES + f""", g AS (SELECT detection, count(*) AS firings, count(*) FILTER (supp) AS suppressed, count(*) FILTER (excl AND NOT supp) AS excluded, count(*) FILTER (NOT supp AND NOT excl AND eff = 'false_positive') AS fp, count(*) FILTER (NOT supp AND NOT excl AND eff = 'true_positive') AS tp,
    count(*) FILTER (NOT supp AND NOT excl AND eff = 'inconclusive') AS inconclusive, count(*) FILTER (NOT supp AND NOT excl AND ruled) AS ruled, count(*) FILTER (NOT supp AND NOT excl AND escalation_recommended) AS escalated, count(*) FILTER (shut) AS auto_closed,
    count(*) FILTER (NOT supp AND NOT excl AND eff = 'true_positive' AND severity IN ('low', 'medium')) AS under_ranked FROM cases {where} GROUP BY detection)
  SELECT g.*, 'rule' AS provenance, coalesce(e.n, 0) AS true_positives_ever, CAST(fp AS DOUBLE) / nullif(fp + tp + inconclusive, 0) AS fp_rate, firings - suppressed - auto_closed AS attention,
    coalesce(CAST(fp AS DOUBLE) / nullif(fp + tp + inconclusive, 0) >= 0.8 AND firings >= 5 AND fp + tp + inconclusive >= 2, false) AS noisy
  FROM g LEFT JOIN (SELECT detection, count(*) AS n FROM cases WHERE NOT supp AND eff = 'true_positive' GROUP BY detection) e USING (detection)"""


@query(_detections_sql(""))
def tuning_detections(spark, sf):
    return reports.detections(_cases(spark, sf))


@query(_detections_sql(f"WHERE investigated_at > TIMESTAMP '{NOW}' - INTERVAL 5 DAY AND investigated_at <= TIMESTAMP '{NOW}'"))
def tuning_detections_windowed(spark, sf):
    return reports.detections(_cases(spark, sf), NOW, 5)


@query(_CASES + """, ent AS (SELECT DISTINCT alert_id, detection, eff, supp, excl, unnest([host, asset, ioc]) AS entity FROM cases),
n AS (SELECT detection, count(*) AS n FROM cases WHERE NOT supp AND NOT excl AND eff = 'false_positive' GROUP BY detection),
f AS (SELECT detection, entity, count(*) AS m FROM ent WHERE NOT supp AND NOT excl AND eff = 'false_positive' GROUP BY ALL)
SELECT f.detection, 'rule' AS provenance, f.entity, n.n AS false_positives, NOT EXISTS (SELECT 1 FROM ent t WHERE NOT t.supp AND t.eff = 'true_positive' AND t.detection = f.detection AND t.entity = f.entity) AS safe FROM f JOIN n ON f.detection = n.detection AND m = n WHERE n >= 2""")
def tuning_exceptions(spark, sf):
    return reports.exceptions(_cases(spark, sf))


@query(_CASES + ", x AS (SELECT DISTINCT alert_id, detection, unnest(attack_techniques) AS technique FROM cases WHERE NOT supp AND eff = 'true_positive') SELECT technique, count(DISTINCT alert_id) AS alerts, string_agg(DISTINCT detection, ',' ORDER BY detection) AS detections FROM x GROUP BY technique")
def confirmed_techniques(spark, sf):
    return reports.confirmed_techniques(_cases(spark, sf))


@query(f", c AS (SELECT CASE WHEN alert_id IN (SELECT alert_id FROM rulings) THEN 'pinned' WHEN investigated_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAY THEN 'archived' ELSE 'retained' END AS class FROM inv) SELECT class, count(*) AS n FROM c GROUP BY class")
def rotation_plan(spark, sf):
    d = ledgers(spark, sf)
    return reports.rotation_plan(d.investigations, d.dispositions, NOW, 14).groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT CAST(CAST(investigated_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM inv GROUP BY 1")
def retention_by_day(spark, sf):
    return ledgers(spark, sf).investigations.groupBy(F.to_date("investigated_at").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(writer, '(unattributed)') AS writer, count(*) AS n FROM inv GROUP BY 1")
def writer_counts(spark, sf):
    return reports.writer_counts(ledgers(spark, sf).investigations)


@query("SELECT writer, max(seq) AS newest, CAST(count(*) AS BIGINT) AS rows FROM inv WHERE writer IS NOT NULL GROUP BY writer")
def newest_by_writer(spark, sf):
    return ledgers(spark, sf).investigations.where("writer is not null").groupBy("writer").agg(ms(F.max("written_at")).alias("newest"), F.count("*").alias("rows"))


@query("SELECT 'desk-a' AS writer, count(*) FILTER (seq % 2 = 0) AS local_rows, count(*) FILTER (seq % 2 = 1) AS shared_rows, count(*) FILTER (seq % 2 = 0) > 0 AND count(*) FILTER (seq % 2 = 1) = 0 AS unmigrated FROM inv WHERE writer = 'desk-a'")
def memory_status(spark, sf):
    i = ledgers(spark, sf).investigations.where("writer = 'desk-a'")
    even = F.col("uid").cast("long") % 2 == 0
    counts = i.groupBy("writer").agg(F.count_if(even).alias("local_rows"), F.count_if(~even).alias("shared_rows"))
    return counts.withColumn("unmigrated", (F.col("local_rows") > 0) & (F.col("shared_rows") == 0))


@query(", s AS (SELECT seq, epoch_ms(investigated_at) AS t_ms, row_number() OVER (ORDER BY seq) AS n FROM inv) SELECT seq, n + greatest(0, max(t_ms - n) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS stamp FROM s")
def migrate_stamps(spark, sf):
    rows = ledgers(spark, sf).investigations.select(F.col("uid").cast("long").alias("seq"), ms("investigated_at").alias("t_ms"))
    return lg.increasing_stamps(rows).select("seq", "stamp")


@query("SELECT seq, sha256(host || '|' || detection || '|' || verdict) AS h, row_number() OVER (PARTITION BY host, detection, verdict ORDER BY seq) - 1 AS occurrence FROM inv")
def content_occurrence(spark, sf):
    rows = ledgers(spark, sf).investigations.withColumn("h", F.sha2(F.concat_ws("|", "host", "detection", "verdict"), 256))
    return rows.select(F.col("uid").cast("long").alias("seq"), "h", lg.occurrence("h").cast("long").alias("occurrence"))


@query("SELECT lower(lpad(to_hex(seq), 12, '0')) || lower(lpad(to_hex(seq % 1000), 6, '0')) || '-x' AS uid FROM inv")
def sortable_uids(spark, sf):
    return ledgers(spark, sf).investigations.select(lg.sortable_uid(F.col("written_at"), F.col("uid").cast("long") % 1000, F.lit("-x")).alias("uid"))


@query("""SELECT l.alert_id, l.verdict AS our_verdict, r.human_verdict AS label, l.verdict = r.human_verdict AS agreed FROM latest l JOIN ruled r USING (alert_id) WHERE l.duplicate_of IS NULL""")
def exportable_cases(spark, sf):
    d = ledgers(spark, sf)
    return sinks.labelled_cases(d.investigations, d.dispositions)


@query("SELECT alert_id FROM ruled EXCEPT SELECT alert_id FROM latest WHERE duplicate_of IS NULL")
def blocked_exports(spark, sf):
    d = ledgers(spark, sf)
    return lg.latest(d.dispositions, "alert_id").exceptAll(dedup.real(lg.latest(d.investigations, "alert_id", "duplicate_of")).select("alert_id"))


_INCOMING = """, incoming AS (SELECT seq, alert_id, CASE WHEN k % 4 = 0 THEN 'C0' ELSE 'C' || (seq - seq % 10 + 1) END AS case_id, CASE WHEN k % 9 = 5 THEN 'unsure' ELSE ['true_positive', 'false_positive', 'inconclusive'][k % 3 + 1] END AS human_verdict,
    'k=' || CASE WHEN k % 2 = 0 THEN k ELSE k + 1 END AS summary FROM inv),
lastin AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) = 1), made AS (SELECT * FROM created QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) = 1),
judged AS (SELECT i.*, CASE WHEN m.alert_id IS NULL THEN 'no local record' WHEN i.case_id <> m.case_id THEN 'id mismatch' WHEN i.human_verdict = 'unsure' THEN 'unknown verdict' END AS refused FROM lastin i LEFT JOIN made m USING (alert_id))"""


def _incoming(spark, sf):
    """Rulings of a case tool on all alerts; some come under a wrong case or with a word that is no verdict."""
    i = ledgers(spark, sf).investigations
    k, seq = F.regexp_extract(F.element_at("iocs", 1), r"(\d+)$", 1).cast("long"), F.col("uid").cast("long")
    human = F.when(k % 9 == 5, "unsure").otherwise(F.element_at(F.array(*map(F.lit, ("true_positive", "false_positive", "inconclusive"))), (k % 3 + 1).cast("int")))
    case = F.concat(F.lit("C"), F.when(k % 4 == 0, F.lit(0)).otherwise(seq - seq % 10 + 1).cast("string"))
    return i.select(*lg.ORDER, "alert_id", case.alias("case_id"), human.alias("human_verdict"), F.concat(F.lit("k="), (k + k % 2).cast("string")).alias("summary"))


@query(_INCOMING + " SELECT j.alert_id, j.human_verdict, j.summary FROM judged j LEFT JOIN ruled r USING (alert_id) WHERE refused IS NULL AND NOT (j.human_verdict IS NOT DISTINCT FROM r.human_verdict AND j.summary IS NOT DISTINCT FROM r.summary)")
def sync_dispositions(spark, sf):
    """Rulings from the case tool that differ from what is recorded, for alerts that it got from us."""
    d = ledgers(spark, sf)
    return feedback.changed_rulings(_incoming(spark, sf), d.created_alerts, d.dispositions).select("alert_id", "human_verdict", "summary")


@query(_INCOMING + " SELECT alert_id, refused FROM judged")
def ruling_provenance(spark, sf):
    return feedback.judged_rulings(_incoming(spark, sf), ledgers(spark, sf).created_alerts).select("alert_id", "refused")


@query("SELECT l.alert_id, l.verdict, r.human_verdict, r.human_verdict = l.verdict AS human_agrees FROM latest l LEFT JOIN ruled r USING (alert_id)")
def stamped_results(spark, sf):
    """Results documents with the ruling on them."""
    d = ledgers(spark, sf)
    return sinks.stamp_rulings(sinks.results_document(d.investigations), d.dispositions).select("alert_id", "verdict", "human_verdict", "human_agrees")


@query("SELECT alert_id, CAST(sum(CAST(cost_usd AS DECIMAL(18, 6))) AS DOUBLE) AS cost_usd, count(*) AS passes FROM inv GROUP BY alert_id")
def tier_cost(spark, sf):
    return ledgers(spark, sf).investigations.groupBy("alert_id").agg(F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double").alias("cost_usd"), F.count("*").alias("passes"))


# -- watchdog and evaluation

_CYCLES = """, cyc AS (SELECT u AS desk, seq AS cycle, seq % 97 = 0 AS crashed, CAST(t = 'error' AS INT) + CAST(t = 'click' AS INT) + CAST(t = 'view' AS INT) AS failed, CAST(t = 'signup' AS INT) AS worked, CASE WHEN t IN ('error', 'click', 'view') THEN 'A' || (seq % 3) END AS fid FROM inv),
s AS (SELECT *, crashed OR (failed > 0 AND worked = 0) AS sick FROM cyc), b AS (SELECT *, count(*) FILTER (NOT sick) OVER (PARTITION BY desk ORDER BY cycle) AS blk FROM s),
r AS (SELECT *, count(*) FILTER (sick) OVER w AS streak, coalesce(bool_or(crashed) FILTER (sick) OVER w, false) AS crash, len(list_distinct(coalesce(list(fid) FILTER (sick AND fid IS NOT NULL) OVER w, []))) AS ids FROM b WINDOW w AS (PARTITION BY desk, blk ORDER BY cycle ROWS UNBOUNDED PRECEDING))"""


@query(_CYCLES + " SELECT desk, cycle, streak, CASE WHEN sick AND streak >= 5 AND (crash OR ids > 1) THEN 'exit' WHEN sick AND streak = 3 THEN 'page' END AS action FROM r")
def watchdog_streaks(spark, sf):
    seq, kind = F.col("uid").cast("long"), F.regexp_extract("title", r"^Alert (\w+)-", 1)
    fails = kind.isin("error", "click", "view")
    cycles = ledgers(spark, sf).investigations.select(
        F.regexp_extract("host", r"(\d+)$", 1).cast("long").alias("desk"), seq.alias("cycle"), (seq % 97 == 0).alias("crashed"), fails.cast("int").alias("failed"), (kind == "signup").cast("int").alias("worked"),
        F.when(fails, F.array(F.concat(F.lit("A"), (seq % 3).cast("string")))).otherwise(F.array().cast("array<string>")).alias("failed_ids"),
    )
    return reports.consecutive_sick(cycles, exit_after=5).select("desk", "cycle", "streak", "action")


_TALLY = ", res AS (SELECT t AS fixture, confidence AS mode, 'p' || (k % 10) AS property, seq % 2 AS half, verdict = ['true_positive', 'false_positive', 'inconclusive'][k % 3 + 1] AS ok FROM inv)"


def _results(spark, sf):
    k = F.regexp_extract(F.element_at("iocs", 1), r"(\d+)$", 1).cast("long")
    human = F.element_at(F.array(*map(F.lit, ("true_positive", "false_positive", "inconclusive"))), (k % 3 + 1).cast("int"))
    return ledgers(spark, sf).investigations.select(F.regexp_extract("title", r"^Alert (\w+)-", 1).alias("fixture"), F.col("confidence").alias("mode"), F.concat(F.lit("p"), (k % 10).cast("string")).alias("property"), (F.col("uid").cast("long") % 2).alias("half"), (F.col("verdict") == human).alias("ok"))


@query(_TALLY + " SELECT fixture, mode, property, count(*) FILTER (ok) AS passed, count(*) AS n, count(*) FILTER (ok) < count(*) AS marginal FROM res GROUP BY ALL")
def calibrate_tally(spark, sf):
    return reports.tally(_results(spark, sf))


@query(_TALLY + """, a AS (SELECT fixture, mode, property, count(*) FILTER (ok) AS passed_a, count(*) AS n_a FROM res WHERE half = 0 AND property <> 'p3' GROUP BY ALL), b AS (SELECT fixture, mode, property, count(*) FILTER (ok) AS passed_b, count(*) AS n_b FROM res WHERE half = 1 AND property <> 'p7' GROUP BY ALL)
  SELECT fixture, mode, property, passed_a, n_a, passed_b, n_b, CASE WHEN n_a IS NULL THEN 'added' WHEN n_b IS NULL THEN 'removed' WHEN passed_a * n_b < passed_b * n_a THEN 'better' WHEN passed_a * n_b > passed_b * n_a THEN 'worse' ELSE 'same' END AS change FROM a FULL JOIN b USING (fixture, mode, property)""")
def ab_diff(spark, sf):
    r = _results(spark, sf)
    return reports.compare_runs(reports.tally(r.where("half = 0 and property <> 'p3'")), reports.tally(r.where("half = 1 and property <> 'p7'")))


@query(_TALLY + " SELECT fixture, mode, string_agg(property || '=' || n, ',' ORDER BY property) AS counts FROM (SELECT fixture, mode, property, count(*) AS n FROM res GROUP BY ALL) GROUP BY ALL")
def calibrate_counters(spark, sf):
    """The counters of a run as one text for each fixture and mode."""
    c = _results(spark, sf).groupBy("fixture", "mode", "property").count()
    pairs = F.array_sort(F.collect_list(F.struct("property", "count")))
    return c.groupBy("fixture", "mode").agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["property"], F.lit("="), x["count"].cast("string"))), ",").alias("counts"))

