"""Queries that run as streams over ledgers derived from ``events``, each with the SQL that must give the same rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LEDGERS
from ..sources import tail
from ..sources.adapter import ledgers
from ..storage import Scratch
from ..streaming import state
from .desk import query

_RULINGS = "SELECT alert_id, human_verdict, summary, seq FROM rulings"


@query(_RULINGS)
def tail_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Rulings as they are appended to a ledger of JSON lines, mirrored over a restart."""
    root = Scratch(spark, "tail").root
    rows = ledgers(spark, sf).dispositions
    for part in (0, 1):
        rows.where(F.col("uid").cast("long") % 2 == part).write.mode("append").json(f"{root}/ledger")
        tail.mirror_lines(spark, f"{root}/ledger", f"{root}/mirror", f"{root}/check").awaitTermination()
    parsed = tail.lines(spark, f"{root}/mirror").select(F.from_json("value", LEDGERS["dispositions"], {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.alert_id", "r.human_verdict", "r.summary", F.col("r.uid").cast("long").alias("seq"))


@query(_RULINGS)
def tail_shared_log(spark, sf):
    """Rulings out of a shared log to which every second one comes up to 0.7 s late, spliced by a lag of 1 s."""
    root = Scratch(spark, "log").root
    rows = ledgers(spark, sf).dispositions
    seq = F.col("uid").cast("long")
    log = rows.select("uid", F.lit("dispositions").alias("ledger"), "writer", "written_at", F.to_json(F.struct("alert_id", "human_verdict", "summary")).alias("record"), (seq + 700 * (seq % 2)).alias("comes"))
    last = log.agg(F.max("comes")).first()[0] or 0
    for part in range(3):
        log.where((F.col("comes") * 3 / (last + 1)).cast("int") == part).drop("comes").write.mode("append").parquet(f"{root}/log")
        tail.mirror_log(spark, f"{root}/log", f"{root}/mirror", f"{root}/check", lag_ms=1000).awaitTermination()
    parsed = tail.log_rows(spark, f"{root}/mirror").select("uid", F.from_json("record", "alert_id string, human_verdict string, summary string", {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.alert_id", "r.human_verdict", "r.summary", F.col("uid").cast("long").alias("seq"))


@query(""", pr AS (SELECT 'P' || seq AS probe_id, * FROM inv WHERE seq % 20 = 0),
anc AS (SELECT p.seq, i.seq AS a_seq, i.alert_id AS anchor_id, i.investigated_at AS a_at, i.verdict AS a_verdict, i.confidence AS a_confidence, i.escalation_recommended, i.injection_flags AS a_flags, i.blind
  FROM pr p JOIN inv i ON i.fingerprint = p.fingerprint AND i.duplicate_of IS NULL AND i.seq <= p.seq AND i.investigated_at >= p.investigated_at - INTERVAL 240 HOUR AND i.investigated_at <= p.investigated_at
  QUALIFY row_number() OVER (PARTITION BY p.seq ORDER BY i.seq DESC) = 1),
fr AS (SELECT DISTINCT i.fingerprint, r.alert_id, r.seq AS rseq, r.human_verdict FROM rulings r JOIN inv i ON i.alert_id = r.alert_id),
hv AS (SELECT p.seq, f.alert_id, arg_max(f.human_verdict, f.rseq) AS hv FROM pr p JOIN fr f ON f.fingerprint = p.fingerprint AND f.rseq <= p.seq GROUP BY 1, 2),
bad AS (SELECT DISTINCT seq FROM hv WHERE hv <> 'false_positive')
SELECT p.probe_id, a.anchor_id, CASE WHEN a.seq IS NULL THEN 0 ELSE (SELECT count(*) FROM inv s WHERE s.fingerprint = p.fingerprint AND s.duplicate_of IS NOT NULL AND s.seq <= p.seq AND s.investigated_at >= a.a_at AND s.investigated_at <= p.investigated_at) END AS suppressions,
  CASE WHEN p.injection_flags > 0 THEN 'injected' WHEN a.seq IS NULL THEN 'no anchor' WHEN b.seq IS NOT NULL THEN 'overturned' WHEN a_verdict <> 'false_positive' THEN 'verdict ' || a_verdict WHEN a_confidence <> 'high' THEN 'confidence ' || a_confidence
    WHEN a.escalation_recommended THEN 'escalated' WHEN a_flags > 0 THEN 'injection' WHEN a.blind THEN 'blind: ip_reputation' WHEN x.hv IS NOT NULL THEN 'confirmed' ELSE 'clean' END AS reason
FROM pr p LEFT JOIN anc a ON a.seq = p.seq LEFT JOIN bad b ON b.seq = p.seq LEFT JOIN hv x ON x.seq = p.seq AND x.alert_id = a.anchor_id""")
def suppress_stream(spark, sf):
    """Every twentieth alert as it comes again under a new id, decided in flight on what stands before it.

    All files are one batch, however many: their order isn't that of time, and what a batch brings behind the watermark would be dropped.
    """
    root = Scratch(spark, "suppress").root
    d = ledgers(spark, sf)
    later = lambda df: df.withColumn("written_at", F.col("written_at") + F.expr("INTERVAL 1 DAY"))  # noqa: E731  the watermark begins at 1970, as these stamps do
    again = later(d.probes).withColumn("alert_id", F.concat(F.lit("P"), F.col("uid").cast("long").cast("string")))
    ledger = state.concerned(again, later(d.investigations))
    events = state.suppression_events(again, ledger, state.fingerprinted_rulings(later(d.dispositions), ledger))
    events.write.parquet(f"{root}/events/part=0")
    last = spark.read.schema(events.schema).parquet(f"{root}/events/part=0").agg(F.max("time")).first()[0]
    beat = [("", last + timedelta(days=1), 0, "", state.RULING, "")] if last else []  # moves the time on
    beat = spark.createDataFrame(beat, "fingerprint string, time timestamp, t long, uid string, kind int, alert_id string")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name not in beat.columns]
    beat.select("*", *none).select(*events.columns).write.parquet(f"{root}/events/part=1")
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/events")
    out = state.suppress_in_flight(stream, lag=timedelta(seconds=1), hours=240, record=False)
    out.writeStream.format("parquet").option("checkpointLocation", f"{root}/check").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out").select("probe_id", "anchor_id", "suppressions", "reason")
