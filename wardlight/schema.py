"""Schemas of the ledgers. Payloads stay JSON strings at rest and become VARIANT where a query looks into them."""

from pyspark.sql import types as T

VERDICTS = ("true_positive", "false_positive", "inconclusive")
CONFIDENCES = ("high", "medium", "low")
SEVERITIES = ("low", "medium", "high", "critical")

_S, _D, _TS = T.StringType(), T.DoubleType(), T.TimestampType()
_strings = T.ArrayType(_S)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ALERT = _struct(alert_id=_S, timestamp=_TS, source=_S, severity=_S, title=_S, raw_log=_S, indicators=T.MapType(_S, _strings))
EVIDENCE = _struct(source_tool=_S, claim=_S, raw_data=_S, confidence=_S, success=T.BooleanType())
INVESTIGATIONS = _struct(
    written_at=_TS, uid=_S, alert_id=_S, timestamp=_TS, investigated_at=_TS, title=_S, severity=_S, verdict=_S, confidence=_S, host=_S, iocs=_strings,
    attack_techniques=_strings, cost_usd=_D, duration_seconds=_D, duplicate_of=_S, writer=_S, alert=_S, investigation=_S,
)
DISPOSITIONS = _struct(written_at=_TS, uid=_S, alert_id=_S, human_verdict=_S, source=_S, summary=_S, recorded_at=_TS, writer=_S)
CLOSURES = _struct(written_at=_TS, uid=_S, alert_id=_S, reason=_S, closed_at=_TS, writer=_S)
CREATED_ALERTS = _struct(written_at=_TS, uid=_S, alert_id=_S, case_id=_S, created_at=_TS, writer=_S)
WATCH_PROGRESS = _struct(written_at=_TS, uid=_S, alert_id=_S, doc_id=_S, phase=_S, at=_TS, writer=_S)
LEDGERS = {"investigations": INVESTIGATIONS, "dispositions": DISPOSITIONS, "closures": CLOSURES, "created_alerts": CREATED_ALERTS, "watch_progress": WATCH_PROGRESS}
ENVELOPE = _struct(uid=_S, ledger=_S, writer=_S, written_at=_TS, record=_S)
EVENT = _struct(ts=_TS, message=_S, source_ip=_S, destination_ip=_S, destination_port=T.LongType(), user_name=_S, host_name=_S, action=_S, category=_S, outcome=_S, process_name=_S, protocol=_S, dns_name=_S, file_sha256=_S, url=_S)
