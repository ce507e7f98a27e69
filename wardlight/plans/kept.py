"""Queries over versioned ledgers and what is kept beside them, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory
from ..sources.adapter import Ledgers, ledgers
from ..sources.derived import LatestView, PostingIndex
from ..sources.versions import Versioned
from ..storage import Scratch
from .desk import _CORR, _SIGHT, ms, query


def _number():
    return F.col("uid").cast("long")


def _ledger(spark: SparkSession, sf: str, refresh=lambda ledger, root: None) -> tuple[Ledgers, Versioned, str]:
    """The investigations as a versioned ledger, appended in three parts of which each overlaps the next; refresh runs after each."""
    d = ledgers(spark, sf)
    root = Scratch(spark, "kept").root
    ledger = Versioned(spark, f"{root}/ledger")
    last = d.investigations.agg(F.max(_number())).first()[0] or 0
    third = last // 3 + 1
    for k in range(3):
        ledger.append_once(d.investigations.where(_number().between(k * third - third // 10, (k + 1) * third - 1)))
        refresh(ledger, root)
    return d, ledger, root


@query("SELECT alert_id, seq, verdict FROM latest")
def view_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The last record of each alert, out of a view that was kept up to date while the ledger grew."""
    made = lambda ledger, root: LatestView(spark, ledger, f"{root}/view", columns=("uid", "verdict"))
    _, ledger, root = _ledger(spark, sf, lambda ledger, root: made(ledger, root).refresh())
    view = made(ledger, root)
    view.compact()
    return view.read().select("alert_id", _number().alias("seq"), "verdict")


def _index(spark, sf) -> tuple[Ledgers, PostingIndex]:
    made = lambda ledger, root: PostingIndex(spark, ledger, f"{root}/index")
    d, ledger, root = _ledger(spark, sf, lambda ledger, root: made(ledger, root).refresh())
    return d, made(ledger, root)


@query(_SIGHT + " SELECT probe_id, alert_id, epoch_ms(event_ts) AS event_ms, verdict, ioc AS matched, human_verdict FROM sightings")
def index_prior_sightings(spark, sf):
    """Prior sightings out of the index of postings."""
    d, index = _index(spark, sf)
    s = index.prior_sightings(d.probes, d.dispositions)
    return s.select("probe_id", "alert_id", ms("timestamp").alias("event_ms"), "verdict", F.array_join("matched_iocs", ",").alias("matched"), "human_verdict")


@query(_CORR + " SELECT probe_id, alert_id, seq, signals FROM rel")
def index_correlate(spark, sf):
    """Correlation out of the index of postings."""
    d, index = _index(spark, sf)
    return index.correlate(d.probes, memory.CORRELATION_HOURS).select("probe_id", "alert_id", _number().alias("seq"), F.array_join("signals", ",").alias("signals"))


@query("SELECT seq, CASE WHEN verdict = 'false_positive' AND investigated_at < TIMESTAMP '2024-01-10 00:00:00' THEN 'archive' ELSE 'live' END AS place FROM inv")
def versioned_rotation(spark, sf):
    """Where each record stands after parts that overlap were appended and old false positives rotated out."""
    _, ledger, root = _ledger(spark, sf)
    archive = Versioned(spark, f"{root}/archive")
    ledger.rotate(archive, (F.col("verdict") == "false_positive") & (F.col("investigated_at") < F.lit("2024-01-10 00:00:00").cast("timestamp")))
    tables = [(t, name) for t, name in ((ledger, "live"), (archive, "archive")) if t.snapshot()["parts"]]
    rows = [t.read().select(_number().alias("seq"), F.lit(name).alias("place")) for t, name in tables]
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
