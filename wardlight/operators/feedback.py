"""Analysts' rulings as they come back from the case tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nz
from ..schema import VERDICTS
from ..sources.ledger import latest


def ruling_provenance(ours: Column, case_id: Column, recorded_case: Column) -> Column:
    """Why a ruling isn't taken: 'no local record', 'id mismatch', or null if it is ours."""
    return F.when(~F.coalesce(ours, F.lit(False)), "no local record").when(~case_id.eqNullSafe(recorded_case), "id mismatch")


def judged_rulings(incoming: DataFrame, created: DataFrame) -> DataFrame:
    """The last incoming ruling of each alert, with refused: why it isn't taken, null if it is.

    Only alerts that the case tool got from us count, under the case id that was recorded then, and only known verdicts.
    """
    rest = [c for c in incoming.columns if c not in ("alert_id", "written_at", "uid")]
    last = latest(incoming, "alert_id", "written_at", "uid", *rest)
    known = latest(created, "alert_id", "case_id").select("alert_id", F.col("case_id").alias("_case"), F.lit(True).alias("_ours"))
    j = last.join(known, "alert_id", "left")
    asked = F.col("case_id") if "case_id" in incoming.columns else F.col("_case")
    why = F.coalesce(ruling_provenance(F.col("_ours"), asked, F.col("_case")), F.when(~F.coalesce(F.col("human_verdict").isin(*VERDICTS), F.lit(False)), "unknown verdict"))
    return j.withColumn("refused", why).drop("_case", "_ours")


def changed_rulings(incoming: DataFrame, created: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Incoming rulings that are ours and differ, in verdict or summary, from what is recorded last."""
    fit = judged_rulings(incoming, created).where("refused is null").drop("refused")
    now = latest(dispositions, "alert_id", "human_verdict", "summary").select("alert_id", F.col("human_verdict").alias("_v"), F.col("summary").alias("_s"))
    same = F.col("human_verdict").eqNullSafe(F.col("_v")) & nz(F.col("summary")).eqNullSafe(nz(F.col("_s")))
    return fit.join(now, "alert_id", "left").where(~same).drop("_v", "_s").select(*incoming.columns)


#: What a summary of a record shows. Fixed values.
SUMMARY = ("alert_id", "timestamp", "title", "verdict", "confidence", "host", "iocs", "attack_techniques")


def follow_up(ledger: DataFrame, rulings: DataFrame) -> DataFrame:
    """(alert_id, kind, document): what a question about an alert may draw on: the stored alert and investigation in full, or a summary where they weren't kept, and the ruling."""
    last = latest(ledger, "alert_id", "timestamp", "title", "verdict", "confidence", "host", "iocs", "attack_techniques", "alert", "investigation")
    ruled = latest(rulings, "alert_id", "human_verdict", "source", "summary")
    full = nz(F.col("investigation")).isNotNull()
    part = lambda name, text: F.concat(F.lit(f"# {name}\n"), text)
    body = F.when(full, F.concat_ws("\n\n", part("Alert", F.coalesce("alert", F.lit("null"))), part("Investigation", F.col("investigation")))).otherwise(part("Investigation (summary only)", F.to_json(F.struct(*SUMMARY))))
    ruling = F.when(F.col("human_verdict").isNull(), "# Ruling\nnone").otherwise(F.concat_ws("\n", F.concat(F.lit("# Ruling\n"), "human_verdict", F.lit(" ["), F.coalesce("source", F.lit("?")), F.lit("]")), nz(F.col("summary"))))
    return last.join(ruled, "alert_id", "left").select("alert_id", F.when(full, "full").otherwise("summary").alias("kind"), F.concat_ws("\n\n", body, ruling).alias("document"))
