"""What is written: records, results, webhook and case payloads, labelled cases, rotated ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import INVESTIGATIONS
from ..functions.text import nz
from .ledger import exclusive, hadoop_path, latest


def investigation_record(results: DataFrame, writer: str) -> DataFrame:
    """The ledger columns of finished investigations; what is missing is null."""
    have = set(results.columns)
    cols = [(F.lit(writer) if f.name == "writer" else F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in INVESTIGATIONS]
    return results.select(*cols)


def results_document(ledger: DataFrame) -> DataFrame:
    """Flat results for dashboards: the newest record of each alert."""
    shown = ("timestamp", "investigated_at", "title", "verdict", "confidence", "host", "attack_techniques", "cost_usd", "duration_seconds")
    return latest(ledger, "alert_id", *shown, "duplicate_of").select("alert_id", *shown, F.col("duplicate_of").isNotNull().alias("is_duplicate"))


def stamp_rulings(results: DataFrame, rulings: DataFrame) -> DataFrame:
    human = latest(rulings, "alert_id", "human_verdict")
    return results.join(human, "alert_id", "left").withColumn("human_agrees", F.col("human_verdict") == F.col("verdict"))


def set_status(queue: DataFrame, decided: DataFrame) -> DataFrame:
    """New state rows (alert_id, status): closed ones and acknowledged ones; the newest row of an alert is its state."""
    return queue.join(decided.select("alert_id", "close"), "alert_id").select("alert_id", F.when(F.col("close"), "closed").otherwise("acknowledged").alias("status"))


def investigated_since(alerts: DataFrame, ledger: DataFrame, since: Column) -> DataFrame:
    return alerts.join(ledger.where(F.col("investigated_at") >= since).select("alert_id"), "alert_id", "left_semi")


def webhook_payload() -> Column:
    reasons = F.concat_ws(", ", F.when(F.col("escalation_recommended"), "escalation recommended"), F.when(F.col("is_campaign"), "campaign-correlated"))
    text = F.concat_ws("\n", F.concat(F.col("alert_id"), F.lit(" needs a human ("), reasons, F.lit(")")), "title", F.concat(F.lit("verdict: "), "verdict", F.lit(" ("), "confidence", F.lit(" confidence)")), F.when(F.size("attack_techniques") > 0, F.concat(F.lit("techniques: "), F.array_join("attack_techniques", ", "))))
    return F.to_json(F.struct(text.alias("text"), "alert_id", "title", "severity", "verdict", "confidence", "escalation_recommended", "is_campaign", "attack_techniques"))


#: Indicator kinds of alerts and observable types of the case tool. Fixed values.
OBSERVABLES = {"ips": "ip", "domains": "domain", "hashes": "hash", "users": "other", "apps": "other"}


def observables(alerts: DataFrame) -> DataFrame:
    """(alert_id, data_type, value): an alert's indicators as observables, once each."""
    kind = F.coalesce(*(F.when(F.col("k") == k, F.lit(v)) for k, v in OBSERVABLES.items()), F.lit("other"))
    rows = alerts.select("alert_id", F.explode("indicators").alias("k", "v")).select("alert_id", kind.alias("data_type"), F.explode("v").alias("value")).where("value <> ''")
    return rows.dropDuplicates(["alert_id", "data_type", "value"])


def tags(techniques: Column, groups: Column) -> Column:
    """Tags of a case: technique codes without labels, three groups at most, once each."""
    bare = F.transform(techniques, lambda t: F.substring_index(F.substring_index(t, " ", 1), ":", 1))
    return F.array_distinct(F.concat(bare, F.slice(groups, 1, 3)))


def labelled_cases(ledger: DataFrame, rulings: DataFrame) -> DataFrame:
    """(alert_id, our_verdict, label, agreed): the last record of alerts that an analyst has ruled; suppressed ones are left out."""
    human = latest(rulings, "alert_id", "human_verdict").withColumnRenamed("human_verdict", "label")
    last = latest(ledger, "alert_id", "verdict", "duplicate_of").where(nz(F.col("duplicate_of")).isNull())
    return last.join(human, "alert_id").select("alert_id", F.col("verdict").alias("our_verdict"), "label", (F.col("verdict") == F.col("label")).alias("agreed"))


def export_cases(ledger: DataFrame, rulings: DataFrame, path: str) -> None:
    """Labelled cases as JSON, a folder for each alert: those of labelled_cases whose alert is stored in full."""
    human = latest(rulings, "alert_id", "source", "summary")
    alerts = latest(ledger, "alert_id", "alert").where("alert is not null")
    labelled_cases(ledger, rulings).join(human, "alert_id").join(alerts, "alert_id").write.mode("overwrite").partitionBy("alert_id").json(path)


def rotate(spark: SparkSession, classed: DataFrame, ledger_path: str, archive_path: str, expected: int) -> DataFrame:
    """Archives what is old, then stages what stays; returns the staged table, or fails if the ledger has grown meanwhile.

    The archive is complete before anything is replaced, so a crash loses nothing.
    """
    if spark.read.parquet(ledger_path).count() != expected:
        raise RuntimeError("the ledger has grown since the plan was made")
    keep = F.col("class") != "archived"
    classed.where(~keep).drop("class").write.mode("append").parquet(archive_path)
    staged = ledger_path.rstrip("/") + ".staged"
    classed.where(keep).drop("class").write.mode("overwrite").parquet(staged)
    return spark.read.parquet(staged)


def publish_staged(spark: SparkSession, ledger_path: str, expected: int) -> None:
    """Puts the staged table in the ledger's place by two renames, under the ledger's lock, each of them checked.

    Rows that were appended since the plan (more than ``expected``) stop it. If the second rename fails, the first is taken back.
    ``recover`` mends what a crash between the two leaves.
    """
    path = ledger_path.rstrip("/")
    fs, here = hadoop_path(spark, path)
    _, staged = hadoop_path(spark, path + ".staged")
    _, before = hadoop_path(spark, path + ".before")
    with exclusive(spark, path):
        if spark.read.parquet(path).count() != expected:
            raise RuntimeError("the ledger has grown since the plan was made")
        if not fs.exists(staged):
            raise RuntimeError(f"nothing to publish: {path}.staged is missing")
        if not fs.rename(here, before):
            raise RuntimeError(f"could not set {path} aside")
        done = False
        try:
            done = fs.rename(staged, here)
        finally:
            if not done:
                fs.rename(before, here)
        if not done:
            raise RuntimeError(f"could not publish {path}.staged")
        fs.delete(before, True)


def recover(spark: SparkSession, ledger_path: str) -> bool:
    """Puts a ledger back that a crash has left set aside; whether there was one."""
    path = ledger_path.rstrip("/")
    fs, here = hadoop_path(spark, path)
    _, before = hadoop_path(spark, path + ".before")
    if fs.exists(here) or not fs.exists(before):
        return False
    if not fs.rename(before, here):
        raise RuntimeError(f"could not restore {path}")
    return True


def write_report(rows: DataFrame, path: str) -> None:
    """A calibration report as one JSON file of lines, ordered; its rows are one for each fixture, mode and property."""
    rows.orderBy("fixture", "mode", "property").coalesce(1).write.mode("overwrite").json(path)
