"""The desk as streams: tailing the shared log, the loop of cycles, feedback, the health of cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import consecutive_sick
from ..operators.feedback import changed_rulings
from ..sources.ledger import append_once, hadoop_path, last_wins, unpack
from .state import latest_by_key, suppress_in_flight, suppressions_in_flight, watchdog

LAG = "300 seconds"


def tail(log: DataFrame, name: str, lag: str = LAG) -> DataFrame:
    """Records of one ledger from a stream of the shared log, each uid once.

    A stamp in the future is taken as now, so that a bad clock can't move the watermark on; what comes later than the lag
    is missed.
    """
    stamped = log.where(F.col("ledger") == name).withColumn("written_at", F.least("written_at", F.current_timestamp()))
    fresh = stamped.withWatermark("written_at", lag).dropDuplicatesWithinWatermark(["uid"])
    return unpack(fresh, name)


def one_cycle(spark: SparkSession, work, root: str, most: int = 10) -> int:
    """Works on the first ``most`` alerts by priority of those that are pending and have no result yet; how many there were.

    ``work(batch)`` gives result rows with the uid of the alert. An alert whose result wasn't written stays pending and comes again.
    """
    pending, done = f"{root}/pending", f"{root}/results"
    if not exists(spark, pending):
        return 0
    left = spark.read.parquet(pending)
    if exists(spark, done):
        left = left.join(spark.read.parquet(done).select("uid"), "uid", "left_anti")
    taken = left.orderBy(F.desc("score"), "written_at", "uid").limit(most).persist()
    n = taken.count()
    if n:
        append_once(spark, work(taken), done)
    taken.unpersist()
    return n


def run_desk(alerts: DataFrame, work, root: str, checkpoint: str, interval: str = "60 seconds", most: int = 10, once: bool = False):
    """Starts the watch: alerts are stored as pending when they arrive, and each trigger takes the first ``most`` of all that pend.

    A trigger comes every ``interval``, with new alerts or without. With ``once``, cycles follow each other until no alert that has
    results to give is left. A batch or a cycle that is run again appends nothing twice, and none is lost.
    """

    def cycle(batch: DataFrame, batch_id: int) -> None:
        append_once(batch.sparkSession, batch.where("uid is not null"), f"{root}/pending")
        before = -1
        while one_cycle(batch.sparkSession, work, root, most) and once:
            now = batch.sparkSession.read.parquet(f"{root}/results").count()
            if now == before:  # work gives nothing for what is left
                break
            before = now

    if not once:
        beat = alerts.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
        alerts = alerts.unionByName(beat.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in alerts.schema)))
    writer = alerts.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


#: What is written for an alert, in this order; the closure comes last but for the mark of progress.
STEPS = ("investigation", "results", "status", "closure", "progress")


def write_in_order(spark: SparkSession, batch: DataFrame, makers: dict, root: str) -> dict[str, int]:
    """Appends what ``makers`` (step: function of the batch) give, step by step in the order of STEPS; how many rows each.

    A step that fails stops those after it, and running the whole again writes only what is missing.
    """
    unknown = set(makers) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps {sorted(unknown)}")
    return {step: append_once(spark, makers[step](batch), f"{root}/{step}") for step in STEPS if step in makers}


def run_feedback(rulings: DataFrame, created: str, dispositions: str, checkpoint: str, interval: str = "300 seconds", once: bool = False):
    """A second stream: rulings of the case tool that are ours and new go to the ledger of dispositions, each once."""

    def sync(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = spark.read.parquet(dispositions) if exists(spark, dispositions) else batch.limit(0)
        append_once(spark, changed_rulings(batch, spark.read.parquet(created), now), dispositions)

    writer = rulings.writeStream.foreachBatch(sync).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop_path(spark, path)
    return fs.exists(target)


def health_transitions(cycles: DataFrame) -> DataFrame:
    """(desk, cycle, sick): cycles at which a desk falls sick or gets well."""
    from pyspark.sql import Window

    c = consecutive_sick(cycles)
    before = F.lag("sick").over(Window.partitionBy("desk").orderBy("cycle"))
    return c.where(F.coalesce(before, F.lit(False)) != F.col("sick")).select("desk", "cycle", "sick")


__all__ = ["tail", "latest_by_key", "suppressions_in_flight", "suppress_in_flight", "watchdog", "one_cycle", "run_desk", "write_in_order", "run_feedback", "health_transitions", "last_wins"]
