"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir``: the table outlives any executor, so a lost
machine costs the rerun of single tasks only.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a single-JVM session gets a temporary folder and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="wardlight-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: All runs that still have tables. An operator's result may read from them, so they stay until ``release``.
LIVE: list[Scratch] = []


def release(since: int = 0) -> None:
    """Deletes all tables of operator runs begun after the first ``since``: for a caller who has stored or used their results."""
    for scratch in LIVE[since:]:
        scratch.drop()


class Scratch:
    """Tables of one operator run. ``keep`` writes one and reads it back; ``drop`` deletes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/wardlight/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.held: list[DataFrame] = []
        self.made = 0
        LIVE.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.held.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables, or all of them if none is named."""
        jvm = self.spark._jvm
        hadoop = self.spark._jsc.hadoopConfiguration()
        gone = [self.paths.pop(id(t)) for t in tables if id(t) in self.paths] if tables else [self.root]
        for path in gone:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(hadoop).delete(target, True)
        self.held = [t for t in self.held if tables and not any(t is x for x in tables)]
        if not tables and self in LIVE:
            LIVE.remove(self)

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of finished steps: it does so once the driver's garbage is collected."""
        gc.collect()
        self.spark._jvm.System.gc()


@contextmanager
def settings(spark, **wanted: str):
    """Within this, the session has these settings (dots of a name as two underscores)."""
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffled_joins(spark):
    """Within this, no table is broadcast whatever its size, so a plan that holds for small tables holds for large ones."""
    return settings(spark, autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")


def filtered_scans(spark):
    """Within this, no table is broadcast, but Spark may send a Bloom filter of a join's small side to the scan of the other, so that texts which no join needs aren't shuffled.

    The filter has a fixed size; beyond its capacity it lets more through, and the join decides in any case.
    """
    bloom = "optimizer__runtime__bloomFilter__"
    wanted = {f"{bloom}enabled": "true", f"{bloom}applicationSideScanSizeThreshold": "1KB", f"{bloom}creationSideThreshold": "1TB"}
    return settings(spark, autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1", **wanted)
