"""Append-only ledgers: reading, appending and the views over them."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ENVELOPE, LEDGERS

#: The total order of a ledger.
ORDER = ("written_at", "uid")


def last_wins(df: DataFrame, *keys: str, order=ORDER) -> DataFrame:
    """The last row of each key in ledger order. Rows without the key are left out. Combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    known = df.where(" and ".join(f"{k} is not null" for k in keys))
    picked = known.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in others)).select(*df.columns)


def first_wins(df: DataFrame, *keys: str, order=ORDER) -> DataFrame:
    """The first row of each key in ledger order."""
    others = [c for c in df.columns if c not in keys]
    known = df.where(" and ".join(f"{k} is not null" for k in keys))
    picked = known.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in others)).select(*df.columns)


def latest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """last_wins for some columns only: no other is read, sorted or shuffled."""
    return last_wins(df.select(key, *ORDER, *(c for c in columns if c not in ORDER)), key).select(key, *columns)


def check_reading(spark: SparkSession) -> None:
    """A partial answer is an error: refuses sessions that are set to skip corrupt or missing files."""
    for name in ("ignoreCorruptFiles", "ignoreMissingFiles"):
        if spark.conf.get(f"spark.sql.files.{name}", "false") == "true":
            raise ValueError(f"spark.sql.files.{name} would hide lost rows")


def read_ledger(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A ledger's JSON lines. A corrupt line is an error, not a missing row; but a last line without line end is still being written and is left out.

    Only the file that has such a line is read in another way, line by line.
    """
    check_reading(spark)
    path = f"{root}/ledger={name}"
    torn = _torn_files(spark, path)
    read = spark.read.schema(LEDGERS[name]).option("mode", "FAILFAST")
    if not torn:
        return read.json(path)
    fs, target = hadoop_path(spark, path)
    whole = [str(f.getPath()) for f in fs.listStatus(target) if str(f.getPath()) not in torn and not str(f.getPath().getName()).startswith(("_", "."))]
    lines = spark.read.text(torn, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", r"(?s)[^\n]*\z", ""), "\n")).alias("value")).where("trim(value) <> ''")
    parsed = lines.select(F.from_json("value", LEDGERS[name], {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return parsed if not whole else read.json(whole).unionByName(parsed)


def _torn_files(spark: SparkSession, path: str) -> list[str]:
    """Files of a folder whose last byte is no line end; compressed ones are never torn by a writer of lines."""
    fs, target = hadoop_path(spark, path)
    out = []
    for f in fs.listStatus(target):
        name = str(f.getPath().getName())
        if f.isFile() and f.getLen() and not name.startswith(("_", ".")) and not name.endswith((".gz", ".zst", ".bz2")):
            stream = fs.open(f.getPath())
            stream.seek(f.getLen() - 1)
            if stream.read() != 10:
                out.append(str(f.getPath()))
            stream.close()
    return out


def stream_ledger(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The same as a stream: new files only, tracked by the query's checkpoint."""
    return spark.readStream.schema(LEDGERS[name]).option("mode", "FAILFAST").json(f"{root}/ledger={name}")


def read_shared(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A ledger out of the shared log; a record that is no JSON is an error."""
    log = spark.read.schema(ENVELOPE).parquet(path).where(F.col("ledger") == name)
    return unpack(log, name)


def unpack(log: DataFrame, name: str) -> DataFrame:
    fields = [f for f in LEDGERS[name].fieldNames() if f not in (*ORDER, "writer")]
    parsed = log.withColumn("_r", F.from_json("record", LEDGERS[name], {"mode": "FAILFAST"}))
    checked = parsed.withColumn("_ok", F.when(F.col("_r").isNull(), F.raise_error(F.lit("a shared record is not valid JSON"))))
    return checked.where("_ok is null").select(*ORDER, *(F.col(f"_r.{f}").alias(f) for f in fields), "writer").select(*LEDGERS[name].fieldNames())


def both_backends(local: DataFrame, shared: DataFrame | None) -> DataFrame:
    return local if shared is None else local.unionByName(shared, allowMissingColumns=True)


def ours(writer: Column, me: str, shared: bool) -> Column:
    """Local rows are all ours; in a shared log only those that name us."""
    return F.lit(not shared) | F.coalesce(writer == me, F.lit(False))


def cold_start(local: DataFrame, shared: DataFrame, me: str) -> bool:
    """Whether local rows exist while the shared log has none of ours: the caller must migrate or say so."""
    return not local.isEmpty() and shared.where(F.col("writer") == me).isEmpty()


def sortable_uid(written_at: Column, number: Column, tail: Column) -> Column:
    """12 hex digits of milliseconds, 6 of a number, and a tail that tells writers apart."""
    hexed = lambda c, n: F.lower(F.lpad(F.hex(c), n, "0"))
    return F.concat(hexed(F.unix_millis(written_at), 12), hexed(number, 6), tail)


def content_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def import_uid(content: Column, number: Column) -> Column:
    """The uid of a migrated row, by its content and how often that stood before: the same on every run."""
    return F.substring(F.sha2(F.concat(content, F.lit(":"), number.cast("string")), 256), 1, 32)


def migrate(local: DataFrame, shared: DataFrame, name: str, writer: str) -> DataFrame:
    """Rows of a local ledger that a shared log lacks, as envelopes (uid, ledger, writer, written_at, record) with strictly increasing stamps.

    A row is known again by its content and the number of equal rows before it, so a second run, or one after a crash, finds
    nothing left to add.
    """
    fields = [c for c in local.columns if c not in (*ORDER, "writer")]
    rows = local.withColumn("_content", content_hash(*fields)).withColumn("_n", occurrence("_content"))
    rows = rows.withColumn("_import", import_uid(F.col("_content"), F.col("_n"))).withColumn("_ms", F.unix_millis("written_at"))
    there = shared.where(F.col("ledger") == name).select(F.col("uid").alias("_import"))
    rows = rows.join(there, "_import", "left_anti")
    order = F.struct(*ORDER)
    numbered = rows.withColumn("_day", F.floor(F.col("_ms") / 3_600_000)).withColumn("_place", F.row_number().over(Window.partitionBy("_day").orderBy(order)))
    sizes = numbered.groupBy("_day").agg(F.count("*").alias("_many"))
    ahead = sizes.select("_day", F.coalesce(F.sum("_many").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row an hour
    dense = numbered.join(ahead, "_day").withColumn("_seq", F.col("_place") + F.col("_before"))
    stamped = increasing_stamps(dense, "_ms", "_seq", "_stamp")
    return stamped.select(F.col("_import").alias("uid"), F.lit(name).alias("ledger"), F.lit(writer).alias("writer"), F.timestamp_millis("_stamp").alias("written_at"), F.to_json(F.struct(*fields)).alias("record"))


def choose_backend(wanted: str | None, local_rows: bool, shared_rows: bool, accept_empty: bool = False) -> str:
    """'local' or 'shared'. A desk whose shared log holds its rows doesn't go back to local files unnoticed, nor to an empty shared log."""
    if wanted not in (None, "", "local", "shared"):
        raise ValueError(f"unknown backend {wanted}")
    if wanted == "shared":
        if local_rows and not shared_rows and not accept_empty:
            raise ValueError("local rows exist and the shared log has none of ours: migrate first, or accept an empty start")
        return "shared"
    if shared_rows and not accept_empty:
        raise ValueError("the shared log has rows of ours: going back to local files would forget them")
    return "local"


def occurrence(hash_column: str, order=ORDER) -> Column:
    """How often the same content stands earlier in the ledger."""
    return F.row_number().over(Window.partitionBy(hash_column).orderBy(*order)) - 1


def increasing_stamps(df: DataFrame, millis: str = "t_ms", order: str = "seq", out: str = "stamp", rows_a_range: int = 1 << 16) -> DataFrame:
    """Strictly increasing stamps: each is its own time or one millisecond after the one before, whichever is later.

    Closed form: the row number plus the running maximum of time minus row number. ``order`` is a dense or sparse whole
    number; ranges of it are numbered on their own, and only a row for each range meets in the window that joins them.
    """
    df = df.withColumn("_range", F.floor(F.col(order) / rows_a_range))
    inner = Window.partitionBy("_range").orderBy(order)
    df = df.withColumn("_n", F.row_number().over(inner))
    tops = df.groupBy("_range").agg(F.count("*").alias("_count"), F.max(F.col(millis) - F.col("_n")).alias("_top"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_ahead", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    tops = tops.withColumn("_high", F.coalesce(F.max(F.col("_top") - F.col("_ahead")).over(before), F.lit(0))).select("_range", "_ahead", "_high")
    joined = df.join(tops, "_range")
    running = F.max(F.col(millis) - F.col("_n") - F.col("_ahead")).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn(out, F.col("_n") + F.col("_ahead") + F.greatest(F.lit(0), F.col("_high"), running)).drop("_range", "_n", "_ahead", "_high")


@contextmanager
def exclusive(spark: SparkSession, path: str, wait_s: float = 600.0):
    """Holds a table's lock file, which the file system creates for one caller only; others wait. A lock older than the wait is taken over."""
    fs, lock = hadoop_path(spark, path.rstrip("/") + ".lock")
    began = time.monotonic()
    while not fs.createNewFile(lock):
        if time.monotonic() - began > wait_s:
            fs.delete(lock, False)
            began = time.monotonic()
        time.sleep(0.2)
    try:
        yield
    finally:
        fs.delete(lock, False)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def append_once(spark: SparkSession, new: DataFrame, path: str, key: str = "uid") -> int:
    """Appends rows whose uid isn't there yet; how many. Running it again appends none.

    Writers take turns by a lock file. Uids sort by time, so only stored rows between the least and the greatest new uid are
    read: the scan skips all other files by their statistics.
    """
    new = new.dropDuplicates([key])
    with exclusive(spark, path):
        fs, target = hadoop_path(spark, path)
        fresh = new
        if fs.exists(target):
            ends = new.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
            if ends["lo"] is None:
                return 0
            there = spark.read.parquet(path)
            near = there.where(F.col(key).between(ends["lo"], ends["hi"])).select(key)
            fresh = new.join(near, key, "left_anti").select(*there.columns)
        fresh = fresh.persist()
        n = fresh.count()
        if n:
            fresh.write.mode("append").parquet(path)
        fresh.unpersist()
    return n


def append(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("append").json(f"{root}/ledger={name}")
