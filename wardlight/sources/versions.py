"""Tables as lists of immutable parts: every change is one new version, made by whoever first creates its file."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .ledger import hadoop_path


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Versioned:
    """A table below ``root``: Parquet folders in ``parts/`` and versions in ``_log/``, each the list of the folders that count.

    A writer stages its rows in a folder of its own and then tries to create the file of the next version, which the file system
    lets only one do. Whoever loses looks at what has changed, and tries the version after it. Nothing is locked, so no
    writer waits for a slow or dead one; rows that were staged and never committed count for nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, _ = hadoop_path(spark, self.root)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        if not self.fs.exists(self._path("_log")):
            return []
        names = [str(s.getPath().getName()) for s in self.fs.listStatus(self._path("_log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> dict:
        """{version, parts, meta} of a version, the newest if none is named; version -1 and no parts before the first."""
        known = self.versions()
        if not known:
            return {"version": -1, "parts": [], "meta": {}}
        number = known[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/_log/{number:020}.json", wholetext=True).first()["value"])

    def _publish(self, staged: str, number: int) -> None:
        """Gives the staged version file its name, if no file has it."""
        target = f"_log/{number:020}.json"
        if str(self.fs.getScheme()) == "file":  # its rename would replace a file; a link can't
            local = lambda name: urlparse(f"{self.root}/{name}").path
            try:
                os.link(local(staged), local(target))
            except FileExistsError:
                raise Conflict(f"version {number} exists") from None
            finally:
                self.fs.delete(self._path(staged), False)
            return
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._path(staged), self._path(target), none)
        except Exception as e:
            if self.fs.exists(self._path(target)):
                self.fs.delete(self._path(staged), False)
                raise Conflict(f"version {number} exists") from e
            raise

    def commit(self, base: dict, parts: list[dict], meta: dict | None = None) -> dict:
        """Makes the version after ``base``; Conflict if it has been made."""
        new = {"version": base["version"] + 1, "parts": parts, "meta": base["meta"] if meta is None else meta}
        staged = f"_log/_{uuid.uuid4().hex}"
        out = self.fs.create(self._path(staged), False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        self._publish(staged, new["version"])
        return new

    def stage(self, df: DataFrame, key: str | None = None, buckets: str | None = None, **options: str) -> dict | None:
        """Writes rows as a part that no version has yet: {name, rows, lo, hi} with the ends of ``key``. None if there are no rows."""
        name = uuid.uuid4().hex
        writer = df.write.options(**options) if options else df.write
        (writer.partitionBy(buckets) if buckets else writer).parquet(f"{self.root}/parts/{name}")
        ends = [F.min(key).cast("string").alias("lo"), F.max(key).cast("string").alias("hi")] if key else [F.lit(None).alias("lo"), F.lit(None).alias("hi")]
        found = self.spark.read.schema(df.schema).parquet(f"{self.root}/parts/{name}").agg(F.count("*").alias("n"), *ends).first()
        if not found["n"]:
            self.discard(name)
            return None
        return {"name": name, "rows": found["n"], "lo": found["lo"], "hi": found["hi"]}

    def discard(self, name: str) -> None:
        self.fs.delete(self._path(f"parts/{name}"), True)

    def folders(self, parts: list[dict]) -> list[str]:
        return [f"{self.root}/parts/{p['name']}" for p in parts]

    def read(self, parts: list[dict] | None = None) -> DataFrame:
        """The rows of these parts, or of the newest version; at least one part must be there."""
        parts = self.snapshot()["parts"] if parts is None else parts
        return self.spark.read.parquet(*self.folders(parts))

    def append_once(self, new: DataFrame, key: str = "uid") -> int:
        """Appends the rows whose key isn't there yet, each key once; how many. A second run appends none.

        Only parts whose range of keys meets that of the new rows are read, and after a lost race only those that have
        come since. Rows without key are left out. Keys that repeat are looked for among the staged keys, and rows are dealt by key only
        if there are any.
        """
        fresh = new.where(F.col(key).isNotNull())
        ends = fresh.agg(F.min(key).cast("string").alias("lo"), F.max(key).cast("string").alias("hi")).first()
        if ends["lo"] is None:
            return 0
        base = self.snapshot()
        checked = {p["name"] for p in base["parts"]}
        near = self._near(base["parts"], ends)
        if near:  # so that the rows are written once, and only those in reach of older parts are shuffled
            inside = F.lit(True)
            if isinstance(new.schema[key].dataType, StringType):
                inside = F.col(key).between(min(p["lo"] for p in near), max(p["hi"] for p in near))
            joined = fresh.where(inside).join(self.read(near).select(key), key, "left_anti").select(*new.columns)
            fresh = fresh.where(~inside).unionByName(joined)
        part = self.stage(fresh, key)
        if part is not None and not self.read([part]).groupBy(key).count().where("count > 1").isEmpty():
            once = self.stage(self.read([part]).dropDuplicates([key]), key)
            self.discard(part["name"])
            part = once
        while part is not None:
            base = self.snapshot()
            near = self._near([p for p in base["parts"] if p["name"] not in checked], part)
            checked |= {p["name"] for p in base["parts"]}
            if near:
                rows = self.read([part])
                fresh = self.stage(rows.join(self.read(near).select(key), key, "left_anti").select(*rows.columns), key)
                self.discard(part["name"])
                part = fresh
                continue  # the newest version may be another by now
            try:
                self.commit(base, [*base["parts"], part])
                return part["rows"]
            except Conflict:
                continue
        return 0

    def _near(self, parts: list[dict], ends) -> list[dict]:
        """The parts whose range of keys meets this one."""
        return [p for p in parts if p["lo"] is not None and p["lo"] <= ends["hi"] and p["hi"] >= ends["lo"]]

    def rewrite(self, make: Callable[[DataFrame], DataFrame], key: str = "uid") -> dict:
        """Replaces all rows by ``make`` of them in one version, as a rotation or a compaction does; again from the start if others were faster."""
        while True:
            base = self.snapshot()
            if not base["parts"]:
                return base
            part = self.stage(make(self.read(base["parts"])), key)
            try:
                return self.commit(base, [part] if part else [])
            except Conflict:
                if part:
                    self.discard(part["name"])

    def rotate(self, archive: Versioned, old, key: str = "uid") -> int:
        """Moves the rows for which ``old`` holds to an archive; how many were new there. They are in the archive before they leave; a run after a crash ends what was begun."""
        if not self.snapshot()["parts"]:
            return 0
        n = archive.append_once(self.read().where(old), key)
        there = archive.read() if archive.snapshot()["parts"] else None
        if there is not None:
            self.rewrite(lambda rows: rows.join(there.select(key), key, "left_anti").select(*rows.columns), key)
        return n

    def vacuum(self, keep: int = 1, age_s: float = 3600.0) -> int:
        """Deletes parts that none of the last ``keep`` versions has, and that are older than any running writer or reader may be."""
        live = {p["name"] for v in self.versions()[-keep:] for p in self.snapshot(v)["parts"]}
        n = 0
        for s in self.fs.listStatus(self._path("parts")) if self.fs.exists(self._path("parts")) else []:
            if str(s.getPath().getName()) not in live and s.getModificationTime() < (time.time() - age_s) * 1000:
                n += bool(self.fs.delete(s.getPath(), True))
        return n
