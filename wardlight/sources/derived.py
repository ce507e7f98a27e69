"""What is kept beside a versioned ledger so that questions don't read all of it: an index of postings, and views of last records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory
from .ledger import ORDER, last_wins
from .versions import Conflict, Versioned

#: Folders by hash, segments after which all are made one, bytes of a row group, and keys of a question that are looked up rather than joined.
BUCKETS, SEGMENTS, ROW_GROUP, FEW = 64, 16, 4 << 20, 1000


class Derived:
    """Segments made of a ledger's parts: of a new part only a new segment is made. A ledger that has lost parts (rotated, replaced, truncated) starts another generation."""

    def __init__(self, spark: SparkSession, ledger: Versioned, root: str):
        self.spark, self.ledger, self.table = spark, ledger, Versioned(spark, root)

    #: What names a bucket, and the order of rows in one.
    NAMES: tuple[str, ...] = ("key",)
    SORT: tuple[str, ...] = ("key",)

    def make(self, rows: DataFrame) -> DataFrame:
        """The rows of a segment from those of the ledger."""
        raise NotImplementedError

    def _stage(self, rows: DataFrame) -> dict | None:
        # ranges of the order, so that a frequent key is dealt by time too
        rows = rows.withColumn("bucket", self._bucket(*self.NAMES))
        dealt = rows.repartitionByRange("bucket", *self.SORT).sortWithinPartitions("bucket", *self.SORT)
        return self.table.stage(dealt, None, "bucket", **{"parquet.bloom.filter.enabled#key": "true", "parquet.block.size": str(ROW_GROUP)})

    def refresh(self) -> dict:
        """Brings the segments up to the ledger's newest version; {parts: how many were read, rebuilt, generation}."""
        while True:
            source, mine = self.ledger.snapshot()["parts"], self.table.snapshot()
            known = set(mine["meta"].get("source", []))
            now = [p["name"] for p in source]
            rebuilt = bool(known - set(now))
            new = source if rebuilt else [p for p in source if p["name"] not in known]
            generation = mine["meta"].get("generation", 0) + rebuilt
            if not new and not rebuilt:
                return {"parts": 0, "rebuilt": False, "generation": generation}
            segment = self._stage(self.make(self.ledger.read(new))) if new else None
            kept = [] if rebuilt else mine["parts"]
            try:
                self.table.commit(mine, [*kept, segment] if segment else kept, {"source": now, "generation": generation})
            except Conflict:
                if segment:
                    self.table.discard(segment["name"])
                continue
            if len(kept) + 1 > SEGMENTS:
                self.compact()
            return {"parts": len(new), "rebuilt": rebuilt, "generation": generation}

    def merge(self, rows: DataFrame) -> DataFrame:
        """What of all segments' rows still counts."""
        return rows

    def compact(self) -> None:
        """Makes one segment of all; others who refresh meanwhile win, and nothing is lost."""
        base = self.table.snapshot()
        if len(base["parts"]) < 2:
            return
        segment = self._stage(self.merge(self._all(base["parts"])))
        try:
            self.table.commit(base, [segment] if segment else [])
        except Conflict:
            if segment:
                self.table.discard(segment["name"])

    def _bucket(self, *key):
        return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")

    def _all(self, parts: list[dict]) -> DataFrame | None:
        read = [self.spark.read.parquet(f).drop("bucket") for f in self.table.folders(parts)]
        return reduce(DataFrame.unionByName, read) if read else None

    def rows(self, buckets: set[int] | None = None) -> DataFrame | None:
        """All rows, or those of these buckets, whose folders alone are listed and read; None if there are none."""
        parts = self.table.snapshot()["parts"]
        if buckets is None:
            return self._all(parts)
        folders = self.table.folders(parts)
        named = [f"{f}/bucket={b}" for f in folders for b in sorted(buckets)]
        there = [f for f in named if self.table.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f))]
        return self.spark.read.parquet(*there) if there else None


class PostingIndex(Derived):
    """Indicator, host and /24 to the records that have them: (kind, key, ip, order, and what answers show)."""

    NAMES, SORT = ("kind", "key"), ("kind", "key", *ORDER)
    KINDS = ("ioc", "host", "net24")
    SHOWN = ("alert_id", "timestamp", "verdict", "confidence", "title")

    def make(self, rows: DataFrame) -> DataFrame:
        posting = lambda kind, key, ip: F.struct(F.lit(kind).alias("kind"), key.alias("key"), ip.alias("ip"))
        none = F.lit(None).cast("string")
        nets = F.zip_with(F.coalesce("net24s", F.array().cast("array<string>")), F.coalesce("iocs", F.array().cast("array<string>")), lambda n, i: posting("net24", n, i))
        every = F.concat(F.transform(F.array_distinct(F.coalesce("iocs", F.array().cast("array<string>"))), lambda i: posting("ioc", i, none)), F.array(posting("host", F.col("host"), none)), F.array_distinct(nets))
        out = rows.select(*ORDER, *self.SHOWN, F.explode(every).alias("p")).select("p.*", *ORDER, *self.SHOWN)
        return out.where("key is not null and key <> ''")

    def postings(self, probes: DataFrame) -> DataFrame:
        """The postings of all keys of the probes (alert_id, iocs, host, net24s).

        Up to FEW keys are looked up: only their buckets' files are opened, and in them only row groups that may hold a key, by the
        sorted ranges and Bloom filters. More are joined.
        """
        empty = F.array().cast("array<string>")
        key = lambda kind, c: F.transform(c, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
        wanted = F.concat(key("ioc", F.coalesce("iocs", empty)), key("host", F.array("host")), key("net24", F.coalesce("net24s", empty)))
        keys = probes.select(F.explode(wanted).alias("k")).select("k.*").where("key is not null and key <> ''").distinct()
        few = keys.withColumn("bucket", self._bucket("kind", "key")).limit(FEW + 1).collect()
        if len(few) > FEW:
            rows = self.rows()
            return None if rows is None else rows.join(keys, ["kind", "key"])
        rows = self.rows({r["bucket"] for r in few})
        if rows is None:
            return None
        by_kind = {kind: [r["key"] for r in few if r["kind"] == kind] for kind in self.KINDS}
        hit = F.lit(False)
        for kind, names in by_kind.items():
            if names:
                hit = hit | (F.col("kind") == kind) & F.col("key").isin(*names)
        return rows.where(F.col("key").isin(*(r["key"] for r in few))).where(hit)

    def candidates(self, probes: DataFrame) -> DataFrame | None:
        """The records that share anything with the probes, as a ledger that has of their keys only those."""
        found = self.postings(probes)
        if found is None:
            return None
        of = lambda kind, c: F.collect_set(F.when(F.col("kind") == kind, c))
        one = found.groupBy(*ORDER, *self.SHOWN).agg(of("ioc", F.col("key")).alias("own"), F.max(F.when(F.col("kind") == "host", F.col("key"))).alias("host"), of("net24", F.struct("key", "ip")).alias("nets"))
        none = F.transform("own", lambda _: F.lit(None).cast("string"))
        return one.select(*ORDER, *self.SHOWN, "host", F.concat("own", F.col("nets.ip")).alias("iocs"), F.concat(none, F.col("nets.key")).alias("net24s"), "own")

    def prior_sightings(self, probes: DataFrame, rulings: DataFrame) -> DataFrame | None:
        """As memory.prior_sightings on the whole ledger; None if the index has nothing."""
        found = self.candidates(probes)
        return None if found is None else memory.prior_sightings(probes, found.withColumn("iocs", F.col("own")), rulings)

    def correlate(self, probes: DataFrame, hours: int = memory.CORRELATION_HOURS) -> DataFrame | None:
        """As memory.correlate on the whole ledger; None if the index has nothing."""
        found = self.candidates(probes)
        return None if found is None else memory.correlate(probes, found, hours)


class LatestView(Derived):
    """The last record of each key, for some columns: a segment has the last of its parts, a reader takes the last of the segments."""

    def __init__(self, spark: SparkSession, ledger: Versioned, root: str, key: str = "alert_id", columns: tuple[str, ...] = ()):
        super().__init__(spark, ledger, root)
        self.key, self.columns = key, columns

    def make(self, rows: DataFrame) -> DataFrame:
        named = rows.select(F.col(self.key).alias("key"), *ORDER, *(c for c in self.columns if c not in ORDER))
        return last_wins(named, "key")

    def merge(self, rows: DataFrame) -> DataFrame:
        return last_wins(rows, "key")

    def read(self) -> DataFrame | None:
        """(key, columns) of all keys."""
        rows = self.rows()
        return None if rows is None else last_wins(rows, "key").select(F.col("key").alias(self.key), *self.columns)

    def get(self, *keys: str) -> DataFrame | None:
        """(key, columns) of these keys, out of their buckets alone."""
        buckets = self.spark.createDataFrame([(k,) for k in keys], "key string").select(self._bucket("key").alias("b")).distinct()
        rows = self.rows({r["b"] for r in buckets.collect()})
        return None if rows is None else last_wins(rows.where(F.col("key").isin(*keys)), "key").select(F.col("key").alias(self.key), *self.columns)
