"""Case memory: earlier investigations that share something with an alert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nz
from ..sources.ledger import ORDER, last_wins, latest

CORRELATION_HOURS = 72
CAMPAIGN_SIZE = 2
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def prior_sightings(probes: DataFrame, ledger: DataFrame, rulings: DataFrame) -> DataFrame:
    """For each probe, the last record of every other alert that shares an indicator with it, and the analyst's ruling.

    Only records that match take part in the choice, so a later record without the indicator removes nothing. Both sides
    are exploded and meet in an equi-join on the indicator.
    """
    mine = probes.select(F.col("alert_id").alias("probe_id"), F.explode(F.array_distinct("iocs")).alias("ioc"))
    theirs = ledger.select(*ORDER, "alert_id", "timestamp", "verdict", "confidence", "title", F.explode(F.array_distinct("iocs")).alias("ioc"))
    hits = mine.join(theirs, "ioc").where("alert_id <> probe_id")
    records = hits.groupBy("probe_id", "alert_id", *ORDER).agg(F.array_sort(F.collect_set("ioc")).alias("matched_iocs"), *(F.first(c).alias(c) for c in ("timestamp", "verdict", "confidence", "title")))
    last = last_wins(records, "probe_id", "alert_id")
    ruled = latest(rulings, "alert_id", "human_verdict", "summary").withColumnRenamed("summary", "human_summary")
    return last.join(ruled, "alert_id", "left").select("probe_id", "alert_id", "timestamp", "verdict", "confidence", "title", "matched_iocs", "human_verdict", "human_summary")


def newest_overturned(probes: DataFrame, ledger: DataFrame, rulings: DataFrame) -> DataFrame:
    """(probe_id, overturned_id): for each probe the newest of its prior sightings whose verdict an analyst has changed.

    The same as ``policy.overturned_precedents`` of ``prior_sightings``, without their pairs: only ruled alerts count, and of an
    indicator the two newest with different ids are enough, as a probe passes over itself at most. An alert whose last
    record differs from indicator to indicator is paired, for which of them is its last depends on what the probe shares.
    """
    ruled = latest(rulings, "alert_id", "human_verdict").where(nz(F.col("human_verdict")).isNotNull())
    records = ledger.join(ruled, "alert_id").select("alert_id", "human_verdict", *ORDER, "timestamp", "verdict", F.explode(F.array_distinct("iocs")).alias("ioc"))
    last = last_wins(records, "ioc", "alert_id").withColumn("changed", F.col("human_verdict") != F.col("verdict"))
    order = F.struct(*ORDER)
    several = last.groupBy("alert_id").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).where("lo <> hi").select("alert_id")
    newest = F.row_number().over(Window.partitionBy("ioc").orderBy(F.desc("timestamp"), F.desc("alert_id")))
    best = last.join(several, "alert_id", "left_anti").where("changed").select("ioc", "alert_id", "timestamp", newest.alias("place")).where("place <= 2")
    mine = probes.select(F.col("alert_id").alias("probe_id"), F.explode(F.array_distinct("iocs")).alias("ioc"))
    once = mine.join(best, "ioc").where("alert_id <> probe_id").select("probe_id", "timestamp", "alert_id")
    paired = mine.join(last.join(several, "alert_id"), "ioc").where("alert_id <> probe_id").groupBy("probe_id", "alert_id").agg(F.max(F.struct(*ORDER, "timestamp", "changed")).alias("r"))
    rest = paired.where("r.changed").select("probe_id", F.col("r.timestamp").alias("timestamp"), "alert_id")
    return once.unionByName(rest).groupBy("probe_id").agg(F.max(F.struct("timestamp", "alert_id")).alias("r")).select("probe_id", F.col("r.alert_id").alias("overturned_id"))


def related_records(probes: DataFrame, ledger: DataFrame, hours: int = CORRELATION_HOURS) -> DataFrame:
    """(probe_id, alert_id, order, signal): every link by indicator, host or /24 within the window, on event time, both ways.

    An OR of three conditions would be a nested loop; this is a union of three equi-joins by the key and a span of time as
    long as the window, of which a probe looks into three; so a frequent key meets only what happened around the probe.
    Technique overlap never links.
    """
    window_us = hours * 3_600_000_000
    span = lambda c: F.floor(F.unix_micros(c) / window_us)
    looks = lambda mine: mine.withColumn("span", F.explode(F.array(span("p_time") - 1, span("p_time"), span("p_time") + 1)))
    spans = lambda theirs: theirs.withColumn("span", span("timestamp"))

    def link(name: str, mine: DataFrame, theirs: DataFrame) -> DataFrame:
        near = F.abs(F.unix_micros("p_time") - F.unix_micros("timestamp")) <= window_us
        return looks(mine).join(spans(theirs), ["key", "span"]).where(near & (F.col("alert_id") != F.col("probe_id"))).select("probe_id", "alert_id", *ORDER, F.concat(F.lit(f"{name}:"), "key").alias("signal"))

    side = lambda df, key, *cols: df.select(*cols, key.alias("key")).where("key is not null and key <> ''")
    p = [F.col("alert_id").alias("probe_id"), F.col("timestamp").alias("p_time")]
    r = [F.col("alert_id"), *map(F.col, ORDER), F.col("timestamp")]
    shared = link("ioc", side(probes, F.explode(F.array_distinct("iocs")), *p), side(ledger, F.explode(F.array_distinct("iocs")), *r))
    host = link("host", side(probes, F.col("host"), *p), side(ledger, F.col("host"), *r))
    pair = lambda df: F.explode(F.array_distinct(F.zip_with("net24s", "iocs", lambda n, i: F.struct(n.alias("net"), i.alias("ip")))))
    mine = probes.select(*p, pair(probes).alias("x")).select("probe_id", "p_time", F.col("x.net").alias("key"), F.col("x.ip").alias("p_ip")).where("key is not null")
    theirs = ledger.select(*r, pair(ledger).alias("x")).select("alert_id", *ORDER, "timestamp", F.col("x.net").alias("key"), F.col("x.ip").alias("ip")).where("key is not null")
    near = F.abs(F.unix_micros("p_time") - F.unix_micros("timestamp")) <= window_us
    subnet = looks(mine).join(spans(theirs), ["key", "span"]).where(near & (F.col("alert_id") != F.col("probe_id")) & (F.col("ip") != F.col("p_ip"))).select("probe_id", "alert_id", *ORDER, F.concat(F.lit("related_ip:"), "key").alias("signal"))
    return shared.unionByName(host).unionByName(subnet)


def correlate(probes: DataFrame, ledger: DataFrame, hours: int = CORRELATION_HOURS) -> DataFrame:
    """For each probe and related alert, the first record that qualifies, with all its signals in order."""
    records = related_records(probes, ledger, hours).groupBy("probe_id", "alert_id", *ORDER).agg(F.array_sort(F.collect_list("signal")).alias("signals"))
    first = records.groupBy("probe_id", "alert_id").agg(F.min(F.struct(*ORDER, "signals")).alias("f"))
    return first.select("probe_id", "alert_id", F.col("f.uid").alias("uid"), F.col("f.signals").alias("signals"))


def with_techniques(related: DataFrame, probes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Notes shared techniques on pairs that are already linked."""
    pair = related.join(probes.select(F.col("alert_id").alias("probe_id"), F.col("attack_techniques").alias("mine")), "probe_id").join(ledger.select("uid", F.col("attack_techniques").alias("theirs")), "uid")
    extra = F.transform(F.array_sort(F.array_intersect("mine", "theirs")), lambda x: F.concat(F.lit("technique:"), x))
    return pair.withColumn("signals", F.concat("signals", extra)).drop("mine", "theirs")


def campaigns(probes: DataFrame, related: DataFrame, size: int = CAMPAIGN_SIZE) -> DataFrame:
    """(probe_id, related, is_campaign) for every probe, unrelated ones too."""
    counts = related.groupBy("probe_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return probes.select(F.col("alert_id").alias("probe_id")).distinct().join(counts, "probe_id", "left").select("probe_id", n.alias("related"), (n >= size).alias("is_campaign"))


def triage(probes: DataFrame, sightings: DataFrame, related: DataFrame) -> DataFrame:
    """Priority of each probe: severity, campaign or relation, and whether a true positive recurs; with the reasons."""
    effective = F.coalesce(nz(F.col("human_verdict")), F.col("verdict"))
    recurring = sightings.where(effective == "true_positive").groupBy("probe_id").agg(F.max(F.struct("timestamp", "alert_id")).alias("r")).select("probe_id", F.col("r.alert_id").alias("recurs"))
    p = probes.select(F.col("alert_id").alias("probe_id"), "severity", *ORDER).join(campaigns(probes, related), "probe_id").join(recurring, "probe_id", "left")
    rank = F.coalesce(*(F.when(F.col("severity") == s, n) for s, n in SEVERITY_RANK.items()), F.lit(2))
    linked = F.when(F.col("is_campaign"), 100).when(F.col("related") > 0, 25).otherwise(0)
    score = rank * 10 + linked + F.when(F.col("recurs").isNotNull(), 50).otherwise(0)
    because = F.concat_ws(
        ", ", F.concat(F.lit("severity="), "severity"),
        F.when(F.col("is_campaign"), "campaign-correlated").when(F.col("related") > 0, F.concat(F.col("related").cast("string"), F.lit(" related prior(s)"))),
        F.when(F.col("recurs").isNotNull(), F.concat(F.lit("recurs a true positive ("), "recurs", F.lit(")"))),
    )
    return p.select("probe_id", score.cast("long").alias("score"), because.alias("reason"), *ORDER)


def queue(scored: DataFrame, most: int | None = None) -> DataFrame:
    """The order of work: high scores first, then as they came."""
    ordered = scored.orderBy(F.desc("score"), *ORDER)
    return ordered if most is None else ordered.limit(most)


def queue_rank(scored: DataFrame, seconds: int = 3600) -> DataFrame:
    """Each alert's place in the queue, as a column.

    Alerts are numbered within their score and hour, and the sizes of what comes before are added: no task sorts a whole
    score, and the window that adds them up has one row for each score and hour.
    """
    scored = scored.withColumn("_span", F.floor(F.unix_seconds("written_at") / seconds))
    inner = scored.withColumn("_n", F.row_number().over(Window.partitionBy("score", "_span").orderBy(*ORDER)))
    sizes = scored.groupBy("score", "_span").count()
    before = Window.orderBy(F.desc("score"), "_span").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select(F.col("score").alias("_s"), F.col("_span").alias("_t"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ahead"))
    joined = inner.join(ahead, F.col("score").eqNullSafe(F.col("_s")) & F.col("_span").eqNullSafe(F.col("_t")))
    return joined.withColumn("rank", (F.col("_n") + F.col("_ahead")).cast("long")).drop("_n", "_ahead", "_span", "_s", "_t")
