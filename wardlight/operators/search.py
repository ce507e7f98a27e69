"""Search over raw events, and the aggregates of the dashboards."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may be searched for: field and column. Fixed values.
FIELDS = {
    "source.ip": "source_ip", "destination.ip": "destination_ip", "user.name": "user_name", "host.name": "host_name", "event.action": "action", "event.category": "category", "event.outcome": "outcome",
    "event.type": "type", "process.name": "process_name", "network.protocol": "protocol", "dns.question.name": "dns_name", "file.hash.sha256": "file_sha256", "url.original": "url",
}
MOST_FILTERS, MOST_HOURS, TOTAL_CAP, TOP = 5, 168, 10_000, 10


def check_filters(filters: list[tuple[str, str]], hours: int) -> None:
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    if isinstance(hours, bool) or not isinstance(hours, int) or not 1 <= hours <= MOST_HOURS:
        raise ValueError(f"1 to {MOST_HOURS} hours")
    for field, value in filters:
        if field not in FIELDS or not isinstance(value, str):
            raise ValueError(f"not searchable: {field}")
        if field.endswith(".ip"):
            if not re.fullmatch(r"[0-9a-fA-F:.]+", value) or "/" in value:
                raise ValueError(f"not a literal address: {value}")


def search_logs(events: DataFrame, filters: list[tuple[str, str]], hours: int, now: Column) -> DataFrame:
    """Events of the hours before now for which all filters hold exactly. Conditions are columns, never text of a query."""
    check_filters(filters, hours)
    recent = (F.col("ts") >= now - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col("ts") <= now)
    return events.where(reduce(lambda a, f: a & (F.col(FIELDS[f[0]]) == f[1]), filters, recent))


def capped_count(df: DataFrame) -> DataFrame:
    """(total, is_lower_bound): how many, counted up to the cap; scanning stops there."""
    n = df.limit(TOTAL_CAP + 1).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(TOTAL_CAP)).cast("long").alias("total"), (F.col("n") > TOTAL_CAP).alias("is_lower_bound"))


def terms(df: DataFrame, column: str, top: int = TOP) -> DataFrame:
    """The most frequent values with their counts, ties by value: a top-k report."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top)


def date_histogram(df: DataFrame, column: str, hours: int, *by: str) -> DataFrame:
    """(bucket, by, n) for every bucket between the first and the last row, empty ones too."""
    step = hours * 3600
    bucket = F.floor(F.unix_seconds(column) / step) * step
    counts = df.groupBy(bucket.alias("bucket"), *by).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo is not null")
    groups = counts.select(*by).distinct().crossJoin(ends) if by else ends  # ends is one row
    spine = groups.select(*by, F.explode(F.sequence("lo", "hi", F.lit(step))).alias("bucket"))
    same = reduce(lambda a, c: a & spine[c].eqNullSafe(counts[c]), by, spine["bucket"] == counts["bucket"])
    return spine.join(counts, same, "left").select(spine["bucket"], *(spine[c] for c in by), F.coalesce("n", F.lit(0)).alias("n"))
