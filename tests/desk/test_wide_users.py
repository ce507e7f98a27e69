"""Queries over events at sizes and numbers that the test tables don't have, against their SQL."""

from datetime import datetime, timedelta

import duckdb

import __spark_entry__

KINDS = ("error", "view", "click", "purchase", "signup")


def tables(spark, tmp_path, rows):
    """A folder with these (event_id, user_id, k) as events."""
    start = datetime(2024, 1, 1)
    spark.createDataFrame([(e, start + timedelta(minutes=e), u, KINDS[e % 5], 1.0, f'{{"k": {k}}}') for e, u, k in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def same(spark, name, sf):
    """How many rows the query and its SQL both give."""
    got = __spark_entry__.queries()[name](spark, sf)
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{sf}/events.parquet/*.parquet'")
    want = db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in got.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    return len(want)


USERS = (0, 255, 65535, 65536, 65537, 65538, 65791, 65792, 89999, 1048575, 1048576, 16777216)


def test_owners_of_users_beyond_two_octets(spark, tmp_path):
    sf = tables(spark, tmp_path, [(i, u, (i * 37) % 100) for i, u in enumerate(USERS * 3)])
    assert same(spark, "network_owners", sf) == 2 * 3 * len(USERS)


def test_actions_on_users_beyond_two_octets(spark, tmp_path):
    sf = tables(spark, tmp_path, [(15 * i + n, u, 75 + (i + n) % 25) for i, u in enumerate(USERS) for n in (0, 10)])
    assert same(spark, "reputation_actions", sf) >= len(USERS)


def test_arriving_alerts_in_many_files_are_all_decided(spark, tmp_path):
    sf = tables(spark, tmp_path, [(21 * e, e // 20 % 3, 20 * (e // 5 % 2)) for e in range(600)])
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        assert same(spark, "suppress_stream", sf) == 30
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
