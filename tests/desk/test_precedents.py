import random
from datetime import datetime, timedelta

from wardlight.operators import memory, policy

LEDGER = "written_at timestamp, uid string, alert_id string, timestamp timestamp, verdict string, confidence string, title string, iocs array<string>"
RULINGS = "written_at timestamp, uid string, alert_id string, human_verdict string, summary string"
BASE = datetime(2024, 1, 1)


def test_newest_overturned_equals_the_pairs(spark):
    rng = random.Random(6)
    rows = [(BASE + timedelta(minutes=i), f"{i:05}", f"A{rng.randrange(60)}", BASE + timedelta(hours=rng.randrange(300)), rng.choice(["true_positive", "false_positive"]), "high", "t", rng.sample("abcdefgh", rng.choice([0, 1, 1, 2, 3]))) for i in range(150)]
    rulings = [(BASE, f"r{i}", f"A{i}", rng.choice(["true_positive", "false_positive", None, ""]), None) for i in range(0, 60, 2)]
    ledger, ruled = spark.createDataFrame(rows, LEDGER), spark.createDataFrame(rulings, RULINGS)
    want = policy.overturned_precedents(memory.prior_sightings(ledger, ledger, ruled))
    got = memory.newest_overturned(ledger, ledger, ruled)
    pairs = lambda df: {(r["probe_id"], r["overturned_id"]) for r in df.collect()}
    assert pairs(got) == pairs(want) and len(pairs(got)) > 20


def test_one_indicator_in_100_000_alerts_makes_no_pairs(spark):
    ledger = spark.range(100_000).selectExpr(
        "timestamp_millis(id) AS written_at", "lpad(CAST(id AS STRING), 8, '0') AS uid", "concat('A', id) AS alert_id", "timestamp_millis(id) AS timestamp", "'false_positive' AS verdict", "'high' AS confidence", "'t' AS title", "array('10.0.0.1') AS iocs")
    rulings = ledger.where("uid % 10 = 0").selectExpr("written_at", "uid", "alert_id", "'true_positive' AS human_verdict", "'' AS summary")
    got = memory.newest_overturned(ledger, ledger, rulings)
    assert {r["overturned_id"]: r["count"] for r in got.groupBy("overturned_id").count().collect()} == {"A99990": 99_999, "A99980": 1}
