from wardlight.operators import assets


def test_groups_are_sought_once_for_each_set_of_codes(spark):
    rows = [(i, ["T1.1 T1001.002", "T1002"]) for i in range(50)] + [(50, ["T1002"]), (50, ["see T1001.002"]), (51, ["none"]), (52, None), (53, ["T1003", "T1003"])]
    alerts = spark.createDataFrame(rows, "alert_id int, attack_techniques array<string>")
    groups = spark.createDataFrame([("T1001", "g1"), ("T1001.002", "g1"), ("T1002", "g1"), ("T1002", "g0"), ("T1003", "g2")], "tcode string, `group` string")
    got = {(r["alert_id"], r["group"]): (r["overlap"], r["techniques"], r["rank"]) for r in assets.rank_groups(alerts, groups).collect()}
    both = {(i, g): v for i in range(51) for g, v in {"g1": (2, ["T1001.002", "T1002"], 1), "g0": (1, ["T1002"], 2)}.items()}
    assert got == both | {(53, "g2"): (1, ["T1003"], 1)}
    assert assets.set_hits(assets.technique_sets(alerts), groups).count() == 5  # not 50 times as many
