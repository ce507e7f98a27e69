import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wardlight.functions import text
from wardlight.operators import dedup, memory, policy, reports
from wardlight.sources import ledger as lg

T0 = datetime(2026, 4, 19, 3, 14, tzinfo=timezone.utc)
SCHEMA = "written_at timestamp, uid string, alert_id string, timestamp timestamp, investigated_at timestamp, title string, severity string, verdict string, confidence string, host string, iocs array<string>, net24s array<string>, attack_techniques array<string>, cost_usd double, duplicate_of string, writer string, fingerprint string, escalation_recommended boolean, injection_flags int, is_campaign boolean, failed_tools array<string>, detection string, provenance string, asset string"


def row(n, alert_id, hours=0.0, **over):
    base = dict(
        written_at=T0 + timedelta(milliseconds=n), uid=f"{n:06d}", alert_id=alert_id, timestamp=T0 + timedelta(hours=hours), investigated_at=T0 + timedelta(hours=hours, minutes=5), title="t", severity="low",
        verdict="false_positive", confidence="high", host=None, iocs=[], net24s=[], attack_techniques=[], cost_usd=None, duplicate_of=None, writer="me", fingerprint="f", escalation_recommended=False,
        injection_flags=0, is_campaign=False, failed_tools=[], detection="d", provenance="rule", asset=None,
    )
    base |= over
    base["net24s"] = [".".join(i.split(".")[:3]) + ".0" for i in base["iocs"]]
    return tuple(base[f.split()[0]] for f in SCHEMA.split(", "))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rulings(spark, rows):
    return spark.createDataFrame([(T0 + timedelta(milliseconds=n), f"{n:06d}", a, v, "s", T0 + timedelta(hours=h)) for n, a, v, h in rows], "written_at timestamp, uid string, alert_id string, human_verdict string, summary string, recorded_at timestamp")


def generated(seed, n=120):
    rng = random.Random(seed)
    out, at = [], 0.0
    for i in range(n):
        at += rng.uniform(0.1, 3) / 60 - (5 / 60 if rng.random() < 0.05 else 0)
        ips = [f"10.0.{rng.randrange(3)}.{rng.randrange(6)}" for _ in range(rng.randrange(4))]
        out.append(dict(n=i, alert_id=f"A{rng.randrange(int(n * 0.8))}", hours=rng.uniform(-200, 200), iocs=ips, host=rng.choice([None, *"abcdef"]), verdict=rng.choice(["true_positive", "false_positive"]), investigated_at=T0 + timedelta(hours=at), duplicate_of="X" if rng.random() < 0.3 else None, fingerprint=rng.choice("pqrs"), writer=rng.choice(["me", "you", None])))
    return out


def build(spark, gen):
    return frame(spark, [row(**g) for g in gen])


@pytest.mark.parametrize("seed", [1, 7, 42])
def test_sightings_and_correlation_match_brute_force(spark, seed):
    gen = generated(seed)
    probe = dict(n=999, alert_id="P", hours=0.0, iocs=["10.0.1.1", "10.0.2.3"], host="a")
    ledger, probes = build(spark, gen), build(spark, [probe])
    want = {}
    for g in gen:  # the last record that matches
        if set(g["iocs"]) & set(probe["iocs"]):
            want[g["alert_id"]] = (g["verdict"], sorted(set(g["iocs"]) & set(probe["iocs"])))
    got = {r["alert_id"]: (r["verdict"], r["matched_iocs"]) for r in memory.prior_sightings(probes, ledger, rulings(spark, [(1, "A0", "true_positive", 1)])).collect()}
    assert got == want and want

    first = {}
    for g in gen:  # the first record that qualifies
        signals = [f"ioc:{i}" for i in set(g["iocs"]) & set(probe["iocs"])] + ([f"host:{g['host']}"] if g["host"] == "a" else [])
        for p in probe["iocs"]:
            signals += [f"related_ip:{i.rsplit('.', 1)[0]}.0" for i in set(g["iocs"]) if i != p and i.rsplit(".", 1)[0] == p.rsplit(".", 1)[0]]
        if abs(g["hours"]) <= 72 and signals and g["alert_id"] not in first:
            first[g["alert_id"]] = sorted(signals)
    found = {r["alert_id"]: r["signals"] for r in memory.correlate(probes, ledger).collect()}
    assert found == first and {s.split(":")[0] for x in first.values() for s in x} == {"ioc", "host", "related_ip"}


@pytest.mark.parametrize("seed", [1, 7])
def test_anchor_matches_brute_force(spark, seed):
    gen = generated(seed)
    now = T0 + timedelta(hours=3)
    probe = dict(n=999, alert_id="P", fingerprint="q", investigated_at=now)
    got = dedup.find_anchor(build(spark, [probe]), build(spark, gen), hours=2, me="me").collect()
    anchors = [g for g in gen if g["fingerprint"] == "q" and not g["duplicate_of"] and g["writer"] == "me" and now - timedelta(hours=2) <= g["investigated_at"] <= now]
    if not anchors:
        assert got == []
    else:
        last = anchors[-1]
        n = sum(1 for g in gen if g["fingerprint"] == "q" and g["duplicate_of"] and last["investigated_at"] <= g["investigated_at"] <= now)
        assert [(r["anchor_id"], r["suppressions"]) for r in got] == [(last["alert_id"], n)]


def test_window_is_symmetric_and_inclusive(spark):
    ledger = frame(spark, [row(1, "past", -72, host="h"), row(2, "future", 72, host="h"), row(3, "late", 72.001, host="h")])
    got = memory.correlate(frame(spark, [row(9, "P", host="h")]), ledger)
    assert {r["alert_id"] for r in got.collect()} == {"past", "future"}
    assert memory.campaigns(frame(spark, [row(9, "P", host="h")]), got).first()["is_campaign"]


def test_later_record_without_the_indicator_removes_nothing(spark):
    ledger = frame(spark, [row(1, "A", iocs=["1.2.3.4"], verdict="true_positive"), row(2, "A", iocs=[])])
    got = memory.prior_sightings(frame(spark, [row(9, "P", iocs=["1.2.3.4"])]), ledger, rulings(spark, [(1, "A", "true_positive", 1), (2, "A", "false_positive", 2)])).collect()
    assert [(r["verdict"], r["human_verdict"]) for r in got] == [("true_positive", "false_positive")]


def test_suppression_tests_in_order(spark):
    ledger = frame(spark, [row(1, "anchor"), row(2, "dup", 0.1, duplicate_of="anchor")])
    probe = lambda **k: frame(spark, [row(9, "P", 1, **k)])
    none = rulings(spark, []) if False else rulings(spark, [(1, "zzz", "false_positive", 1)])
    reason = lambda p, led=ledger, r=none, cap=25: dedup.suppress(p, led, r, cap=cap).first()["reason"]
    assert reason(probe()) == "clean"
    assert reason(probe(injection_flags=1)) == "injected"
    assert reason(probe(), cap=1) == "cap"
    assert reason(probe(fingerprint="other")) == "no anchor"
    assert reason(probe(), r=rulings(spark, [(1, "dup", "true_positive", 1)])) == "overturned"
    assert reason(probe(), led=frame(spark, [row(1, "anchor", confidence="low")])) == "confidence low"
    assert reason(probe(), led=frame(spark, [row(1, "anchor", failed_tools=["b", "a", "b"])])) == "blind: a, b"


def test_signature_drops_measures_and_keeps_words():
    sig = lambda x: json.loads(dedup.semantic_signature(json.dumps(x)) or "null")
    assert sig({"n": 4, "t": "2026-04-19T03:14:22Z", "x": "12", "message": "try 17 of 30", "ok": True, "e": {}, "l": ["b", 3, "a"]}) == {"message": "try # of #", "ok": True, "l": ["a", "b"]}
    assert sig({"a": None, "b": [1, {}]}) is None and sig([1]) is None and dedup.semantic_signature("no json") is None and dedup.semantic_signature(None) is None
    assert sig({"host": "h", "in": {"host": "k", "Message": ["a 1", ["b 2"]], "x": [{"y": "1.5"}, {"y": "v"}]}}) == {"in": {"host": "k", "Message": ["a #", ["b #"]], "x": [{"y": "v"}]}}


def test_fingerprints_tell_what_signatures_tell(spark):
    logs = ['{"a":"x","n":1}', '{"n":2,"a":"x"}', '{"a":"y","n":1}', '{"message":"at 5"}', '{"message":"at 77"}', None, "broken", '{"l":["q","r"]}', '{"l":["r","q"]}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(logs)], "i int, log string")
    got = {r["i"]: r["f"] for r in df.select("i", dedup.fingerprint(F.lit("s"), F.lit("low"), F.lit("t"), F.lit("h"), F.array(F.lit("b"), F.lit("a")), F.col("log")).alias("f")).collect()}
    same = [[i for i in got if got[i] == got[j]] for j in got]
    assert same == [[0, 1], [0, 1], [2], [3, 4], [3, 4], [5, 6], [5, 6], [7, 8], [7, 8]]


def test_gates(spark):
    df = frame(spark, [row(1, "a"), row(2, "b", verdict="true_positive"), row(3, "c", confidence="low"), row(4, "d", failed_tools=["x"]), row(5, "e", escalation_recommended=True), row(6, "f", injection_flags=2), row(7, "g", is_campaign=True)])
    c = F.col
    gate = policy.auto_close(c("verdict"), c("confidence"), F.lit(None).cast("string"), c("failed_tools"), c("escalation_recommended"), c("injection_flags"), c("is_campaign"))
    got = {r["alert_id"]: (r["g"]["yes"], r["g"]["reason"]) for r in df.select("alert_id", gate.alias("g")).collect()}
    assert got["a"] == (True, "clean") and not any(got[x][0] for x in "bcdefg")
    assert got["d"][1] == "failed lookups: x" and got["g"][1] == "campaign"
    sev = {r["alert_id"]: r["s"] for r in df.select("alert_id", policy.case_severity(c("severity"), c("escalation_recommended"), c("is_campaign")).alias("s")).collect()}
    assert sev["a"] == 1 and sev["e"] == 2 and sev["g"] == 2


def test_empty_denominators_are_null(spark):
    empty = frame(spark, [row(1, "a")]).where("false")
    r = rulings(spark, [(1, "zzz", "false_positive", 1)]).where("false")
    card = reports.scorecard(empty, r, spark.createDataFrame([], "written_at timestamp, uid string, alert_id string, closed_at timestamp")).first()
    assert card["agreement_rate"] is None and card["automation_rate"] is None and card["alerts"] == 0


def test_window_never_hides_danger(spark):
    old = row(1, "old", -24 * 40, verdict="true_positive", asset="scanner")
    new = [row(10 + i, f"n{i}", -i, asset="scanner") for i in range(6)]
    led = frame(spark, [old, *new])
    closures = spark.createDataFrame([], "written_at timestamp, uid string, alert_id string, closed_at timestamp")
    cases = reports.judged(led, rulings(spark, [(1, "zzz", "false_positive", 1)]), closures)
    windowed = reports.detections(cases, "2026-04-20 00:00:00", 30).first()
    assert windowed["firings"] == 6 and windowed["tp"] == 0 and windowed["true_positives_ever"] == 1
    assert {(r["entity"], r["safe"]) for r in reports.exceptions(cases).collect()} == {("scanner", False)}


@pytest.mark.parametrize("n", [1, 2, 5, 9, 10, 11, 20])
def test_percentiles(spark, n):
    rng = random.Random(n)
    times = [rng.randrange(10_000) for _ in range(n)]
    led = frame(spark, [row(i, f"a{i}", investigated_at=T0 + timedelta(milliseconds=t)) for i, t in enumerate(times)])
    got, s = reports.time_to_verdict(led).first(), sorted(times)
    assert got["p90_ms"] == s[-(-9 * n // 10) - 1] and got["median_ms"] == (s[(n - 1) // 2] + s[n // 2]) / 2


def test_unknown_age_is_never_aged_out(spark):
    led = frame(spark, [row(1, "a", investigated_at=None), row(2, "b", -24 * 90), row(3, "c", -24 * 90), row(4, None)])
    got = {r["uid"]: r["class"] for r in reports.rotation_plan(led, rulings(spark, [(1, "b", "false_positive", 1)]), "2026-04-20 00:00:00", 30).collect()}
    assert got == {"000001": "retained", "000002": "pinned", "000003": "archived", "000004": "unclassifiable"}


def test_stamps_increase_like_the_loop(spark):
    rng = random.Random(3)
    times = [rng.randrange(50) for _ in range(200)]
    want, last = [], 0
    for t in times:
        last = max(t, last + 1)
        want.append(last)
    df = spark.createDataFrame(list(enumerate(times)), "seq long, t_ms long")
    got = [r["stamp"] for r in lg.increasing_stamps(df, rows_a_range=16).orderBy("seq").collect()]
    assert got == want


def test_watchdog_matches_the_loop(spark):
    rng = random.Random(4)
    cycles = [("d", i, rng.random() < 0.02, int(rng.random() < 0.8), int(rng.random() < 0.1), [f"a{rng.randrange(2)}"]) for i in range(300)]
    want, streak, paged, crashed, ids = [], 0, False, False, set()
    for _, _, crash, failed, worked, names in cycles:
        action = None
        if crash or failed and not worked:
            streak, crashed, ids = streak + 1, crashed or crash, ids | set(names)
            if streak >= 6 and (crashed or len(ids) > 1):
                action = "exit"
            elif streak >= 3 and not paged:
                action, paged = "page", True
        else:
            streak, paged, crashed, ids = 0, False, False, set()
        want.append(action)
    df = spark.createDataFrame(cycles, "desk string, cycle long, crashed boolean, failed int, worked int, failed_ids array<string>")
    assert [r["action"] for r in reports.consecutive_sick(df, exit_after=6).orderBy("cycle").collect()] == want
    assert {"page", "exit"} <= set(want)


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(text.one_line(F.lit(" a\x1b\n b c  "))) == "a b c"
    assert one(text.net24(F.lit("10.1.2.3"))) == "10.1.2.0" and one(text.net24(F.lit("010.1.2.3"))) is None
    assert one(text.int_to_ipv4(F.lit(16909060))) == "1.2.3.4"
    assert one(text.parent_codes(F.array(F.lit("see T1110.001"), F.lit("T1078")))) == ["T1110", "T1078"]
    assert one(text.parent_by_cut(F.array(F.lit("T1110.001"), F.lit("T1110 - x")))) == ["T1110", "T1110 - X"]
    assert [one(text.is_global(F.lit(i))) for i in ("8.8.8.8", "10.0.0.1", "172.31.0.1", "100.64.0.1")] == [True, False, False, False]
    assert one(text.parse_iso(F.lit("junk"))) is None and one(text.parse_iso(F.lit("2026-04-19T03:14:22Z"))) is not None
    assert one(text.duration(F.lit(-90.0))) == "-1.5m"
