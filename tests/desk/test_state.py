"""State of streams over several batches and restarts, against plain loops and the batch operators."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wardlight.operators import dedup
from wardlight.streaming import state

BASE = datetime(2024, 3, 1, tzinfo=timezone.utc)


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


LEDGER = "written_at timestamp, uid string, alert_id string, fingerprint string, investigated_at timestamp, duplicate_of string, writer string, verdict string, confidence string, escalation_recommended boolean, injection_flags int, failed_tools array<string>"
PROBES = "written_at timestamp, uid string, alert_id string, fingerprint string, injection_flags int, investigated_at timestamp"
RULINGS = "written_at timestamp, uid string, alert_id string, human_verdict string, fingerprint string"


def run(spark, tmp_path, events, name, **kw):
    """Decisions on events that come in the given files, one a batch, with a restart after each."""
    path, check, out = (f"{tmp_path}/{name}-{x}" for x in ("in", "check", "out"))
    for batch in events:
        batch.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(batch.schema).parquet(path)
        state.suppress_in_flight(stream, **kw).writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return {r["probe_id"]: (r["anchor_id"], r["suppressions"], r["suppressed"], r["reason"]) for r in spark.read.parquet(out).collect()}


def plain(rows, hours, cap, record):
    """The same by a loop over all rows in order."""
    real, copies, worked, ruled, out = [], [], set(), {}, {}
    for r in sorted(rows, key=lambda r: (r["t"], r["uid"], r["kind"])):
        if r["kind"] == 1:
            ruled[r["alert_id"]] = r["human"]
        elif r["kind"] == 0 and r["copy"]:
            copies.append((r["fp"], r["at"]))
        elif r["kind"] == 0:
            real.append(r)
            worked.add(r["alert_id"])
        else:
            now = r["at"]
            fit = [x for x in real if x["fp"] == r["fp"] and x["alert_id"] != r["alert_id"] and now - timedelta(hours=hours) <= x["at"] <= now]
            a = max(fit, key=lambda x: (x["t"], x["uid"]), default=None)
            n = sum(f == r["fp"] and a["at"] <= at <= now for f, at in copies) if a else 0
            of = {x["alert_id"] for x in rows if x["kind"] == 0 and x["fp"] == r["fp"]}
            bad = any(ruled.get(x, "false_positive") != "false_positive" for x in of)
            why = "injected" if r["injected"] else "already investigated" if r["alert_id"] in worked else "no anchor" if a is None else "cap" if n >= cap else "overturned" if bad else None
            if why is None:
                why = f"verdict {a['verdict']}" if a["verdict"] != "false_positive" else f"confidence {a['confidence']}" if a["confidence"] != "high" else "escalated" if a["escalated"] else "blind: x" if a["blind"] else "confirmed" if a["alert_id"] in ruled else "clean"
            yes = why in ("confirmed", "clean")
            if yes and record:
                copies.append((r["fp"], now))
            out[r["alert_id"]] = (a["alert_id"] if a else None, n, yes, why)
    return out


def made(seed, n):
    rng = random.Random(seed)
    rows, t = [], BASE
    for i in range(n):
        t += timedelta(minutes=rng.choice([1, 5, 60, 200]))
        kind = rng.choices([0, 1, 2], [4, 1, 5])[0]
        real = [r["alert_id"] for r in rows if r["kind"] == 0]
        alert = rng.choice(real) if kind == 1 and real else f"P{i}" if kind == 2 and rng.random() < 0.95 or kind == 1 else f"A{i}"
        rows.append({"t": t, "uid": f"{i:05}", "kind": kind, "alert_id": alert, "fp": rng.choice("ffg"), "at": t - timedelta(minutes=rng.choice([0, 0, 3])), "copy": kind == 0 and rng.random() < 0.2, "verdict": rng.choice(["false_positive"] * 6 + ["true_positive"]),
                     "confidence": rng.choice(["high"] * 6 + ["low"]), "escalated": rng.random() < 0.08, "injected": int(rng.random() < 0.05), "blind": rng.random() < 0.08, "human": rng.choice(["false_positive"] * 3 + ["true_positive"])})
    return rows


def tables(spark, rows):
    of = lambda kind: [r for r in rows if r["kind"] == kind]
    ledger = [(r["t"], r["uid"], r["alert_id"], r["fp"], r["at"], "X" if r["copy"] else None, "w", r["verdict"], r["confidence"], r["escalated"], 0, ["x"] if r["blind"] else []) for r in of(0)]
    probes = [(r["t"], r["uid"], r["alert_id"], r["fp"], r["injected"], r["at"]) for r in of(2)]
    rulings = [(r["t"], r["uid"], r["alert_id"], r["human"], f) for r in of(1) for f in {x["fp"] for x in rows if x["kind"] == 0 and x["alert_id"] == r["alert_id"]}]
    return spark.createDataFrame(ledger, LEDGER), spark.createDataFrame(probes, PROBES), spark.createDataFrame(rulings, RULINGS)


def beat(spark, t):
    """An event of no importance that moves the time on."""
    row = [(t, "zz", "none", "beat", 0, t)]
    return state.suppression_events(spark.createDataFrame(row, PROBES), spark.createDataFrame([], LEDGER), spark.createDataFrame([], RULINGS))


def test_decisions_equal_a_loop_whatever_the_batches(spark, tmp_path):
    rows, record = made(4, 150), True
    ledger, probes, rulings = tables(spark, rows)
    events = state.suppression_events(probes, ledger, rulings)
    rng = random.Random(1)
    batch = {r["uid"]: min(2, max(0, i * 3 // len(rows) + (rng.choice([0, 0, 1]) if i % 37 < 3 else 0))) for i, r in enumerate(rows)}  # some come a batch late
    of = spark.createDataFrame(list(batch.items()), "uid string, b int")
    parts = [events.join(of.where(F.col("b") == b), "uid").select(events.columns) for b in range(3)]
    got = run(spark, tmp_path, [*parts, beat(spark, rows[-1]["t"] + timedelta(days=60))], "s", lag=timedelta(days=6), hours=24, cap=2, record=record)
    got.pop("none", None)
    want = plain(rows, 24, 2, record)
    assert got == want
    assert len({why.split()[0] for *_, why in want.values()}) >= 8, {why for *_, why in want.values()}


def test_the_batch_operator_says_the_same_of_the_last_alerts(spark, tmp_path):
    rows = [r for r in made(9, 120) if r["kind"] != 2]
    end = rows[-1]["t"]
    rows += [{**rows[0], "kind": 2, "t": end + timedelta(minutes=i + 1), "uid": f"9{i:04}", "alert_id": f"Q{i}", "fp": "fg"[i % 2], "at": end + timedelta(minutes=i + 1) - timedelta(hours=i % 7), "injected": int(i == 5)} for i in range(40)]
    ledger, probes, rulings = tables(spark, rows)
    events = state.suppression_events(probes, ledger, rulings)
    got = run(spark, tmp_path, [events, beat(spark, end + timedelta(days=60))], "b", lag=timedelta(days=1), cap=5, record=False)
    got.pop("none", None)
    batch = dedup.suppress(probes, ledger, rulings.select("written_at", "uid", "alert_id", "human_verdict"), cap=5).collect()
    assert got == {r["probe_id"]: (r["anchor_id"], r["suppressions"], r["suppressed"], r["reason"]) for r in batch} and len(got) == 40


def test_state_ends_with_the_window_and_late_events_are_dropped(spark, tmp_path):
    base = {"kind": 0, "copy": False, "verdict": "false_positive", "confidence": "high", "escalated": False, "injected": 0, "blind": False, "human": None}
    event = lambda h, kind, name, **kw: {**base, "t": BASE + timedelta(hours=h), "at": BASE + timedelta(hours=h), "kind": kind, "alert_id": name, "uid": f"{h:06.2f}{name}", "fp": "f", **kw}
    stream = lambda *rows: state.suppression_events(*(x for x in (lambda l, p, r: (p, l, r))(*tables(spark, list(rows)))))
    files = [
        stream(event(0, 0, "A"), event(1, 2, "P1"), event(2, 2, "P2"), event(40, 2, "P3")),
        stream(event(3, 0, "late"), event(41, 2, "P4")), beat(spark, BASE + timedelta(days=3)), beat(spark, BASE + timedelta(days=200)),
    ]
    got = run(spark, tmp_path, files, "e", lag=timedelta(hours=1))
    assert {k: v[3] for k, v in got.items() if k != "none"} == {"P1": "clean", "P2": "clean", "P3": "no anchor", "P4": "no anchor"} and got["P2"][1] == 1
    held = spark.read.format("statestore").option("stateVarName", "real").load(f"{tmp_path}/e-check")
    copies = spark.read.format("statestore").option("stateVarName", "worked").load(f"{tmp_path}/e-check")
    assert held.count() == 0 and copies.count() == 0


def test_latest_and_health_over_batches(spark, tmp_path):
    def batches(name, schema, parts, f):
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            got = []
            f(spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")).writeStream.outputMode("update" if name == "l" else "append").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/{name}-check").trigger(availableNow=True).start().awaitTermination()
            yield got

    got = list(batches("l", "alert_id string, uid string, n int", [[("a", "5", 1), ("b", "1", 2), (None, "9", 0)], [("a", "3", 3)], [("a", "7", 4), ("a", "6", 5)]], state.latest_by_key))
    assert [sorted((r["alert_id"], r["uid"], r["n"]) for r in g) for g in got] == [[("a", "5", 1), ("b", "1", 1)], [("a", "5", 2)], [("a", "7", 4)]]
    schema = "desk string, cycle long, crashed boolean, failed int, worked int, failed_ids array<string>"
    parts = [[("d", 1, False, 1, 0, ["x"]), ("d", 0, False, 0, 1, None)], [("d", 2, False, 1, 0, ["x"]), ("e", 1, True, 0, 0, None)], [("d", 3, False, 1, 0, ["y"])], [("d", 4, False, 1, 1, ["y"])]]
    got = list(batches("h", schema, parts, lambda s: state.watchdog(s, page_after=2, exit_after=3)))
    assert [sorted((r["desk"], r["cycle"], r["streak"], r["action"], r["turned"]) for r in g) for g in got] == [
        [("d", 0, 0, None, None), ("d", 1, 1, None, "sick")], [("d", 2, 2, "page", None), ("e", 1, 1, None, "sick")], [("d", 3, 3, "exit", None)], [("d", 4, 0, None, "well")]]
