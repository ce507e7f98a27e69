"""Versions under concurrent and crashing writers; the index and the views against whole scans."""

import os
import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardlight.operators import memory
from wardlight.sources import derived
from wardlight.sources.ledger import latest
from wardlight.sources.versions import Conflict, Versioned

BASE = datetime(2024, 1, 1)
LEDGER = "written_at timestamp, uid string, alert_id string, timestamp timestamp, verdict string, confidence string, title string, host string, iocs array<string>, net24s array<string>"


def uids(table):
    return sorted(r["uid"] for r in table.read().collect())


def frame(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "uid string, n int")


def test_concurrent_writers_give_each_uid_once(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    sets = [[f"u{i:03}" for i in range(k * 10, k * 10 + 25)] for k in range(4)]  # neighbours share fifteen
    done, failed = [], []

    def write(names):
        try:
            done.append(Versioned(spark, root).append_once(frame(spark, names * 2)))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(s,)) for s in sets]
    [t.start() for t in threads]
    [t.join() for t in threads]
    table = Versioned(spark, root)
    assert not failed and uids(table) == sorted({u for s in sets for u in s}) and sum(done) == 55
    assert table.versions() == list(range(len(table.versions()))) and table.append_once(frame(spark, sets[0])) == 0
    with pytest.raises(Conflict):
        table.commit(table.snapshot(0), [])


@pytest.mark.parametrize("step", ["stage", "before", "after"])
def test_a_crash_at_any_step_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, step):
    table = Versioned(spark, f"file://{tmp_path}/t")
    table.append_once(frame(spark, ["a", "b"]))
    publish, stage = Versioned._publish, Versioned.stage

    def crash(self, *a, **k):
        if step == "after":
            publish(self, *a, **k)
        elif step == "stage":
            stage(self, *a, **k)
        raise OSError("killed")

    monkeypatch.setattr(Versioned, "stage" if step == "stage" else "_publish", crash)
    with pytest.raises(OSError, match="killed"):
        table.append_once(frame(spark, ["b", "c"]))
    monkeypatch.undo()
    assert uids(table) == (["a", "b", "c"] if step == "after" else ["a", "b"])
    table.append_once(frame(spark, ["b", "c"]))
    assert uids(table) == ["a", "b", "c"]
    assert table.vacuum(age_s=-10) >= (step != "after") and uids(table) == ["a", "b", "c"]


def test_rotation_is_one_version_and_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    live, archive = Versioned(spark, f"file://{tmp_path}/live"), Versioned(spark, f"file://{tmp_path}/old")
    live.append_once(frame(spark, list("abcdef")))
    before = live.versions()[-1]
    monkeypatch.setattr(live, "rewrite", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        live.rotate(archive, F.col("n") < 3)
    monkeypatch.undo()
    assert uids(live) == list("abcdef") and uids(archive) == list("abc")
    assert live.rotate(archive, F.col("n") < 3) == 0 and uids(live) == list("def") and uids(archive) == list("abc")
    assert live.versions()[-1] == before + 1 and sorted(r["uid"] for r in live.read(live.snapshot(before)["parts"]).collect()) == list("abcdef")
    assert Versioned(spark, f"file://{tmp_path}/none").rotate(archive, F.lit(True)) == 0


def ledger_rows(seed, first, n):
    rng = random.Random(seed)
    out = []
    for i in range(first, first + n):
        ips = [f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(30)}" for _ in range(rng.choice([0, 1, 1, 2]))]
        out.append((BASE + timedelta(minutes=i - rng.choice([0, 0, 0, 40])), f"{i:06}", f"A{rng.randrange(int(first + n) * 4 // 5 + 1)}", BASE + timedelta(hours=rng.randrange(400)), rng.choice(["true_positive", "false_positive"]), "high", "t", rng.choice([None, "h1", "h2", "h3", "h4"]), ips, [ip.rsplit(".", 1)[0] + ".0" for ip in ips]))
    return out


def same(a, b):
    rows = lambda df: sorted(map(str, (df.select(sorted(df.columns)).collect())))
    return rows(a) == rows(b)


def test_index_and_view_equal_scans_after_appends_rotation_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(derived, "SEGMENTS", 2)
    ledger = Versioned(spark, f"file://{tmp_path}/ledger")
    index = derived.PostingIndex(spark, ledger, f"file://{tmp_path}/index")
    view = derived.LatestView(spark, ledger, f"file://{tmp_path}/view", columns=("uid", "verdict"))
    rulings = spark.createDataFrame([(BASE, "r1", "A3", "false_positive", "s"), (BASE, "r2", "A7", "true_positive", None)], "written_at timestamp, uid string, alert_id string, human_verdict string, summary string")
    probe = spark.createDataFrame([("P", BASE + timedelta(hours=200), "h2", ["10.1.2.3", "10.0.1.9"], ["10.1.2.0", "10.0.1.0"])], "alert_id string, timestamp timestamp, host string, iocs array<string>, net24s array<string>")
    assert index.refresh()["parts"] == 0 and index.prior_sightings(probe, rulings) is None and view.read() is None

    def check(all_rows):
        assert same(view.read(), latest(all_rows, "alert_id", "uid", "verdict")) and same(view.get("A3", "A7", "nobody"), latest(all_rows.where("alert_id in ('A3', 'A7')"), "alert_id", "uid", "verdict"))
        assert same(index.prior_sightings(probe, rulings), memory.prior_sightings(probe, all_rows, rulings))
        assert same(index.correlate(probe), memory.correlate(probe, all_rows)) and index.correlate(probe).count() > 0

    for k in range(2):
        ledger.append_once(spark.createDataFrame(ledger_rows(k, 150 * k, 150), LEDGER))
        assert index.refresh() == {"parts": 1, "rebuilt": False, "generation": 0} and view.refresh()["parts"] == 1
    check(ledger.read())
    ledger.append_once(spark.createDataFrame(ledger_rows(5, 300, 50), LEDGER))
    assert index.refresh()["parts"] == 1 and view.refresh()["parts"] == 1 and len(view.table.snapshot()["parts"]) == 1  # compacted
    check(ledger.read())
    ledger.rotate(Versioned(spark, f"file://{tmp_path}/archive"), F.col("uid") < "000100")
    assert index.refresh() == {"parts": 1, "rebuilt": True, "generation": 1} and view.refresh()["rebuilt"]
    check(ledger.read())


def test_a_question_opens_few_files_and_many_are_joined(spark, tmp_path, monkeypatch):
    ledger = Versioned(spark, f"file://{tmp_path}/ledger")
    index = derived.PostingIndex(spark, ledger, f"file://{tmp_path}/index")
    rows = spark.range(6000).selectExpr(
        "timestamp_millis(id) AS written_at", "lpad(CAST(id AS STRING), 8, '0') AS uid", "concat('A', id) AS alert_id", "timestamp_millis(id) AS timestamp", "'x' AS verdict", "'high' AS confidence", "'t' AS title", "concat('h', id % 500) AS host",
        "array(concat('10.', id % 7, '.', id % 11, '.', id % 200)) AS iocs", "array(concat('10.', id % 7, '.', id % 11, '.0')) AS net24s")
    ledger.append_once(rows)
    index.refresh()
    probes = rows.where("uid = '00000042'").withColumn("alert_id", F.lit("P"))
    files = len(index.rows().inputFiles())
    opened = len(index.postings(probes).inputFiles())
    assert files >= 64 and opened <= 12, (files, opened)
    few = index.correlate(probes)
    monkeypatch.setattr(derived, "FEW", 1)
    assert same(few, index.correlate(probes)) and same(few, memory.correlate(probes, rows))
    size = lambda root: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet"))
    whole = size(f"{tmp_path}/ledger/parts")
    ledger.append_once(rows.where("id < 60") if "id" in rows.columns else rows.limit(60).withColumn("uid", F.concat(F.lit("9"), "uid")))
    new = size(f"{tmp_path}/ledger/parts") - whole
    assert index.refresh()["parts"] == 1 and new < 0.25 * whole  # an append reads its own part only


def test_rows_in_reach_of_older_parts_are_written_once(spark, tmp_path, monkeypatch):
    table = Versioned(spark, f"{tmp_path}/t")
    rows = lambda a, b: spark.range(a, b).select(F.format_string("%05d", "id").alias("uid"), F.col("id").alias("n"))
    assert table.append_once(rows(0, 100)) == 100
    staged, stage = [], table.stage
    monkeypatch.setattr(table, "stage", lambda df, *a, **k: staged.append(part := stage(df, *a, **k)) or part)
    assert table.append_once(rows(90, 200)) == 100 and [p["rows"] for p in staged] == [100]
    assert table.append_once(rows(150, 260).unionByName(rows(250, 260))) == 60
    assert table.append_once(rows(0, 260)) == 0
    assert sorted(r["n"] for r in table.read().collect()) == list(range(260))
