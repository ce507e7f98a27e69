"""Growing files and the shared log, batch by batch over restarts, against what stands in them."""

import json
import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wardlight.sources import tail

BASE = datetime(2024, 5, 1, tzinfo=timezone.utc)


@pytest.fixture
def lines(spark, tmp_path):
    root = tmp_path / "ledger"
    root.mkdir()

    class Lines:
        folder = root

        def look(self):
            tail.mirror_lines(spark, str(root), f"{tmp_path}/mirror", f"{tmp_path}/check").awaitTermination()
            return sorted((os.path.basename(r["file"]), r["at"], r["value"]) for r in tail.lines(spark, f"{tmp_path}/mirror").collect())

        def batches(self):
            return len([x for x in os.listdir(f"{tmp_path}/mirror") if x.startswith("batch=")])

        def put(self, name, text, mode="a"):
            with open(root / name, mode) as f:
                f.write(text)

        def want(self):
            out = []
            for name in sorted(os.listdir(root)):
                data, at = (root / name).read_bytes(), 0
                for line in data[: data.rfind(b"\n") + 1].split(b"\n")[:-1]:
                    if line.strip():
                        out.append((name, at, line.decode()))
                    at += len(line) + 1
            return out

    return Lines()


def test_appends_torn_lines_and_rewritten_files(spark, lines, tmp_path, monkeypatch):
    lines.put("a.jsonl", '{"n": 1}\n{"n": 2}\n{"n": 3')
    assert lines.look() == lines.want() and len(lines.want()) == 2
    lines.put("a.jsonl", "}\n\n")  # the torn line is finished
    lines.put("b.jsonl", "é ü\n" * 3)
    assert lines.look() == lines.want() and len(lines.want()) == 6
    written = [r["value"] for r in spark.read.parquet(f"{tmp_path}/mirror/batch=1").collect()]
    assert sorted(written) == ['{"n": 3}', "é ü", "é ü", "é ü"]  # only what is new was read
    lines.put("b.jsonl", "replaced by a longer text\nand more\n", "w")
    assert lines.look() == lines.want()
    lines.put("b.jsonl", "short\n", "w")  # truncated
    assert lines.look() == lines.want()
    lines.put("b.jsonl", "", "w")
    assert lines.look() == lines.want() and all(f == "a.jsonl" for f, *_ in lines.want())
    os.remove(lines.folder / "a.jsonl")
    lines.put("b.jsonl", "again\n")
    assert lines.look() == lines.want() == [("b.jsonl", 0, "again")]
    n = lines.batches()
    assert lines.look() == lines.want() and lines.batches() == n  # nothing new, no batch
    tail.compact(spark, f"{tmp_path}/mirror", log=False)
    lines.put("b.jsonl", "after it\n")
    assert lines.look() == lines.want() and len(lines.want()) == 2


def test_a_rewrite_that_keeps_the_size_is_seen_by_the_bytes_before_the_offset(lines):
    lines.put("a.jsonl", "".join(f"row {i:04}\n" for i in range(50)))
    assert lines.look() == lines.want()
    lines.put("a.jsonl", "".join(f"row {9999 - i:04}\n" for i in range(60)), "w")
    assert lines.look() == lines.want()


def test_ranges_of_a_long_file_have_each_line_once(lines, monkeypatch):
    reader = tail.LineTailReader(str(lines.folder))
    lines.put("a.jsonl", "".join("x" * (i % 23) + f" {i}\n" for i in range(400)) + "y" * 500 + "\nend\ntorn")
    monkeypatch.setattr(tail, "SPLIT", 97)
    monkeypatch.setattr(tail, "STEP", 3)
    parts = reader.partitions({}, reader.latestOffset())
    got = [(r["at"], r["value"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) > 40 and [("a.jsonl", *x) for x in got] == lines.want()


def test_a_batch_whose_file_changes_before_it_is_read_leaves_it_to_the_next(lines):
    reader = tail.LineTailReader(str(lines.folder))
    lines.put("a.jsonl", "one\ntwo\n")
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    lines.put("a.jsonl", "other\n", "w")
    assert [b for p in parts for b in reader.read(p)] == []
    later = reader.partitions(end, reader.latestOffset())
    assert [(r["at"], r["value"], r["reset"]) for p in later for b in reader.read(p) for r in b.to_pylist()] == [(-1, None, True), (0, "other", True)]


@pytest.fixture
def log(spark, tmp_path):
    class Log:
        def put(self, *rows):
            made = [(u, "investigations", "w", BASE + timedelta(seconds=s) if not isinstance(s, datetime) else s, json.dumps({"u": u})) for u, s in rows]
            spark.createDataFrame(made, "uid string, ledger string, writer string, written_at timestamp, record string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")

        def look(self):
            tail.mirror_log(spark, f"{tmp_path}/log", f"{tmp_path}/mirror", f"{tmp_path}/check", lag_ms=60_000).awaitTermination()
            return [r["uid"] for r in tail.log_rows(spark, f"{tmp_path}/mirror").orderBy("written_at", "uid").collect()]

        def read(self, number):
            return sorted(r["uid"] for r in spark.read.parquet(f"{tmp_path}/mirror/batch={number}").collect())

    return Log()


def test_late_rows_within_the_lag_are_spliced_and_later_ones_missed(spark, log, tmp_path):
    log.put(("a", 0), ("b", 1000))
    assert log.look() == ["a", "b"]
    log.put(("c", 1010), ("late", 950))
    assert log.look() == ["a", "late", "b", "c"] and log.read(1) == ["b", "c", "late"]  # the window only
    log.put(("too late", 900))
    assert log.look() == ["a", "late", "b", "c"]
    log.put(("b", 1000))  # the same uid again
    assert log.look() == ["a", "late", "b", "c"]
    tail.compact(spark, f"{tmp_path}/mirror", log=True)
    log.put(("d", 1020))
    assert log.look() == ["a", "late", "b", "c", "d"]


def test_stamps_in_the_future_and_before_1970_freeze_and_empty_nothing(log):
    log.put(("ancient", datetime(1969, 1, 1, tzinfo=timezone.utc)))
    assert log.look() == ["ancient"] == log.look()
    now = datetime.now(timezone.utc)
    log.put(("honest", now), ("future", now + timedelta(days=3650)))
    assert log.look() == ["ancient", "honest", "future"]
    time.sleep(1)
    log.put(("later and honest", datetime.now(timezone.utc)))
    assert log.look() == ["ancient", "honest", "later and honest", "future"]
    log.put(("more", datetime.now(timezone.utc)))
    assert log.look() == ["ancient", "honest", "later and honest", "more", "future"]


def test_files_that_end_before_the_window_are_not_opened(spark, log, tmp_path):
    for i in range(5):
        log.put((f"u{i}", 1000 * i))
    reader = tail.LogTailReader(f"{tmp_path}/log", 60_000)
    end = reader.latestOffset()
    assert (end["written_at"], end["uid"]) == (int((BASE + timedelta(seconds=4000)).timestamp() * 1000), "u4") and len(reader.partitions({}, end)) == 5
    log.put(("u5", 4030))
    assert len(reader.partitions(end, reader.latestOffset())) == 2
    assert reader.partitions(end, end) == [] and tail.LogTailReader(f"{tmp_path}/nothing", 1).latestOffset() == {}
    assert tail.log_rows(spark, f"{tmp_path}/no mirror").count() == 0 == tail.lines(spark, f"{tmp_path}/no mirror").where(F.col("at") > 0).count()
