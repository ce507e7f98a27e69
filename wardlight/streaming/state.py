"""Keyed state of the desk's streams: suppression in flight, the last record of a key, the health of desks.

Each is a stateful processor over a grouped stream, with state by key in RocksDB: nothing of it is held for keys that
a batch doesn't touch, and what can end, ends by a timer or a time to live.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.text import nz
from ..operators.dedup import MOST_IN_A_ROW, WINDOW_HOURS

#: Kinds of events of suppression, in the order in which those of one time and uid count.
RECORD, RULING, PROBE = 0, 1, 2
#: How long a real record of an alert counts against the alert's return, and how late an event may come.
REMEMBER = timedelta(days=30)
LAG = timedelta(seconds=300)
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def _life(silent: timedelta | None) -> tuple[int | None, str]:
    """(time to live in milliseconds, time mode). Spark looks after lives by the clock, so such a query makes a batch at every trigger and never ends by itself."""
    return (None, "None") if silent is None else (_micros(silent) // 1000, "ProcessingTime")


def _stateful(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, output: str, time: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return stream.groupBy(key).transformWithState(processor, schema, output, time)


# -- suppression

_EVENT = "t long, uid string, kind int, alert_id string, at long, copy boolean, mine boolean, verdict string, confidence string, human string, escalated boolean, injected long, blind string"
_FIELDS = [x.split()[0] for x in _EVENT.split(", ")]


def suppression_events(probes: DataFrame, ledger: DataFrame, rulings: DataFrame, me: str | None = None) -> DataFrame:
    """(fingerprint, time, and what a decision needs) of alerts that arrive, of records and of rulings, in one table or stream.

    probes: written_at, uid, alert_id, fingerprint, injection_flags, investigated_at (the time at which it is decided).
    ledger: as dedup.suppress takes it. rulings: written_at, uid, alert_id, human_verdict and the fingerprint of a record
    of that alert, one row for each. With ``me``, only records of that writer may be anchors.
    """
    none = lambda kind: F.lit(None).cast(kind)
    mine = F.lit(True) if me is None else F.coalesce(F.col("writer") == me, F.lit(False))
    blind = F.array_join(F.array_sort(F.array_distinct(F.coalesce("failed_tools", F.array().cast("array<string>")))), ", ")
    micros = F.unix_micros("investigated_at").alias("at")
    base = ["fingerprint", F.col("written_at").alias("time"), F.unix_micros("written_at").alias("t"), "uid"]
    no = [none("string").alias(c) for c in ("verdict", "confidence")]
    record = ledger.select(*base, F.lit(RECORD).alias("kind"), "alert_id", micros, nz(F.col("duplicate_of")).isNotNull().alias("copy"), mine.alias("mine"), "verdict", "confidence", none("string").alias("human"), F.col("escalation_recommended").alias("escalated"), F.col("injection_flags").cast("long").alias("injected"), blind.alias("blind"))
    ruling = rulings.select(*base, F.lit(RULING).alias("kind"), "alert_id", none("long").alias("at"), none("boolean").alias("copy"), none("boolean").alias("mine"), *no, F.col("human_verdict").alias("human"), none("boolean").alias("escalated"), none("long").alias("injected"), none("string").alias("blind"))
    probe = probes.select(*base, F.lit(PROBE).alias("kind"), "alert_id", micros, none("boolean").alias("copy"), none("boolean").alias("mine"), *no, none("string").alias("human"), none("boolean").alias("escalated"), F.col("injection_flags").cast("long").alias("injected"), none("string").alias("blind"))
    return record.unionByName(ruling).unionByName(probe)


def fingerprinted_rulings(rulings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rulings with the fingerprint of each record of their alert."""
    of = ledger.select("alert_id", "fingerprint").distinct()
    return rulings.select("written_at", "uid", "alert_id", "human_verdict").join(of, "alert_id")


def concerned(probes: DataFrame, ledger: DataFrame) -> DataFrame:
    """The records that can count in a decision on these alerts: those of their fingerprints, of whatever alert."""
    return ledger.join(probes.select("fingerprint").distinct(), "fingerprint", "left_semi")


def _gate(ruling: str | None, anchor: dict) -> tuple[bool, str]:
    """The tests of dedup.reuse_gate, in their order."""
    if ruling and ruling != "false_positive":
        return False, f"ruled {ruling}"
    if anchor["verdict"] != "false_positive":
        return False, f"verdict {anchor['verdict'] or 'none'}"
    if anchor["confidence"] != "high":
        return False, f"confidence {anchor['confidence'] or 'none'}"
    if anchor["escalated"]:
        return False, "escalated"
    if (anchor["injected"] or 0) > 0:
        return False, "injection"
    if anchor["blind"]:
        return False, f"blind: {anchor['blind']}"
    return True, "confirmed" if ruling else "clean"


class Suppression(StatefulProcessor):
    """Decides on the alerts of a fingerprint in the order of (time, uid), however they come within the lag.

    Events wait until the watermark has passed them. ``real`` has the records that may be anchors, ``copies`` the times of
    reuses; both end with the window. ``worked`` has the alerts with a real record, ``ruled`` the last ruling of each alert.
    """

    def __init__(self, hours: int, cap: int, record: bool, slack_us: int, remember_us: int):
        self.window, self.cap, self.record, self.slack, self.remember = hours * 3_600_000_000, cap, record, slack_us, remember_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.real = handle.getMapState("real", "uid string", _EVENT)
        self.copies = handle.getListState("copies", "at long")
        self.worked = handle.getMapState("worked", "alert_id string", "at long")
        self.ruled = handle.getMapState("ruled", "alert_id string", "human string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in _FIELDS) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(-(-min(r[0] for r in new) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Each state is read once a call, since every access goes to the JVM and back."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((dict(zip(_FIELDS, r, strict=True)) for r in waiting if r[0] <= passed), key=lambda e: (e["t"], e["uid"], e["kind"]))
        if due:
            left = [tuple(r) for r in waiting if r[0] > passed]
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(-(-min(r[0] for r in left) // 1000))
            else:
                self.waiting.clear()
        real = [dict(zip(_FIELDS, v, strict=True)) for _, v in self.real.iterator()]
        copies = [r[0] for r in self.copies.get()] if self.copies.exists() else []
        worked = {k[0]: v[0] for k, v in self.worked.iterator()}
        out = self._work(key[0], due, real, copies, worked) if due else []
        self._forget(passed, real, copies, worked)
        return iter(out)

    def _work(self, fingerprint: str, due: list[dict], real: list[dict], copies: list[int], worked: dict[str, int]) -> list[Row]:
        """The decisions; what is new is put into the state and into the three collections."""
        asked = any(e["kind"] == PROBE for e in due)
        ruled = {k[0]: v[0] for k, v in self.ruled.iterator()} if asked else {}
        out, reused = [], []
        for e in due:
            if e["kind"] == RULING:
                self.ruled.updateValue((e["alert_id"],), (e["human"],))
                ruled[e["alert_id"]] = e["human"]
            elif e["kind"] == RECORD and e["copy"]:
                if e["at"] is not None:
                    reused.append(e["at"])
            elif e["kind"] == RECORD:
                self.worked.updateValue((e["alert_id"],), (e["t"],))
                worked[e["alert_id"]] = e["t"]
                if e["at"] is not None and e["mine"]:
                    real.append(e)
                    self.real.updateValue((e["uid"],), tuple(e[c] for c in _FIELDS))
            else:
                anchor, n, yes, why = self._decide(e, real, copies + reused, worked, ruled)
                if yes and self.record:
                    reused.append(e["at"])
                out.append(Row(fingerprint=fingerprint, probe_id=e["alert_id"], uid=e["uid"], anchor_id=anchor["alert_id"] if anchor else None, suppressions=n, suppressed=yes, reason=why))
        if reused:
            self.copies.appendList([(at,) for at in reused])
            copies.extend(reused)
        ends = [e["at"] for e in real] + copies
        if ends:
            self.handle.registerTimer((max(ends) + self.window + self.slack) // 1000 + 1)
        return out

    def _decide(self, probe: dict, real: list[dict], copies: list[int], worked: dict[str, int], ruled: dict[str, str]):
        now = probe["at"]
        fit = [e for e in real if now - self.window <= e["at"] <= now and e["alert_id"] != probe["alert_id"]]
        anchor = max(fit, key=lambda e: (e["t"], e["uid"]), default=None)
        n = sum(anchor["at"] <= at <= now for at in copies) if anchor else 0
        if (probe["injected"] or 0) > 0:
            return anchor, n, False, "injected"
        if probe["alert_id"] in worked:
            return anchor, n, False, "already investigated"
        if anchor is None:
            return None, 0, False, "no anchor"
        if n >= self.cap:
            return anchor, n, False, "cap"
        if any(v and v != "false_positive" for v in ruled.values()):
            return anchor, n, False, "overturned"
        return anchor, n, *_gate(ruled.get(anchor["alert_id"]), anchor)

    def _forget(self, passed: int, real: list[dict], copies: list[int], worked: dict[str, int]) -> None:
        end = passed - self.window - self.slack
        for uid in {e["uid"] for e in real if e["at"] < end}:
            self.real.removeKey((uid,))
        kept = [(at,) for at in copies if at >= end]
        if len(kept) < len(copies):
            self.copies.put(kept) if kept else self.copies.clear()
        for alert_id in [k for k, t in worked.items() if t < passed - self.remember]:
            self.worked.removeKey((alert_id,))
        later = [t for t in worked.values() if t >= passed - self.remember]
        if later and not kept and not any(e["at"] >= end for e in real):  # the last thing to end
            self.handle.registerTimer((max(later) + self.remember) // 1000 + 1)

    def close(self) -> None:
        pass


def suppress_in_flight(events: DataFrame, lag: timedelta = LAG, hours: int = WINDOW_HOURS, cap: int = MOST_IN_A_ROW, record: bool = True, remember: timedelta = REMEMBER) -> DataFrame:
    """(fingerprint, probe_id, uid, anchor_id, suppressions, suppressed, reason) of each alert that arrives on a stream of ``suppression_events``.

    The decisions are those of dedup.suppress on all that stands before the alert in the order of (time, uid). What comes
    within ``lag`` of the newest event takes its place in that order, whatever batch brings it; what is later is dropped. With ``record``, an
    alert that is suppressed counts at once as a reuse. A decision leaves when the watermark has passed the alert. Anchors and
    reuses are let go ``hours`` after their time, alerts with a real record after ``remember``; rulings stay. An event without
    fingerprint, time or uid is left out.
    """
    known = events.where("fingerprint is not null and time is not null and uid is not null and alert_id is not null")
    stream = known.withWatermark("time", f"{_micros(lag)} microseconds")
    processor = Suppression(hours, cap, record, _micros(lag), _micros(remember))
    return _stateful(stream, "fingerprint", processor, "fingerprint string, probe_id string, uid string, anchor_id string, suppressions long, suppressed boolean, reason string", "append", "EventTime")


class Capped(StatefulProcessor):
    """Counts reuses since the last real record."""

    def __init__(self, cap: int, ttl_ms: int | None):
        self.cap, self.ttl_ms = cap, ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("count", "seen boolean, used long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen, used = self.state.get() if self.state.exists() else (False, 0)
        for uid, real in sorted((r["uid"], r["is_real"]) for r in rows):
            yes = not real and seen and used < self.cap
            seen, used = (True, 0) if real else (seen, used + yes)
            yield Row(fingerprint=key[0], uid=uid, suppress=bool(yes))
        self.state.update((bool(seen), int(used)))

    def close(self) -> None:
        pass


def suppressions_in_flight(stream: DataFrame, cap: int = MOST_IN_A_ROW, silent: timedelta | None = None) -> DataFrame:
    """(fingerprint, uid, suppress) from (fingerprint, uid, is_real): the cap alone, in order of uid within a batch.

    A real record sets the count back to none; a fingerprint without rows for ``silent`` starts anew. Where time, gates and
    rulings count, ``suppress_in_flight`` decides.
    """
    life, mode = _life(silent)
    return _stateful(stream.select("fingerprint", "uid", "is_real"), "fingerprint", Capped(cap, life), "fingerprint string, uid string, suppress boolean", "append", mode)


# -- the last record of a key


class Latest(StatefulProcessor):
    def __init__(self, key: str, order: str, ttl_ms: int | None):
        self.key, self.order, self.ttl_ms = key, order, ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("last", "best string, record string, n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best, record, n = self.state.get() if self.state.exists() else (None, None, 0)
        for r in rows:
            n += 1
            if best is None or r[self.order] is not None and r[self.order] > best:
                best, record = r[self.order], r["record"]
        self.state.update((best, record, n))
        yield Row(**{self.key: key[0], self.order: best, "record": record, "n": n})

    def close(self) -> None:
        pass


def latest_by_key(stream: DataFrame, key: str = "alert_id", order: str = "uid", silent: timedelta | None = None) -> DataFrame:
    """(key, order, record, n): the record with the largest order of each key so far, as JSON, and how many rows it has had; updated as rows come.

    A row that comes late and stands before the last one changes the count alone. Order compares as text, so uids sort by
    time; the first of equal ones stays. A key without rows for ``silent`` is forgotten, if that is given: the query then makes a batch at every trigger. Rows without key are left out.
    """
    rows = stream.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), F.col(order).cast("string").alias(order), F.to_json(F.struct(*stream.columns)).alias("record"))
    life, mode = _life(silent)
    return _stateful(rows, key, Latest(key, order, life), f"{key} string, {order} string, record string, n long", "update", mode)


# -- the health of desks


class Health(StatefulProcessor):
    """The streak of sick cycles of a desk; the ids that failed in it are a map, so a long streak isn't rewritten with every cycle."""

    def __init__(self, page_after: int, exit_after: int, ttl_ms: int | None):
        self.page_after, self.exit_after, self.ttl_ms = page_after, exit_after, ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("streak", "streak long, paged boolean, crashed boolean, well boolean", self.ttl_ms)
        self.failed = handle.getMapState("failed", "id string", "cycle long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        streak, paged, crashed, well = self.state.get() if self.state.exists() else (0, False, False, True)
        for r in sorted(rows, key=lambda r: r["cycle"]):
            action = None
            sick = bool(r["crashed"] or r["failed"] > 0 and r["worked"] == 0)
            if sick:
                streak, crashed = streak + 1, crashed or bool(r["crashed"])
                for x in r["failed_ids"] or ():
                    self.failed.updateValue((x,), (r["cycle"],))
                if streak >= self.exit_after and (crashed or sum(1 for _ in self.failed.keys()) > 1):
                    action = "exit"
                elif streak >= self.page_after and not paged:
                    action, paged = "page", True
            else:
                streak, paged, crashed = 0, False, False
                self.failed.clear()
            turned = None if sick != well else "sick" if sick else "well"
            well = not sick
            yield Row(desk=key[0], cycle=r["cycle"], streak=streak, action=action, turned=turned)
        self.state.update((streak, paged, crashed, well))

    def close(self) -> None:
        pass


def watchdog(stream: DataFrame, page_after: int = 3, exit_after: int = 30, silent: timedelta | None = None) -> DataFrame:
    """(desk, cycle, streak, action, turned) from a stream of cycles (desk, cycle, crashed, failed, worked, failed_ids).

    ``action``: page once a streak of sick cycles is that long, exit from a longer one on if a cycle crashed or
    more than one alert failed. ``turned``: sick or well at the cycles at which a desk falls sick or gets well; one begins well.
    A desk without cycles for ``silent`` begins anew, if that is given.
    """
    life, mode = _life(silent)
    return _stateful(stream, "desk", Health(page_after, exit_after, life), "desk string, cycle long, streak long, action string, turned string", "append", mode)


def health_turns(stream: DataFrame) -> DataFrame:
    """(desk, cycle, sick) from a stream of cycles: those at which a desk falls sick or gets well."""
    return watchdog(stream).where("turned is not null").select("desk", "cycle", (F.col("turned") == "sick").alias("sick"))
