"""Reports over the ledgers: scorecard, digest, tuning, inventory proposals, rotation, comparisons of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nz, one_line
from ..sources.ledger import ORDER, first_wins, latest
from .dedup import real
from .selection import percentiles

MIN_FIRINGS, MIN_EVIDENCE, NOISE_RATE = 5, 2, 0.8
RECUR_SIGHTINGS, RECUR_DAYS = 3, 2
CONFIDENCE_ORDER = {"high": 1, "medium": 2, "low": 3}
#: What the tuning and inventory reports read of a record.
CASE_COLUMNS = (
    "timestamp", "investigated_at", "title", "severity", "verdict", "confidence", "host", "iocs", "users", "domains", "attack_techniques", "duplicate_of", "writer", "detection", "provenance", "asset",
    "escalation_recommended", "injection_flags", "is_campaign", "asset_matches", "notes",
)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0: no evidence is neither good nor bad."""
    return F.try_divide(a.cast("double"), b.cast("double"))


# -- scorecard


def scored_rulings(ledger: DataFrame, rulings: DataFrame) -> DataFrame:
    """The last record of each alert with the analyst's last ruling on it."""
    last = latest(ledger, "alert_id", "verdict", "confidence", "escalation_recommended", "duplicate_of")
    human = latest(rulings, "alert_id", "human_verdict", "recorded_at")
    return last.join(human, "alert_id").withColumn("agrees", F.col("verdict").eqNullSafe(F.col("human_verdict")))


def superseded_closures(ledger: DataFrame, rulings: DataFrame, closures: DataFrame) -> DataFrame:
    """Closures that something later speaks against: a ruling other than false positive, or a real record with another verdict, after the closing."""
    closed = latest(closures, "alert_id", "closed_at")
    human = latest(rulings, "alert_id", "human_verdict", "recorded_at")
    again = latest(real(ledger), "alert_id", "verdict", "investigated_at").withColumnRenamed("verdict", "later_verdict")
    j = closed.join(human, "alert_id", "left").join(again, "alert_id", "left")
    ruled = F.coalesce((F.col("recorded_at") > F.col("closed_at")) & (F.col("human_verdict") != "false_positive"), F.lit(False))
    redone = F.coalesce((F.col("investigated_at") > F.col("closed_at")) & (F.col("later_verdict") != "false_positive"), F.lit(False))
    return j.where(ruled | redone).select("alert_id", ruled.alias("by_ruling"), redone.alias("by_record"))


def scorecard(ledger: DataFrame, rulings: DataFrame, closures: DataFrame) -> DataFrame:
    """One row: alerts, rulings, agreement, closures, suppressions, and the share of alerts that no human had to see."""
    last = latest(ledger, "alert_id", "duplicate_of")
    own = real(ledger).select("alert_id").distinct()
    closed = closures.where("alert_id is not null").select("alert_id").distinct()
    quiet = last.where(nz(F.col("duplicate_of")).isNotNull()).select("alert_id")
    totals = last.agg(F.count("*").alias("alerts"), F.count_if(nz(F.col("duplicate_of")).isNotNull()).alias("suppressed"))
    investigated = own.agg(F.count("*").alias("investigated"))
    rule = scored_rulings(ledger, rulings).agg(F.count("*").alias("ruled"), F.count_if("agrees").alias("agreed"))
    close = closed.agg(F.count("*").alias("auto_closed"))
    unseen = closed.union(quiet).distinct().join(last.select("alert_id"), "alert_id", "left_semi").agg(F.count("*").alias("unattended"))
    gone = superseded_closures(ledger, rulings, closures).agg(F.count("*").alias("superseded"))
    row = totals.crossJoin(investigated).crossJoin(rule).crossJoin(close).crossJoin(unseen).crossJoin(gone)  # one row each
    return row.withColumn("agreement_rate", ratio(F.col("agreed"), F.col("ruled"))).withColumn("automation_rate", ratio(F.col("unattended"), F.col("alerts")))


def agreement_by_confidence(scored: DataFrame) -> DataFrame:
    place = F.coalesce(*(F.when(F.col("confidence") == c, n) for c, n in CONFIDENCE_ORDER.items()), F.lit(4))
    return scored.groupBy("confidence").agg(F.count_if("agrees").alias("agreed"), F.count("*").alias("ruled")).withColumn("place", place.cast("long"))


def escalation_precision(scored: DataFrame) -> DataFrame:
    up, human = F.col("escalation_recommended"), F.col("human_verdict")
    return scored.agg(
        F.count_if(up & (human == "true_positive")).alias("confirmed"), F.count_if(up & (human == "false_positive")).alias("dismissed"),
        F.count_if(up & ~human.isin("true_positive", "false_positive")).alias("other"), F.count_if(~up & (human == "true_positive")).alias("missed"),
        ratio(F.count_if(up & (human == "true_positive")), F.count_if(up)).alias("precision"),
    )


def time_to_verdict(ledger: DataFrame) -> DataFrame:
    """Seconds from an alert to its first real record: the median, and the nearest-rank 90th percentile. Times before the alert don't count.

    Both are exact and found by counting, so no task holds all times.
    """
    first = first_wins(real(ledger).select("alert_id", *ORDER, "investigated_at", "timestamp"), "alert_id").select((F.unix_millis("investigated_at") - F.unix_millis("timestamp")).alias("ms")).where("ms >= 0")
    found = percentiles(first, "ms", [0.5], [0.9])
    return ledger.sparkSession.createDataFrame([(found["n"], found["between"][0.5], found["nearest"][0.9])], "n long, median_ms double, p90_ms long")


# -- digest


def in_window(df: DataFrame, column: str, now: str, days: int) -> DataFrame:
    """Rows of the last days; undated ones are out."""
    end = F.to_timestamp(F.lit(now))
    return df.where((F.col(column) > end - F.make_dt_interval(F.lit(days))) & (F.col(column) <= end))


def digest(ledger: DataFrame, rulings: DataFrame, closures: DataFrame, now: str, days: int) -> DataFrame:
    """One row on the alerts whose last record falls into the window: verdicts after rulings, escalations, campaigns, closures, spend and savings.

    Spend counts measured records; a suppressed one saves what its anchor cost.
    """
    recent = in_window(latest(ledger, "alert_id", "investigated_at", "verdict", "duplicate_of", "cost_usd", "escalation_recommended", "is_campaign"), "investigated_at", now, days)
    human = latest(rulings, "alert_id", "human_verdict")
    closed = closures.where("alert_id is not null").select("alert_id").distinct().withColumn("_closed", F.lit(True))
    anchors = latest(real(ledger), "alert_id", "cost_usd").select(F.col("alert_id").alias("duplicate_of"), F.col("cost_usd").alias("_saved"))
    j = recent.join(human, "alert_id", "left").join(closed, "alert_id", "left").join(anchors, "duplicate_of", "left")
    verdict, own = F.coalesce(nz(F.col("human_verdict")), F.col("verdict")), nz(F.col("duplicate_of")).isNull()
    money = lambda c: F.sum(c.cast("decimal(18,6)"))
    spent = F.when(own, F.col("cost_usd"))
    return j.agg(
        F.count("*").alias("alerts"), *(F.count_if(verdict == v).alias(v) for v in ("true_positive", "false_positive", "inconclusive")),
        F.count_if(F.col("escalation_recommended")).alias("escalations"), F.count_if(F.col("is_campaign")).alias("campaigns"), F.count_if(F.col("_closed")).alias("auto_closed"),
        F.count_if(~own).alias("suppressed"), F.count(spent).alias("measured"), F.count_if(own & F.col("cost_usd").isNull()).alias("unmeasured"),
        money(spent).cast("double").alias("spend_usd"), ratio(money(spent), F.count(spent)).alias("mean_usd"), money(F.when(~own, F.col("_saved"))).cast("double").alias("saved_usd"),
    )


# -- tuning


def judged(ledger: DataFrame, rulings: DataFrame, closures: DataFrame) -> DataFrame:
    """The last record of each alert with its effective verdict, whether it was ruled or closed, and what kind of evidence it is."""
    human = latest(rulings, "alert_id", "human_verdict")
    closed = closures.where("alert_id is not null").select("alert_id").distinct().withColumn("_closed", F.lit(True))
    needed = [c for c in CASE_COLUMNS if c in ledger.columns]
    j = latest(ledger, "alert_id", *needed).join(human, "alert_id", "left").join(closed, "alert_id", "left")
    return j.select(
        "*", F.coalesce(nz(F.col("human_verdict")), F.col("verdict")).alias("effective"), nz(F.col("human_verdict")).isNotNull().alias("ruled"), F.col("_closed").isNotNull().alias("auto_closed"),
        nz(F.col("duplicate_of")).isNotNull().alias("suppressed"), (F.col("injection_flags") > 0).alias("excluded"),
    )


def detections(cases: DataFrame, now: str | None = None, days: int | None = None) -> DataFrame:
    """Per detection: firings, their kinds and the false-positive rate. A window narrows these counts only, never the evidence of danger.

    Suppressed records are firings but no evidence; nor are those with injected content. true_positives_ever reads all.
    """
    ever = cases.where("not suppressed and effective = 'true_positive'").groupBy("detection", "provenance").agg(F.count("*").alias("true_positives_ever"))
    seen = cases if days is None else in_window(cases, "investigated_at", now, days)
    fit = ~F.col("suppressed") & ~F.col("excluded")
    of = lambda v: F.count_if(fit & (F.col("effective") == v))
    d = seen.groupBy("detection", "provenance").agg(
        F.count("*").alias("firings"), F.count_if("suppressed").alias("suppressed"), F.count_if(F.col("excluded") & ~F.col("suppressed")).alias("excluded"), of("false_positive").alias("fp"), of("true_positive").alias("tp"),
        of("inconclusive").alias("inconclusive"), F.count_if(fit & F.col("ruled")).alias("ruled"), F.count_if(fit & F.col("escalation_recommended")).alias("escalated"), F.count_if("auto_closed").alias("auto_closed"),
        F.count_if(fit & (F.col("effective") == "true_positive") & F.col("severity").isin("low", "medium")).alias("under_ranked"),
    )
    d = d.join(ever, ["detection", "provenance"], "left").withColumn("true_positives_ever", F.coalesce("true_positives_ever", F.lit(0)))
    evidence = F.col("fp") + F.col("tp") + F.col("inconclusive")
    d = d.withColumn("fp_rate", ratio(F.col("fp"), evidence)).withColumn("attention", F.col("firings") - F.col("suppressed") - F.col("auto_closed"))
    return d.withColumn("noisy", F.coalesce((F.col("fp_rate") >= NOISE_RATE) & (F.col("firings") >= MIN_FIRINGS) & (evidence >= MIN_EVIDENCE), F.lit(False)))


def case_entities(cases: DataFrame) -> DataFrame:
    """(alert_id, detection, provenance, entity): host, indicators and inventory entity of each record."""
    names = F.array_distinct(F.filter(F.concat(F.array("host", "asset"), F.coalesce("iocs", F.array().cast("array<string>"))), lambda x: nz(x).isNotNull()))
    return cases.select("alert_id", "detection", "provenance", "effective", F.explode(names).alias("entity"))


def exceptions(cases: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(detection, provenance, entity, safe): entities present in every false positive of a detection.

    Relational division by counting. An entity is safe to except if no true positive of the detection, ever, carries it
    or another name of it (``roots``: entity, root).
    """
    fit = cases.where("not suppressed and not excluded")
    fp = fit.where("effective = 'false_positive'")
    n = fp.groupBy("detection", "provenance").agg(F.count("*").alias("n"))
    found = case_entities(fp).groupBy("detection", "provenance", "entity").agg(F.count("*").alias("m")).join(n, ["detection", "provenance"]).where((F.col("m") == F.col("n")) & (F.col("n") >= MIN_EVIDENCE))
    bad = case_entities(cases.where("not suppressed and effective = 'true_positive'")).select("detection", "provenance", "entity").distinct()
    if roots is not None:
        named = lambda df: df.join(roots, "entity", "left").withColumn("root", F.coalesce("root", "entity"))
        found, bad = named(found), named(bad)
    else:
        found, bad = found.withColumn("root", F.col("entity")), bad.withColumn("root", F.col("entity"))
    bad = bad.select("detection", "provenance", "root").distinct().withColumn("_bad", F.lit(True))
    return found.join(bad, ["detection", "provenance", "root"], "left").select("detection", "provenance", "entity", F.col("n").alias("false_positives"), F.col("_bad").isNull().alias("safe"))


def preferred_exception(candidates: DataFrame, roles: DataFrame) -> DataFrame:
    """(detection, provenance, entity, role, unsafe): the safe candidate to propose, one that the inventory documents before others, then by name; and the unsafe ones.

    roles: (entity, role). A detection with unsafe candidates only has a null entity.
    """
    j = candidates.join(roles, "entity", "left")
    safe = F.when(F.col("safe"), F.struct(F.col("role").isNull().alias("unknown"), "entity", "role"))
    out = j.groupBy("detection", "provenance").agg(F.min(safe).alias("s"), F.array_sort(F.collect_set(F.when(~F.col("safe"), F.col("entity")))).alias("unsafe"))
    return out.select("detection", "provenance", "s.entity", "s.role", "unsafe")


def confirmed_techniques(cases: DataFrame) -> DataFrame:
    """(technique, alerts, detections): techniques of true positives, over the whole store."""
    t = cases.where("not suppressed and effective = 'true_positive'").select("alert_id", "detection", F.explode(F.array_distinct("attack_techniques")).alias("technique"))
    return t.groupBy("technique").agg(F.countDistinct("alert_id").alias("alerts"), F.array_join(F.array_sort(F.collect_set("detection")), ",").alias("detections"))


# -- orders of reports; ``place`` numbers the rows of tables that have one row a detection or a proposal


def _placed(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).orderBy("place")


def noisy_detections(found: DataFrame) -> DataFrame:
    """Noisy detections, those first that cost analysts most."""
    return _placed(found.where("noisy"), F.desc("attention"), F.desc("fp"), "detection", "provenance")


def watchlist(found: DataFrame) -> DataFrame:
    """Detections with a high rate of false positives and too little evidence yet, the most frequent first."""
    return _placed(found.where(F.coalesce(F.col("fp_rate") >= NOISE_RATE, F.lit(False)) & ~F.col("noisy")), F.desc("firings"), "detection", "provenance")


def under_ranked_detections(found: DataFrame) -> DataFrame:
    """Detections whose true positives came with a low severity, the most such first."""
    return _placed(found.where("under_ranked > 0"), F.desc("under_ranked"), "detection", "provenance")


def ordered_rulings(scored: DataFrame) -> DataFrame:
    """Scored rulings, disagreements first, then by alert."""
    return scored.orderBy("agrees", "alert_id")


def by_recency(rows: DataFrame) -> DataFrame:
    """Sightings and related records of each probe, the newest first; undated ones last."""
    return rows.orderBy("probe_id", F.desc_nulls_last("timestamp"), "alert_id")


def percent_text(c: Column) -> Column:
    """A share as whole percent, half to even."""
    return F.concat(F.bround(c * 100, 0).cast("long").cast("string"), F.lit("%"))


# -- windows: what an undated record is


def window_state(stamp: Column, cutoff: Column) -> Column:
    """Whether a record lies in a window from ``cutoff``; without a cutoff all do, and an undated one is null: neither in nor out."""
    return F.when(cutoff.isNull(), True).when(stamp.isNull(), None).otherwise(stamp >= cutoff)


def in_window_dated(stamp: Column, cutoff: Column) -> Column:
    """The same, but an undated record is out."""
    return F.coalesce(window_state(stamp, cutoff), F.lit(False))


def in_window_kept(stamp: Column, cutoff: Column) -> Column:
    """The same, but an undated record is in: nothing of unknown age is left out."""
    return F.coalesce(window_state(stamp, cutoff), F.lit(True))


def undated(stamp: Column, cutoff: Column) -> Column:
    """Whether a window has no place for a record, which reports count apart."""
    return cutoff.isNotNull() & stamp.isNull()


# -- inventory proposals


#: Where a raw log names hosts, and inventory sections of indicator kinds. Fixed values.
HOST_KEYS = ("host", "source_host", "destination_host")
SECTIONS = {"ips": "ips", "users": "service_accounts"}


def named_entities(raw_json: Column, indicators: Column, flat_host: Column) -> Column:
    """array of (entity, section) that a record names, once each: hosts of its raw log, or its flat host without one; addresses and users.

    What isn't a single printable line names nothing.
    """
    raw = F.try_parse_json(raw_json)
    value = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$.name", "string"))
    is_object = F.coalesce(F.schema_of_variant(raw).startswith("OBJECT"), F.lit(False))
    hosts = F.when(is_object, F.array(*(value(F.try_variant_get(raw, f"$.{k}", "variant")) for k in HOST_KEYS))).otherwise(F.array(flat_host))
    pair = lambda section: lambda x: F.struct(x.alias("entity"), F.lit(section).alias("section"))
    none = F.array().cast("array<string>")
    found = F.concat(F.transform(hosts, pair("hosts")), *(F.transform(F.coalesce(F.try_element_at(indicators, F.lit(k)), none), pair(s)) for k, s in SECTIONS.items()))
    return F.array_distinct(F.filter(found, lambda p: nz(p["entity"]).isNotNull() & (one_line(p["entity"]) == p["entity"])))


def inventory_proposals(ledger: DataFrame, rulings: DataFrame, known: DataFrame | None = None, now: str | None = None, days: int | None = None) -> DataFrame:
    """(entity, section, sightings, days, reach, confirmed_against, titles, notes, recurs, known): entities of alerts that analysts dismissed.

    ledger: with raw_log and indicators. Reach and confirmed_against read the last record of every alert; the window bounds the
    evidence only, and a suppressed record is no evidence. titles and notes are the distinct ones in ledger order. known: (entity, section).
    """
    last = latest(ledger, "alert_id", *ORDER, "title", "host", "investigated_at", "duplicate_of", "raw_log", "indicators")
    ruled = latest(rulings, "alert_id", "human_verdict", "summary")
    cutoff = F.lit(None).cast("timestamp") if days is None else F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days))
    j = last.join(ruled, "alert_id", "left")
    evidence = nz(F.col("duplicate_of")).isNull() & F.coalesce(F.col("human_verdict") == "false_positive", F.lit(False)) & in_window_dated(F.col("investigated_at"), cutoff)
    rows = j.select(
        "alert_id", *ORDER, evidence.alias("good"), F.coalesce(F.col("human_verdict") == "true_positive", F.lit(False)).alias("bad"), F.to_date("investigated_at").alias("day"),
        nz(one_line(F.col("title"))).alias("title"), nz(one_line(F.col("summary"))).alias("note"), F.explode(named_entities(F.col("raw_log"), F.col("indicators"), F.col("host"))).alias("p"),
    ).select("*", "p.entity", "p.section")
    good = F.col("good")
    # the first place of each text of an entity, then the texts in that order; combined before the shuffle
    texts = rows.where("good").select("entity", "section", *ORDER, F.explode(F.array(F.struct(F.lit("title").alias("kind"), F.col("title").alias("text")), F.struct(F.lit("note").alias("kind"), F.col("note").alias("text")))).alias("t")).where("t.text is not null")
    first = texts.groupBy("entity", "section", "t.kind", "t.text").agg(F.min(F.struct(*ORDER)).alias("at"))
    told = first.groupBy("entity", "section").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("at", "text")))), lambda x: x["text"]).alias(f"{k}s") for k in ("title", "note")))
    out = rows.groupBy("entity", "section").agg(F.count_if(good).alias("sightings"), F.countDistinct(F.when(good, F.col("day"))).alias("days"), F.count("*").alias("reach"), F.count_if("bad").alias("confirmed_against"))
    empty = F.array().cast("array<string>")
    out = out.where("sightings > 0 or confirmed_against > 0").join(told, ["entity", "section"], "left").withColumns({"titles": F.coalesce("titles", empty), "notes": F.coalesce("notes", empty)})
    out = out.withColumn("recurs", (F.col("sightings") >= RECUR_SIGHTINGS) & (F.col("days") >= RECUR_DAYS))
    if known is None:
        return out.withColumn("known", F.lit(False))
    listed = known.select("entity", "section").distinct().withColumn("_known", F.lit(True))
    return out.join(listed, ["entity", "section"], "left").withColumn("known", F.col("_known").isNotNull()).drop("_known")


def proposal_class() -> Column:
    """stale: listed and yet confirmed as an attacker's; known: listed and recurring; refused, eligible: recurring; rare: all else."""
    bad = F.col("confirmed_against") > 0
    return F.when(F.col("known") & bad, "stale").when(~F.col("recurs"), "rare").when(F.col("known"), "known").when(bad, "refused").otherwise("eligible")


def ordered_proposals(proposals: DataFrame) -> DataFrame:
    return proposals.orderBy(F.desc("sightings"), "section", "entity")


def proposal_fragment(proposals: DataFrame) -> DataFrame:
    """(section, entity, fragment): each eligible proposal as JSON for the inventory; what only the operator can claim is left to be filled in."""
    todo = F.lit("TODO")
    why = F.concat(F.lit("Seen in "), F.col("sightings").cast("string"), F.lit(" dismissed alert(s) on "), F.col("days").cast("string"), F.lit(" day(s): "), F.array_join(F.slice("titles", 1, 3), "; "))
    entry = F.when(F.col("section") == "ips", F.to_json(F.struct(todo.alias("host")))).otherwise(F.to_json(F.struct(todo.alias("role"), todo.alias("owner"), why.alias("notes"), F.array().cast("array<string>").alias("expected_activity"))))
    return proposals.where(proposal_class() == "eligible").select("section", "entity", entry.alias("fragment"))


# -- retention


def rotation_plan(ledger: DataFrame, rulings: DataFrame, now: str, days: int, stamp: str = "investigated_at") -> DataFrame:
    """Each record with its class: pinned (ruled), unclassifiable (no id), retained or archived. An unknown age is never aged out."""
    pinned = rulings.select("alert_id").where("alert_id is not null").distinct().withColumn("_pinned", F.lit(True))
    old = F.col(stamp) < F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days))
    kind = F.when(F.col("alert_id").isNull(), "unclassifiable").when(F.col("_pinned").isNotNull(), "pinned").when(F.coalesce(old, F.lit(False)), "archived").otherwise("retained")
    return ledger.join(pinned, "alert_id", "left").withColumn("class", kind).drop("_pinned")


# -- evaluation runs


def tally(results: DataFrame) -> DataFrame:
    """(fixture, mode, property, passed, n, marginal) from one row for each checked property of each run."""
    return results.groupBy("fixture", "mode", "property").agg(F.count_if("ok").alias("passed"), F.count("*").alias("n")).withColumn("marginal", F.col("passed") < F.col("n"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two tallies: better, worse, same, added, removed, by exact cross-multiplied shares."""
    side = lambda df, s: df.select("fixture", "mode", "property", F.col("passed").alias(f"passed_{s}"), F.col("n").alias(f"n_{s}"))
    j = side(a, "a").join(side(b, "b"), ["fixture", "mode", "property"], "full_outer")
    x, y = F.col("passed_a") * F.col("n_b"), F.col("passed_b") * F.col("n_a")
    change = F.when(F.col("n_a").isNull(), "added").when(F.col("n_b").isNull(), "removed").when(x < y, "better").when(x > y, "worse").otherwise("same")
    return j.withColumn("change", change)


# -- desk status


def writer_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.coalesce("writer", F.lit("(unattributed)")).alias("writer")).agg(F.count("*").alias("n"))


def newest_by_writer(ledger: DataFrame, now: Column) -> DataFrame:
    """(writer, rows, newest_ms, ahead_ms): the newest stamp of each writer, and how far its clock runs ahead of ours."""
    newest = F.unix_millis(F.max("written_at"))
    return ledger.where("writer is not null").groupBy("writer").agg(F.count("*").alias("rows"), newest.alias("newest_ms"), F.greatest(F.lit(0), newest - F.unix_millis(now)).alias("ahead_ms"))


def consecutive_sick(cycles: DataFrame, page_after: int = 3, exit_after: int = 30, desk: str = "desk") -> DataFrame:
    """Gaps and islands over cycles (desk, cycle, crashed, failed, worked, failed_ids): streak length, page and exit of each cycle.

    Exit is tested before page; it needs a crash or two different failing ids in the streak. A page comes once a streak.
    """
    sick = F.col("crashed") | ((F.col("failed") > 0) & (F.col("worked") == 0))
    own = Window.partitionBy(desk).orderBy("cycle")
    c = cycles.withColumn("sick", sick).withColumn("_streak", F.count_if(~sick).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(desk, "_streak").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("streak", F.count_if("sick").over(inner)).withColumn("_crash", F.max(F.when(F.col("sick"), F.col("crashed"))).over(inner))
    ids = F.when(F.col("sick"), F.col("failed_ids"))
    c = c.withColumn("_two", F.min(F.array_min(ids)).over(inner) < F.max(F.array_max(ids)).over(inner))  # two different ids
    leave = F.col("sick") & (F.col("streak") >= exit_after) & (F.coalesce("_crash", F.lit(False)) | F.coalesce("_two", F.lit(False)))
    action = F.when(leave, "exit").when(F.col("sick") & (F.col("streak") == page_after), "page")
    return c.withColumn("action", action).drop("_streak", "_crash", "_two")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("ORDER",)]
