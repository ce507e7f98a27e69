"""Queries over identities, inventory, evaluation, mail input and feedback, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, feedback, identity, policy, reports
from ..sources import ledger as lg
from ..sources import mailbox
from ..sources.adapter import ledgers
from .desk import _CASES, _cases, _detections_sql, query

_K = r"(\d+)$"


def _records(spark, sf):
    """Investigations with their number, k and user."""
    i = ledgers(spark, sf).investigations
    return i.withColumns({"seq": F.col("uid").cast("long"), "k": F.regexp_extract(F.element_at("iocs", 1), _K, 1).cast("long"), "u": F.regexp_extract("host", _K, 1).cast("long")})


def _s(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# -- identities


@query("SELECT seq, CASE WHEN seq % 8 < 7 THEN detection WHEN k % 5 = 0 THEN '(unnamed detection)' ELSE 'Alert ' || detection END AS detection, CASE WHEN seq % 8 < 7 THEN 'rule' ELSE 'title' END AS provenance FROM inv")
def detection_identity(spark, sf):
    """The rule name under each of the paths where sources put it, alone or beside others that come later."""
    r, rule = _records(spark, sf), F.col("detection")
    place = lambda n: F.col("seq") % 8 == n
    raw = F.to_json(
        F.struct(
            F.when(place(0), F.struct(F.concat(F.lit(" "), rule, F.lit("\n")).alias("rule_name"), F.lit("later").alias("rule"))).when(place(1), F.struct(F.lit(" ").alias("rule_name"), rule.alias("rule"))).alias("detection"),
            F.when(place(2), rule).alias("detection_rule"), F.when(place(3), F.struct(F.struct(rule.alias("name")).alias("rule"))).alias("signal"),
            F.when(place(5), rule).when(place(4), F.lit("later")).alias("rule_name"), F.when(place(4), F.struct(rule.alias("name"))).alias("rule"), F.lit(5).alias("n"),
        )
    )
    flat = F.to_json(F.struct(rule.alias("rule")))
    title = F.when(place(7) & (F.col("k") % 5 == 0), F.lit(" \n ")).otherwise(F.col("title"))
    named = r.select("seq", title.alias("title"), F.when(place(6), flat).otherwise(raw).alias("raw_log"))
    return identity.with_detection(named).select("seq", "detection", "provenance")


def _matched(spark, sf):
    r = _records(spark, sf)
    one = lambda e, n, role: F.struct(e.alias("entity"), n.alias("name"), role.cast("string").alias("role"))
    pair = F.array(one(F.element_at("iocs", 1), _s("asset-", F.col("u") % 40), F.when(F.col("k") % 3 == 0, _s("role-", F.col("k") % 5))), one(F.col("host"), _s("asset-", F.col("u") % 40), F.when(F.col("k") % 4 == 0, F.lit("server"))), one(F.lit(""), F.lit(""), F.lit("none")))
    return r.withColumn("asset_matches", pair)


_MATCHED = """, m AS (SELECT seq, 0 AS place, ioc AS entity, 'asset-' || (u % 40) AS name, CASE WHEN k % 3 = 0 THEN 'role-' || (k % 5) END AS role FROM inv
  UNION ALL SELECT seq, 1, host, 'asset-' || (u % 40), CASE WHEN k % 4 = 0 THEN 'server' END FROM inv)"""


@query(_MATCHED + """, n AS (SELECT seq, place, 0 AS which, entity, role FROM m WHERE role IS NOT NULL UNION ALL SELECT seq, place, 1, name, role FROM m WHERE role IS NOT NULL)
  SELECT entity, role FROM n QUALIFY row_number() OVER (PARTITION BY entity ORDER BY seq, place, which) = 1""")
def inventory_roles(spark, sf):
    return identity.inventory_roles(_matched(spark, sf))


@query(_MATCHED + " SELECT DISTINCT entity AS a, name AS b FROM m")
def alias_edges(spark, sf):
    return identity.alias_edges(_matched(spark, sf))


# -- orders of the tuning report

_FINE = _CASES + ", cases2 AS (SELECT * REPLACE (detection || '/' || (u % 60) AS detection) FROM cases)"


def _ordered_sql(where: str, order: str, fine: bool = False) -> str:
    sql = _detections_sql("").replace("\n  SELECT g.*", ", d AS (SELECT g.*", 1) + ")"
    if fine:
        sql = sql.replace(_CASES, _FINE, 1).replace("FROM cases ", "FROM cases2 ").replace("FROM cases WHERE", "FROM cases2 WHERE")
    return sql + f" SELECT detection, firings, row_number() OVER (ORDER BY {order}, detection) AS place FROM d WHERE {where}"


def _fine(spark, sf):
    user = F.regexp_extract("host", _K, 1).cast("long")
    return reports.detections(_cases(spark, sf).withColumn("detection", _s(F.col("detection"), "/", user % 60)))


@query(_ordered_sql("noisy", "attention DESC, fp DESC"))
def noisy_detections(spark, sf):
    return reports.noisy_detections(reports.detections(_cases(spark, sf))).select("detection", "firings", "place")


@query(_ordered_sql("coalesce(fp_rate >= 0.8, false) AND NOT noisy", "firings DESC", True))
def detection_watchlist(spark, sf):
    return reports.watchlist(_fine(spark, sf)).select("detection", "firings", "place")


@query(_ordered_sql("under_ranked > 0", "under_ranked DESC"))
def under_ranked_detections(spark, sf):
    return reports.under_ranked_detections(reports.detections(_cases(spark, sf))).select("detection", "firings", "place")


@query(_CASES + """, c2 AS (SELECT * REPLACE (detection || '/' || (u % 60) AS detection) FROM cases), ent AS (SELECT DISTINCT alert_id, detection, eff, supp, excl, unnest([host, asset, ioc]) AS entity FROM c2),
n AS (SELECT detection, count(*) AS n FROM c2 WHERE NOT supp AND NOT excl AND eff = 'false_positive' GROUP BY detection),
f AS (SELECT detection, entity, count(*) AS m FROM ent WHERE NOT supp AND NOT excl AND eff = 'false_positive' GROUP BY ALL),
x AS (SELECT f.detection, f.entity, NOT EXISTS (SELECT 1 FROM ent t WHERE NOT t.supp AND t.eff = 'true_positive' AND t.detection = f.detection AND t.entity = f.entity) AS safe,
  CASE WHEN f.entity LIKE 'scanner-%' AND CAST(right(f.entity, 1) AS INT) % 2 = 0 THEN 'scanner' END AS role FROM f JOIN n ON f.detection = n.detection AND m = n WHERE n >= 2),
best AS (SELECT detection, entity, role FROM x WHERE safe QUALIFY row_number() OVER (PARTITION BY detection ORDER BY role IS NULL, entity) = 1)
SELECT u.detection, b.entity, b.role, u.bad FROM (SELECT detection, coalesce(string_agg(entity, ',' ORDER BY entity) FILTER (NOT safe), '') AS bad FROM x GROUP BY detection) u LEFT JOIN best b USING (detection)""")
def preferred_exceptions(spark, sf):
    user = F.regexp_extract("host", _K, 1).cast("long")
    cases = _cases(spark, sf).withColumn("detection", _s(F.col("detection"), "/", user % 60))
    roles = spark.range(0, 10, 2).select(_s("scanner-", F.col("id")).alias("entity"), F.lit("scanner").alias("role"))
    return reports.preferred_exception(reports.exceptions(cases), roles).select("detection", "entity", "role", F.array_join("unsafe", ",").alias("bad"))


# -- inventory proposals


def _listed(spark, sf):
    r = _records(spark, sf)
    as_object = F.to_json(F.struct(F.struct(F.col("host").alias("name")).alias("host"), _s("gw-", F.col("k") % 4).alias("source_host"), F.lit("two\nlines").alias("destination_host")))
    as_text = F.to_json(F.struct("host", _s("gw-", F.col("k") % 4).alias("source_host"), F.col("host").alias("destination_host")))
    raw = F.when(F.col("seq") % 6 == 5, None).when(F.col("k") % 2 == 0, as_object).otherwise(as_text)
    found = F.create_map(F.lit("ips"), F.array(F.element_at("iocs", 1), F.element_at("iocs", 1), F.lit("")), F.lit("users"), F.array(_s("svc-", F.col("u") % 6), F.lit("a\tb")))
    return r.withColumns({"raw_log": raw, "indicators": found})


_LISTED = """, lr AS (SELECT l.*, r.human_verdict AS hv, r.summary AS note FROM latest l LEFT JOIN ruled r USING (alert_id)),
named AS (SELECT *, host AS entity, 'hosts' AS section FROM lr UNION ALL SELECT *, 'gw-' || (k % 4), 'hosts' FROM lr WHERE seq % 6 <> 5 UNION ALL SELECT *, ioc, 'ips' FROM lr UNION ALL SELECT *, 'svc-' || (u % 6), 'service_accounts' FROM lr),
good AS (SELECT * FROM named WHERE duplicate_of IS NULL AND hv = 'false_positive' AND investigated_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY),
one AS (SELECT entity, section, title, min(seq) AS began FROM good GROUP BY ALL), told AS (SELECT entity, section, string_agg(title, '; ' ORDER BY began) AS titles FROM one GROUP BY ALL),
note1 AS (SELECT entity, section, note, min(seq) AS began FROM good WHERE note IS NOT NULL GROUP BY ALL), noted AS (SELECT entity, section, string_agg(note, '; ' ORDER BY began) AS notes FROM note1 GROUP BY ALL),
g AS (SELECT entity, section, count(*) AS reach, count(*) FILTER (hv = 'true_positive') AS confirmed_against FROM named GROUP BY ALL),
e AS (SELECT entity, section, count(*) AS sightings, count(DISTINCT CAST(investigated_at AS DATE)) AS days FROM good GROUP BY ALL),
p AS (SELECT g.entity, g.section, coalesce(sightings, 0) AS sightings, coalesce(days, 0) AS days, reach, confirmed_against, coalesce(titles, '') AS titles, coalesce(notes, '') AS notes, (g.entity = 'gw-1' AND g.section = 'hosts') OR (g.entity IN ('svc-2', 'svc-3') AND g.section = 'service_accounts') AS known
  FROM g LEFT JOIN e USING (entity, section) LEFT JOIN told USING (entity, section) LEFT JOIN noted USING (entity, section) WHERE coalesce(sightings, 0) > 0 OR confirmed_against > 0),
classed AS (SELECT *, CASE WHEN known AND confirmed_against > 0 THEN 'stale' WHEN NOT (sightings >= 3 AND days >= 2) THEN 'rare' WHEN known THEN 'known' WHEN confirmed_against > 0 THEN 'refused' ELSE 'eligible' END AS class FROM p)"""


def _proposals(spark, sf):
    known = spark.sql("SELECT * FROM VALUES ('gw-1', 'hosts'), ('svc-2', 'service_accounts'), ('svc-3', 'service_accounts'), ('gw-2', 'ips') AS t(entity, section)")
    return reports.inventory_proposals(_listed(spark, sf), ledgers(spark, sf).dispositions, known, "2024-01-31 00:00:00", 20)


@query(_LISTED + " SELECT entity, section, sightings, days, reach, confirmed_against, titles, notes, class FROM classed")
def inventory_proposals(spark, sf):
    p = reports.ordered_proposals(_proposals(spark, sf).withColumn("class", reports.proposal_class()))
    return p.select("entity", "section", "sightings", "days", "reach", "confirmed_against", F.array_join("titles", "; ").alias("titles"), F.array_join("notes", "; ").alias("notes"), "class")


@query(_LISTED + """ SELECT section, entity, CASE WHEN section = 'ips' THEN '{"host":"TODO"}' ELSE '{"role":"TODO","owner":"TODO","notes":"Seen in ' || sightings || ' dismissed alert(s) on ' || days || ' day(s): ' || array_to_string(string_split(titles, '; ')[1:3], '; ') || '","expected_activity":[]}' END AS fragment FROM classed WHERE class = 'eligible'""")
def inventory_fragment(spark, sf):
    return reports.proposal_fragment(_proposals(spark, sf))


# -- windows, retries, resuming


@query("""SELECT seq, CASE WHEN k % 10 = 0 THEN NULL ELSE investigated_at >= TIMESTAMP '2024-01-20 00:00:00' END AS state, k % 10 <> 0 AND investigated_at >= TIMESTAMP '2024-01-20 00:00:00' AS dated, k % 10 = 0 OR investigated_at >= TIMESTAMP '2024-01-20 00:00:00' AS kept, k % 10 = 0 AS undated, true AS unbounded FROM inv""")
def window_rules(spark, sf):
    """An undated record under each rule of windows."""
    stamp, cutoff = F.when(F.col("k") % 10 != 0, F.col("investigated_at")), F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    none = F.lit(None).cast("timestamp")
    return _records(spark, sf).select("seq", reports.window_state(stamp, cutoff).alias("state"), reports.in_window_dated(stamp, cutoff).alias("dated"), reports.in_window_kept(stamp, cutoff).alias("kept"), reports.undated(stamp, cutoff).alias("undated"), reports.window_state(stamp, none).alias("unbounded"))


@query("SELECT seq, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN seq % 2 = 0 AND seq % 7 IN (1, 3, 4, 5) WHEN 2 THEN seq % 2 = 0 ELSE false END AS again FROM inv")
def retry_decisions(spark, sf):
    failure = F.element_at(F.array(*map(F.lit, ("connect", "status", "transport", "other"))), (F.col("k") % 4 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, (200, 429, 500, 502, 503, 504, 404))), (F.col("seq") % 7 + 1).cast("int"))
    return _records(spark, sf).select("seq", policy.may_retry(failure, status, F.col("seq") % 2 == 0).alias("again"))


@query(""", p AS (SELECT * FROM progress QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) = 1), age AS (SELECT p.*, epoch_ms(TIMESTAMP '2024-01-15 12:00:00') // 1000 - epoch_ms(started_at) // 1000 AS s FROM p)
  SELECT a.alert_id, CASE WHEN phase <> 'started' THEN 'completed' WHEN s < -60 THEN 'started in the future' WHEN s > 864000 THEN 'too old' WHEN l.writer IS DISTINCT FROM 'desk-b' THEN 'another writer'
    WHEN r.human_verdict IS NOT NULL THEN 'ruled' WHEN l.duplicate_of IS NOT NULL THEN 'suppressed' WHEN l.k % 10 IN (1, 2) THEN 'unreadable record' WHEN l.k % 10 = 3 THEN 'another alert''s record' WHEN l.injection_flags > 0 THEN 'injection flags' ELSE 'resume' END AS reason
  FROM age a JOIN latest l ON l.alert_id = a.alert_id LEFT JOIN ruled r ON r.alert_id = a.alert_id""")
def resume_guards(spark, sf):
    """All reasons for which interrupted work isn't taken up again."""
    d = ledgers(spark, sf)
    k = F.col("k") % 10
    kept = F.when(k == 1, "{broken").when(k == 2, "[1]").otherwise(F.to_json(F.struct(F.when(k == 3, "other").otherwise(F.col("alert_id")).alias("alert_id"))))
    last = lg.latest(_records(spark, sf).withColumn("investigation", kept), "alert_id", "writer", "investigated_at", "duplicate_of", "injection_flags", "investigation")
    last = last.join(lg.latest(d.dispositions, "alert_id", "human_verdict"), "alert_id", "left")
    return policy.resume_eligible(lg.latest(d.watch_progress, "alert_id", "phase", "at"), last, F.to_timestamp(F.lit("2024-01-15 12:00:00")), "desk-b", 864_000).select("alert_id", "reason")


# -- evaluation

_CHECKS = """, x AS (SELECT *, t AS fixture, confidence AS mode, seq AS run, CASE t WHEN 'error' THEN ['true_positive'] WHEN 'click' THEN ['true_positive', 'inconclusive'] WHEN 'view' THEN ['false_positive'] ELSE [] END AS ok_verdicts, array_to_string(attack_techniques, ' ') AS blob,
  CASE confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS lvl, 'block ' || host || ' reset password' AS piv,
  verdict = 'false_positive' AND confidence = 'high' AND NOT blind AND NOT escalation_recommended AND injection_flags = 0 AND NOT is_campaign AS closes FROM inv),
c AS (SELECT fixture, mode, run, unnest(['verdict', 'confidence', 'required_techniques', 'any_of_techniques', 'forbidden_techniques', 'escalation', 'pivots', 'evidence_count', 'associated_groups', 'sigma_matches', 'injection_flags', 'autoclose_safe']) AS property,
  unnest([CASE WHEN len(ok_verdicts) > 0 THEN list_contains(ok_verdicts, verdict) END, CASE WHEN k % 2 = 0 THEN lvl >= 2 END, CASE WHEN t = 'purchase' THEN contains(blob, 'T1078') AND contains(blob, 'T1') WHEN t = 'signup' THEN false END, CASE WHEN t IN ('click', 'view') THEN contains(blob, 'T1566') END,
    CASE WHEN k % 3 = 0 THEN NOT (contains(blob, 'T1136') OR contains(blob, 'T1110')) END, CASE WHEN k % 5 = 0 THEN escalation_recommended = (k % 2 = 0) END, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN contains(piv, 'host-1') WHEN 2 THEN false END,
    CASE WHEN k % 7 = 0 THEN k % 6 >= 3 END, CASE WHEN k % 8 = 0 THEN k % 5 >= 2 END, CASE WHEN k % 9 = 0 THEN k % 4 >= 1 END, CASE WHEN k % 11 = 0 THEN injection_flags >= 1 END, CASE WHEN t IN ('error', 'click') THEN NOT closes END]) AS ok FROM x)"""


def _checked(spark, sf):
    r = _records(spark, sf).withColumn("t", F.regexp_extract("title", r"^Alert (\w+)-", 1))
    c, k, t = F.col, F.col("k"), F.col("t")
    words = lambda *xs: F.array(*map(F.lit, xs))
    expected = F.struct(
        F.when(t == "error", words("true_positive")).when(t == "click", words("true_positive", "inconclusive")).alias("allowed_verdicts"), F.when(t == "view", "false_positive").alias("expected_verdict"), F.when(k % 2 == 0, "medium").alias("min_confidence"),
        F.when(t == "purchase", words("T1078", "T1")).when(t == "signup", words("T1136", "T9")).alias("required_techniques"), F.when(t.isin("click", "view"), F.array(words("T9", "T1566"))).alias("any_of_techniques"), F.when(k % 3 == 0, words("T1136", "T1110")).alias("forbidden_techniques"),
        F.when(k % 5 == 0, k % 2 == 0).alias("must_escalate"), F.when(k % 4 == 0, F.array(words("BLOCK", "x"), words("Reset"))).when(k % 4 == 1, F.array(words("host-1"))).when(k % 4 == 2, F.array(words("reset"), words("nothing"))).alias("pivots_must_include"),
        F.when(k % 7 == 0, 3).alias("min_evidence_count"), F.when(k % 8 == 0, 2).alias("min_associated_groups"), F.when(k % 9 == 0, 1).alias("min_sigma_matches"), F.when(k % 11 == 0, 1).alias("min_injection_flags"),
    )
    runs = r.select(
        t.alias("fixture"), c("confidence").alias("mode"), c("seq").alias("run"), "verdict", "confidence", "attack_techniques", "escalation_recommended", "failed_tools", "is_campaign", F.array(_s("Block ", c("host")), F.lit("reset password")).alias("pivots"), (k % 6).alias("n_evidence"), (k % 5).alias("n_groups"),
        (k % 4).alias("n_sigma"), c("injection_flags").alias("n_injection"), expected.alias("expected"),
    )
    gate = policy.auto_close(c("verdict"), c("confidence"), F.lit(None).cast("string"), c("failed_tools"), c("escalation_recommended"), c("n_injection"), c("is_campaign"))
    return evaluation.property_checks(runs, gate["yes"])


@query(_CHECKS + " SELECT fixture, mode, run, property, ok FROM c WHERE ok IS NOT NULL")
def eval_checks(spark, sf):
    return _checked(spark, sf)


@query(_CHECKS + " SELECT fixture, mode, property, count(*) FILTER (ok) AS passed, count(*) AS n, count(*) FILTER (ok) < count(*) AS marginal FROM c WHERE ok IS NOT NULL GROUP BY ALL")
def eval_tally(spark, sf):
    return reports.tally(_checked(spark, sf))


# -- mail input


@query(""", x AS (SELECT e, k, u, k % 3 AS shape FROM ev) SELECT CAST(e AS VARCHAR) AS alert_id, 'Desk <a@u' || u || '.test>' AS sender, CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS n_results, 'r' || u || '@corp.test,x@corp.test' AS recipients,
  CASE shape WHEN 0 THEN 'a.exe' WHEN 1 THEN 'b.pdf,c.zip' ELSE 'd.txt,' END AS names, CASE shape WHEN 0 THEN '' WHEN 1 THEN 'application/pdf,' ELSE ',' END AS mimes, CASE shape WHEN 1 THEN 'http://x.test/' || k || ',https://y.test/b' ELSE '' END AS links,
  CASE shape WHEN 2 THEN 'http://qr.test/' || k ELSE '' END AS qr, CASE shape WHEN 0 THEN 'false' WHEN 1 THEN 'true,false' ELSE 'false,true' END AS encrypted, CASE shape WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS delivered FROM x""")
def mail_input(spark, sf):
    """Headers and attachments of raw logs in three shapes."""
    c, k = F.col, F.col("k")
    from ..sources.adapter import events

    e = events(spark, sf)
    user = c("user_id")
    heads = F.struct(_s("Desk <a@u", user, ".test>").alias("From"), F.when(k % 4 == 0, F.array(F.lit("mx; spf=pass"), F.lit("mx; spf=fail"))).otherwise(F.array(F.lit("mx; spf=none"))).alias("Authentication-Results"), _s("R <R", user, "@corp.test>").alias("TO"), F.lit("x@corp.test").alias("cc"))
    first = F.to_json(F.struct(heads.alias("headers"), F.array(F.lit(" a.exe ")).alias("attachments")))
    second = F.to_json(F.struct(F.lit("not an object").alias("headers"), heads.alias("email_headers"), F.array(F.struct(F.lit("b.pdf").alias("fileName"), F.lit("Application/PDF").alias("contentType"), F.array(F.struct(_s("see http://x.test/", k, ",").alias("href"), F.lit("https://y.test/b").alias("z")), F.struct(F.lit("http://x.test/").alias("href"), F.lit("https://y.test/b").alias("z"))).alias("links"), F.lit("YES").alias("password_protected"))).alias("email_attachments"), F.struct(F.lit("c.zip").alias("name"), F.lit(False).alias("encrypted")).alias("files")))
    second = F.regexp_replace(second, '"http://x.test/"', '"none"')
    third = F.to_json(F.struct(heads.alias("email"), F.array(F.struct(F.lit(" ").alias("name"), F.lit("d.txt").alias("file"), F.struct(_s("scan http://qr.test/", k, ").").alias("text")).alias("qr_code"), F.lit(None).cast("boolean").alias("encrypted")), F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("file"), F.struct(F.lit("no link").alias("text")).alias("qr_code"), F.lit(True).alias("encrypted"))).alias("files")))
    third = F.regexp_replace(third, r'\]\}$', ",5]}")
    raw = F.when(k % 3 == 0, first).when(k % 3 == 1, second).otherwise(third)
    m = mailbox.messages(e.select(c("event_id").cast("string").alias("alert_id"), raw.alias("raw_log")))
    flat = lambda f: F.array_join(F.transform("attachments", f), ",")
    return m.select(
        "alert_id", F.try_element_at("from_header", F.lit(1)).alias("sender"), F.size("auth_results").alias("n_results"), F.array_join("recipients", ",").alias("recipients"), flat(lambda a: a["name"]).alias("names"), flat(lambda a: a["mime"]).alias("mimes"),
        F.array_join(F.flatten(F.transform("attachments", lambda a: a["urls"])), ",").alias("links"), F.array_join(F.flatten(F.transform("attachments", lambda a: a["qr_urls"])), ",").alias("qr"), flat(lambda a: a["encrypted"].cast("string")).alias("encrypted"), "delivered",
    )


# -- follow-up, skew


@query("SELECT l.alert_id, CASE WHEN l.seq % 3 = 0 THEN 'summary' ELSE 'full' END AS kind, CASE WHEN r.human_verdict IS NULL THEN 'none' ELSE r.human_verdict || ' [analyst]' || chr(10) || r.summary END AS ruling, l.seq % 3 <> 0 AS has_report FROM latest l LEFT JOIN ruled r USING (alert_id)")
def follow_up_documents(spark, sf):
    r = _records(spark, sf).withColumns({"alert": F.lit("{}"), "investigation": F.when(F.col("seq") % 3 != 0, F.to_json(F.struct("verdict")))})
    out = feedback.follow_up(r, ledgers(spark, sf).dispositions)
    return out.select("alert_id", "kind", F.substring_index("document", "# Ruling\n", -1).alias("ruling"), F.contains("document", F.lit("# Investigation\n")).alias("has_report"))


@query("SELECT writer, count(*) AS rows, max(seq) AS newest_ms, greatest(0, max(seq) - 5000) AS ahead_ms FROM inv WHERE writer IS NOT NULL GROUP BY writer")
def clock_skew(spark, sf):
    return reports.newest_by_writer(ledgers(spark, sf).investigations, F.timestamp_millis(F.lit(5000)))
