"""Response proposals for true positives: reputation rules, technique rules, mail rules, and what withholds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import addresses
from ..functions.text import parent_by_cut

#: Bars, account names that aren't accounts, and technique families by action.
ABUSE_BAR, HASH_BAR, DOMAIN_BAR, POPULAR_SCANS, MOST_ACCOUNTS = 75, 0.5, 0.5, 100, 3
NOT_ACCOUNTS = [
    "system", "local service", "network service", "anonymous logon", "local system",
    "nt authority\\system", "nt authority\\local service", "nt authority\\network service", "nt authority\\anonymous logon",
]
FAMILIES = {
    "isolate_host": ("hosts", "T1486 T1059 T1053 T1547 T1543 T1055 T1490"),
    "disable_account": ("users", "T1078 T1098 T1136"),
    "reset_credentials": ("users", "T1110 T1003 T1555 T1552 T1621"),
    "revoke_oauth_grant": ("apps", "T1528 T1550"),
}
ACCOUNT_ACTIONS = ("disable_account", "reset_credentials")
RANK = {"proposed": 0, "needs_approval": 1, "withheld": 2}
COLUMNS = ("alert_id", "action", "target", "basis", "withheld", "caution", "rationale")


def actionable(cases: DataFrame) -> DataFrame:
    return cases.where("verdict = 'true_positive' and confidence in ('high', 'medium')")


def by_technique(cases: DataFrame) -> DataFrame:
    """cases: alert_id, attack_techniques, hosts, users, apps. One row for each target of each action whose family was seen."""
    parents = parent_by_cut(F.col("attack_techniques"))
    rules = F.array(*(F.struct(F.lit(a).alias("action"), F.array_sort(F.array_intersect(parents, F.array(*map(F.lit, codes.split())))).alias("hit"), F.col(kind).alias("targets")) for a, (kind, codes) in FAMILIES.items()))
    rows = cases.select("alert_id", F.explode(rules).alias("r")).where(F.size("r.hit") > 0)
    rows = rows.select("alert_id", "r.action", F.array_join("r.hit", ", ").alias("hit"), F.size("r.targets").alias("n"), F.explode("r.targets").alias("target"))
    account = F.col("action").isin(*ACCOUNT_ACTIONS)
    bare = F.lower(F.trim("target"))
    refused = F.when(account & (F.col("n") > MOST_ACCOUNTS), "a spray of accounts, not one compromised identity").when(account & bare.isin(*NOT_ACCOUNTS), "a local system authority").when(account & bare.endswith("$"), "a machine account")
    return rows.select("alert_id", "action", "target", F.lit("technique").alias("basis"), refused.alias("withheld"), F.lit(None).cast("string").alias("caution"), F.concat(F.lit("mapped "), "hit").alias("rationale")).select(*COLUMNS)


def by_reputation(cases: DataFrame, reputations: DataFrame) -> DataFrame:
    """Blocks of subjects that the alert itself names.

    cases: alert_id, ips, hashes, domains; reputations: alert_id, kind (ip, hash, domain), subject, score, whitelisted,
    found, malicious, sampled, total.
    """
    named = cases.select("alert_id", F.explode(F.array_distinct(F.concat("ips", "hashes", "domains"))).alias("subject"))
    r = reputations.join(named, ["alert_id", "subject"], "left_semi")
    ip, share = F.col("kind") == "ip", F.try_divide(F.col("malicious").cast("double"), F.col("sampled"))
    refused = F.when(ip & addresses.normal(F.col("subject")).isNull(), "not an address").when(ip & ~addresses.is_global(F.col("subject")), "not globally routable").when(ip & F.coalesce("whitelisted", F.lit(False)), "whitelisted shared infrastructure")
    caution = F.when((F.col("kind") == "domain") & (F.col("total") >= POPULAR_SCANS), "shared infrastructure")
    strong = F.when(ip, F.col("score") >= ABUSE_BAR).when(F.col("kind") == "hash", F.col("found") & (share >= HASH_BAR)).otherwise(F.col("found") & (share >= DOMAIN_BAR))
    return r.where(F.coalesce(strong, F.lit(False))).select("alert_id", F.concat(F.lit("block_"), "kind").alias("action"), F.col("subject").alias("target"), F.lit("reputation").alias("basis"), refused.alias("withheld"), caution.alias("caution"), F.lit("bad reputation").alias("rationale")).select(*COLUMNS)


def by_mail(phishing: DataFrame) -> DataFrame:
    """Quarantine of the sender, if a strong signal exists and an authenticated identifier aligns; phishing: alert_id and the analysis."""
    strong = F.filter("signals", lambda s: s["strength"] == "strong")
    fine = F.coalesce(F.col("spf_aligned") & (F.col("spf_result") == "pass"), F.lit(False)) | F.coalesce(F.col("dkim_aligned") & (F.col("dkim_result") == "pass"), F.lit(False))
    caution = F.when(F.exists("signals", lambda s: s["name"] == "sanctioned_bulk_sender"), "a sender that the inventory records")
    why = F.array_join(F.slice(F.array_sort(F.transform(strong, lambda s: s["name"])), 1, 3), ", ")
    rows = phishing.where((F.size(strong) > 0) & F.col("header_from").isNotNull())
    return rows.select("alert_id", F.lit("quarantine_email").alias("action"), F.col("header_from").alias("target"), F.lit("analysis").alias("basis"), F.when(~fine, "nothing authenticated this address").alias("withheld"), caution.alias("caution"), why.alias("rationale")).select(*COLUMNS)


def propose(candidates: DataFrame, inventory: DataFrame, injected: DataFrame) -> DataFrame:
    """(alert_id, action, target, status, basis, rationale, owner): the best proposal for each action and target.

    candidates: rows of the rules; inventory: alert_id, entity, role, owner; injected: alert_ids with injected content,
    whose proposals are all withheld.
    """
    known = inventory.groupBy("alert_id", F.col("entity").alias("target")).agg(F.min(F.struct("role", "owner")).alias("inv"))
    bad = injected.select("alert_id").distinct().withColumn("_bad", F.lit(True))
    j = candidates.join(known, ["alert_id", "target"], "left").join(bad, "alert_id", "left")
    status = F.when(F.col("withheld").isNotNull(), "withheld").when(F.col("inv").isNotNull() | F.col("caution").isNotNull(), "needs_approval").otherwise("proposed")
    why = F.coalesce("withheld", F.concat_ws(". ", "rationale", F.col("inv.role"), "caution"))
    rank = F.coalesce(*(F.when(F.col("status") == s, n) for s, n in RANK.items()))
    rows = j.select("alert_id", "action", "target", "basis", status.alias("status"), why.alias("rationale"), F.when(F.col("withheld").isNull(), F.col("inv.owner")).alias("owner"), F.coalesce("_bad", F.lit(False)).alias("_bad"))
    best = best_action(rows.withColumn("rank", rank))
    return best.select("alert_id", "action", "target", "basis", F.when(F.col("_bad"), "withheld").otherwise(F.col("status")).alias("status"), "rationale", "owner")


def best_action(rows: DataFrame, *order: str) -> DataFrame:
    """The row of least rank for each (alert_id, action, target); further order columns break ties."""
    rest = [c for c in rows.columns if c not in ("alert_id", "action", "target")]
    first = rows.groupBy("alert_id", "action", "target").agg(F.min_by(F.struct(*rest), F.struct("rank", *(order or ("basis", "rationale")))).alias("_b"))
    return first.select("alert_id", "action", "target", *(F.col(f"_b.{c}").alias(c) for c in rest))
