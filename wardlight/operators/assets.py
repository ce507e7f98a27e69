"""Inventory lookups and the ranking of threat groups by technique."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import nz, technique_codes

DIMENSIONS = {
    "hosts": "host string, role string, owner string, notes string, expected_activity array<string>",
    "ips": "ip string, host string",
    "service_accounts": "user string, role string, owner string, notes string, expected_activity array<string>",
    "mail_senders": "domain string, provider string, authorized_domains array<string>, notes string",
    "saas_apps": "app_id string, name string, role string, owner string, notes string, expected_activity array<string>",
}


def load_inventory(spark: SparkSession, path: str | None) -> dict[str, DataFrame]:
    """The operator's inventory as one small table a section; empty tables where the file or a section is missing."""
    try:
        text = spark.read.text(path, wholetext=True).first() if path else None
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        text = None
    whole = json.loads(text[0]) if text else {}
    out = {}
    for name, schema in DIMENSIONS.items():
        fields = [f.split()[0] for f in schema.split(", ")]
        rows = [(k, *(v.get(f) for f in fields[1:])) for k, v in whole.get(name, {}).items()]
        out[name] = spark.createDataFrame(rows, schema)
    return out


def match_assets(alerts: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """(alert_id, place, entity, entity_type, name, role, owner): inventory entries that an alert names.

    alerts: alert_id, ips, hosts, users, apps (arrays). Addresses come first, then hosts, users and applications; what
    has one canonical name appears once, as it was found first. Lookups are equi-joins on the exploded names.
    """
    named = lambda c: alerts.select("alert_id", F.posexplode(c).alias("i", "key"))
    cols = ("alert_id", "stage", "i", "entity", "entity_type", "name", "role", "owner")

    def found(df: DataFrame, stage: int, kind: str, default: str) -> DataFrame:
        return df.select("alert_id", F.lit(stage).alias("stage"), "i", "entity", F.lit(kind).alias("entity_type"), "name", F.coalesce("role", F.lit(default)).alias("role"), "owner").select(*cols)

    hosts = dims["hosts"].select(F.col("host").alias("h"), "role", "owner")
    ip = named("ips").join(dims["ips"].withColumnRenamed("host", "name"), F.col("key") == F.col("ip")).join(hosts, F.col("name") == F.col("h"), "left").withColumn("entity", F.col("key"))
    host = named("hosts").join(hosts, F.col("key") == F.col("h")).withColumn("entity", F.col("key")).withColumn("name", F.col("key"))
    user = named("users").join(dims["service_accounts"].select("user", "role", "owner"), F.col("key") == F.col("user")).withColumn("entity", F.col("key")).withColumn("name", F.col("key"))
    apps = dims["saas_apps"].select("app_id", "name", "role", "owner")
    keys = apps.select(F.col("app_id").alias("k"), F.lit(0).alias("pref"), "*").unionByName(apps.where("name is not null").select(F.col("name").alias("k"), F.lit(1).alias("pref"), "*"))
    app = named("apps").join(keys, F.col("key") == F.col("k")).withColumn("entity", F.col("app_id")).withColumn("name", F.coalesce("name", "app_id"))
    best = Window.partitionBy("alert_id", "i").orderBy("pref", "app_id")
    app = app.withColumn("_b", F.row_number().over(best)).where("_b = 1")
    every = found(ip, 0, "ip", "inventoried asset").unionByName(found(host, 1, "host", "inventoried asset")).unionByName(found(user, 2, "service_account", "inventoried service account")).unionByName(found(app, 3, "saas_app", "sanctioned SaaS application"))
    canonical = F.coalesce(nz(F.col("name")), F.col("entity"))
    first = every.groupBy("alert_id", canonical.alias("c")).agg(F.min(F.struct("stage", "i", "entity", "entity_type", "name", "role", "owner")).alias("m"))
    return first.select("alert_id", (F.col("m.stage") * 1000 + F.col("m.i")).cast("long").alias("place"), "m.entity", "m.entity_type", "m.name", "m.role", "m.owner")


def group_hits(alerts: DataFrame, technique_groups: DataFrame) -> DataFrame:
    """(alert_id, code, group): groups known for a code of an alert or for its parent."""
    codes = alerts.select("alert_id", F.explode(technique_codes(F.col("attack_techniques"))).alias("code"))
    tried = codes.select("alert_id", "code", F.explode(F.array_distinct(F.array("code", F.substring_index("code", ".", 1)))).alias("tcode"))
    return tried.join(technique_groups, "tcode").select("alert_id", "code", "group")


def technique_sets(alerts: DataFrame) -> DataFrame:
    """(alert_id, codes): the distinct technique codes of each alert in order, as one text. Alerts without a code don't appear.

    Alerts of one rule have the same codes, and the groups that know them are the same; so these are sought once a set.
    """
    found = alerts.select("alert_id", technique_codes(F.col("attack_techniques")).alias("c")).where(F.size("c") > 0)
    every = found.groupBy("alert_id").agg(F.array_distinct(F.flatten(F.collect_set("c"))).alias("c"))
    return every.select("alert_id", F.array_join(F.array_sort("c"), ",").alias("codes"))


def set_hits(sets: DataFrame, technique_groups: DataFrame) -> DataFrame:
    """group_hits of each different set, under its codes in place of alert_id."""
    one = sets.select("codes").distinct().select(F.col("codes").alias("alert_id"), F.split("codes", ",").alias("attack_techniques"))
    return group_hits(one, technique_groups)


def rank_groups(alerts: DataFrame, technique_groups: DataFrame, aliases: DataFrame | None = None, top: int = 5) -> DataFrame:
    """(alert_id, group, overlap, techniques, rank): groups known for an alert's techniques or their parents, by how many, then by name.

    alerts: alert_id, attack_techniques; technique_groups: tcode, group; aliases: group, aliases. The groups are ranked once for
    each different set of codes, and the alerts take the rows of theirs.
    """
    sets = technique_sets(alerts)
    hits = set_hits(sets, technique_groups).groupBy("alert_id", "group").agg(F.countDistinct("code").alias("overlap"), F.array_sort(F.collect_set("code")).alias("techniques"))
    order = Window.partitionBy("alert_id").orderBy(F.desc("overlap"), "group")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumnRenamed("alert_id", "codes")
    out = sets.join(best, "codes").drop("codes")
    if aliases is not None:
        out = out.join(aliases.select("group", F.slice("aliases", 1, 4).alias("aliases")), "group", "left")
    return out


def read_attack_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tcode, group) and (group, aliases) from a STIX bundle: live techniques that live intrusion sets use."""
    objects = spark.read.option("multiLine", True).schema(
        "objects array<struct<id:string,type:string,name:string,aliases:array<string>,revoked:boolean,x_mitre_deprecated:boolean,relationship_type:string,source_ref:string,target_ref:string,external_references:array<struct<source_name:string,external_id:string>>>>"
    ).json(path).select(F.explode("objects").alias("o")).select("o.*")
    live = objects.where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))
    code = F.try_element_at(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(1))["external_id"]
    techniques = live.where("type = 'attack-pattern'").select(F.col("id").alias("target_ref"), code.alias("tcode")).where("tcode is not null")
    groups = live.where("type = 'intrusion-set'").select(F.col("id").alias("source_ref"), F.col("name").alias("group"), "aliases")
    uses = live.where("type = 'relationship' and relationship_type = 'uses'").select("source_ref", "target_ref")
    pairs = uses.join(techniques, "target_ref").join(groups, "source_ref")
    return pairs.select("tcode", "group").distinct(), groups.select("group", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
