"""IPv4 and IPv6 addresses in one sortable form, the ranges that aren't routed, and inventories of networks."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import is_ipv4

#: Ranges that are not globally reachable, and ranges inside them that are. Fixed values from the IANA registries of special-purpose addresses.
SPECIAL = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 "
    "::/128 ::1/128 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 fc00::/7 fe80::/10"
).split()
REACHABLE = "192.0.0.9/32 192.0.0.10/32 2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()
#: IPv4 addresses inside IPv6.
MAPPED = "6" + "0" * 20 + "ffff"
_GROUPS = r"^[0-9a-f]{1,4}(:[0-9a-f]{1,4})*$"


def _hex_quad(ip: Column) -> Column:
    """A dotted quad as eight hex digits."""
    return F.array_join(F.transform(F.split(ip, r"\."), lambda o: F.lower(F.lpad(F.hex(o.cast("long")), 2, "0"))), "")


def _normal_v6(ip: Column) -> Column:
    text = F.lower(F.regexp_replace(ip, r"%[^%/]+$", ""))
    quad = F.regexp_extract(text, r"[^:]*$", 0)
    spelled = F.when(~quad.contains("."), text).when(is_ipv4(quad), F.concat(F.regexp_replace(text, r"[^:]*$", ""), F.substring(_hex_quad(quad), 1, 4), F.lit(":"), F.substring(_hex_quad(quad), 5, 4)))

    def sides(parts: Column) -> Column:
        side = lambda i: F.get(parts, F.lit(i))
        groups = lambda s: F.when(F.coalesce(s, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(s, ":"))
        fits = lambda s: F.coalesce((s == "") | s.rlike(_GROUPS), F.lit(True))
        return F.when((F.size(parts) <= 2) & fits(side(0)) & fits(side(1)), F.struct(groups(side(0)).alias("left"), groups(side(1)).alias("right"), (F.size(parts) == 2).alias("short")))

    def joined(g: Column) -> Column:
        n = F.size(g["left"]) + F.size(g["right"])
        fill = lambda a: F.array_join(F.transform(a, lambda x: F.lpad(x, 4, "0")), "")
        whole = F.concat(F.lit("6"), fill(g["left"]), F.repeat(F.lit("0000"), 8 - n), fill(g["right"]))
        return F.when(g.isNotNull() & F.when(g["short"], n <= 7).otherwise(n == 8), whole)

    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  f of c, which is computed once
    return once(once(F.split(spelled, "::", -1), sides), joined)


def normal(ip: Column) -> Column:
    """4 and 8 hex digits, or 6 and 32: equal addresses in one spelling, in the order of their numbers. Null for what is no address; a scope (%eth0) doesn't count."""
    return F.when(is_ipv4(ip), F.concat(F.lit("4"), _hex_quad(ip))).when(ip.contains(":"), _normal_v6(ip))


def ends(network: str) -> tuple[str, str]:
    """The first and the last address of a network, in normal form."""
    net = ipaddress.ip_network(network)
    form = lambda a: f"{net.version}{int(a):0{net.max_prefixlen // 4}x}"
    return form(net.network_address), form(net.broadcast_address)


def within(form: Column, intervals: list[tuple[str, str]]) -> Column:
    """Whether a normal form lies in one of these sorted intervals that don't meet: a binary search of nested cases, log2 of them deep."""

    def search(x: Column, low: int, high: int) -> Column:
        if low >= high:
            return F.lit(False)
        mid = (low + high) // 2
        return F.when(x < intervals[mid][0], search(x, low, mid)).when(x <= intervals[mid][1], F.lit(True)).otherwise(search(x, mid + 1, high))

    return F.get(F.transform(F.array(form), lambda x: search(x, 0, len(intervals))), F.lit(0))


def is_global(ip: Column) -> Column:
    """Whether an address of either family is reachable from anywhere; an IPv4 address inside IPv6 is judged as itself. Null for what is no address."""
    special, reachable = sorted(map(ends, SPECIAL)), sorted(map(ends, REACHABLE))

    def judge(x: Column) -> Column:
        own = F.when(x.startswith(MAPPED), F.concat(F.lit("4"), F.substring(x, 26, 8))).otherwise(x)
        return F.when(x.isNotNull(), ~within(own, special) | within(own, reachable))

    return F.get(F.transform(F.array(normal(ip)), judge), F.lit(0))


def network_ends(networks: DataFrame, cidr: str) -> DataFrame:
    """networks with family, bits, lo and hi (normal forms) of their CIDR; rows that name no network are left out. Host bits may be set."""
    base, given = F.split(F.col(cidr), "/")[0], F.get(F.split(F.col(cidr), "/"), F.lit(1))
    rows = networks.withColumn("_form", normal(base)).where("_form is not null").withColumn("family", F.substring("_form", 1, 1))
    digits = F.when(F.col("family") == "4", 8).otherwise(32)
    rows = rows.withColumn("_digits", digits).withColumn("bits", F.when(given.isNull(), F.col("_digits") * 4).when(given.rlike(r"^\d{1,3}$"), given.cast("int")))
    rows = rows.where("bits between 0 and 4 * _digits")
    whole, free = F.floor(F.col("bits") / 4).cast("int"), (4 - F.col("bits") % 4).cast("int")
    nibble = F.conv(F.substring(F.col("_form"), whole + 2, F.lit(1)), 16, 10).cast("int")
    size = F.pow(F.lit(2), free).cast("int")
    low = nibble - nibble % size
    high = low + size - 1
    head, rest = F.substring(F.col("_form"), F.lit(1), whole + 1), F.col("_digits") - whole
    cut = lambda n, fill: F.when(rest == 0, head).otherwise(F.concat(head, F.lower(F.hex(n)), F.repeat(F.lit(fill), rest - 1)))
    return rows.withColumn("lo", cut(low, "0")).withColumn("hi", cut(high, "f")).drop("_form", "_digits")


def match_networks(addresses: DataFrame, networks: DataFrame, ip: str = "ip", cidr: str = "cidr") -> DataFrame:
    """(ip, and the columns of the network): for each distinct address the narrowest network that holds it, in text order of equal ones.

    A range join by buckets: a network lies under the prefix of its whole bytes, and an address looks under one prefix for each
    length that networks have, 22 at most; the bounds decide. Addresses in no network don't appear.
    """
    fields = networks.columns
    nets = network_ends(networks, cidr).withColumn("_cut", (1 + 2 * F.floor(F.col("bits") / 8)).cast("int"))
    cuts = {(r["family"], r["_cut"]) for r in nets.select("family", "_cut").distinct().collect()}  # 5 and 17 at most
    by_family = {f: F.array(*(F.lit(c) for g, c in sorted(cuts) if g == f)).cast("array<int>") for f in "46"}
    forms = addresses.select(F.col(ip).alias("_ip")).distinct().withColumn("_x", normal(F.col("_ip"))).where("_x is not null")
    looks = forms.withColumn("_c", F.explode(F.when(F.col("_x").startswith("4"), by_family["4"]).otherwise(by_family["6"])))
    looks = looks.withColumn("_prefix", F.substring(F.col("_x"), F.lit(1), F.col("_c")))
    held = nets.withColumn("_prefix", F.substring(F.col("lo"), F.lit(1), F.col("_cut")))
    hits = looks.join(held, (looks["_prefix"] == held["_prefix"]) & (F.col("_c") == F.col("_cut"))).where("_x between lo and hi")
    best = hits.groupBy("_ip").agg(F.min_by(F.struct(*(F.col(f) for f in fields)), F.struct(-F.col("bits"), F.col(cidr))).alias("_n"))
    return best.select(F.col("_ip").alias(ip), *(F.col(f"_n.{f}").alias(f) for f in fields if f != ip))
