import ipaddress
import random

from pyspark.sql import functions as F

from wardlight.functions import addresses, tables
from wardlight.operators import actions, injection


def parsed(text):
    try:
        return ipaddress.ip_address(text)
    except (ValueError, TypeError):
        return None


def spelled(seed):
    """Addresses at both ends of all special ranges and beside them, random ones in several spellings, and what is none."""
    out = [None, "", "x", "1.2.3", "1.2.3.4.5", "256.1.1.1", ":", "::", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "12345::", "g::", ":1::2", "1:", "::ffff:1.2.3.4", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3", "::1.2.3.400", "fe80::1%eth0", "FE80::A", "2606:4700::1111", "::ffff:10.0.0.1"]
    for net in map(ipaddress.ip_network, addresses.SPECIAL + addresses.REACHABLE + ["224.0.0.0/4", "ff00::/8"]):
        kind = type(net.network_address)
        for n in (int(net.network_address) - 1, int(net.network_address), int(net.broadcast_address), int(net.broadcast_address) + 1):
            if 0 <= n < 1 << net.max_prefixlen:
                out.append(str(kind(n)))
    rng = random.Random(seed)
    for _ in range(150):
        a = ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([-1, ~(0xFFFFFFFF << 48), ~(0xFFFF << 64), 0xFFFF]))
        out += [str(a), a.exploded.upper(), str(ipaddress.IPv4Address(rng.getrandbits(32)))]
    return out


def test_normal_form_and_reach_equal_the_standard_library(spark):
    texts = spelled(1)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, ip string").select("i", addresses.normal(F.col("ip")).alias("n"), addresses.is_global(F.col("ip")).alias("g")).collect()
    for r in rows:
        a = parsed(texts[r["i"]])
        if a is None:
            assert r["n"] is None and r["g"] is None, texts[r["i"]]
        else:
            assert r["n"] == f"{a.version}{int(a):0{a.max_prefixlen // 4}x}" and r["g"] == a.is_global, texts[r["i"]]


def test_networks_by_the_narrowest_that_holds_an_address(spark):
    rng = random.Random(3)
    ips = [x for x in spelled(2) if x] + ["10.1.2.3"] * 5
    nets = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/23", "10.1.2.3", "10.1.2.3/32", "2000::/3", "2001:db8::/33", "::/0", "fe80::/10", "172.16.5.4/13", "bad", "10.0.0.0/33", "1.2.3.4/x"]
    nets += [f"{ipaddress.IPv4Address(rng.getrandbits(32))}/{rng.randrange(33)}" for _ in range(40)] + [f"{ipaddress.IPv6Address(rng.getrandbits(128))}/{rng.randrange(129)}" for _ in range(40)]
    known = []
    for n in nets:
        try:
            known.append((ipaddress.ip_network(n, strict=False), n))
        except ValueError:
            pass
    want = {}
    for ip in set(ips):
        a = parsed(ip.split("%")[0])
        fit = [(-n.prefixlen, text) for n, text in known if a is not None and n.version == a.version and int(n.network_address) <= int(a) <= int(n.broadcast_address)]
        if fit:
            want[ip] = min(fit)[1]
    got = addresses.match_networks(spark.createDataFrame([(i,) for i in ips], "ip string"), spark.createDataFrame([(n, f"owner of {n}") for n in nets], "cidr string, owner string")).collect()
    assert {r["ip"]: r["cidr"] for r in got} == want and all(r["owner"] == f"owner of {r['cidr']}" for r in got) and len(got) == len(want) > 50


def test_both_families_are_blocked_where_they_are_reachable(spark):
    subjects = {"2606:4700::1111": None, "fd00::1": "not globally routable", "8.8.8.8": None, "10.0.0.1": "not globally routable", "nonsense": "not an address", "::ffff:10.0.0.1": "not globally routable"}
    cases = spark.createDataFrame([("A", list(subjects), [], [])], "alert_id string, ips array<string>, hashes array<string>, domains array<string>")
    found = spark.createDataFrame([("A", "ip", s, 90, False, None, None, None, None) for s in subjects], "alert_id string, kind string, subject string, score int, whitelisted boolean, found boolean, malicious long, sampled long, total long")
    assert {r["target"]: r["withheld"] for r in actions.by_reputation(cases, found).collect()} == subjects


def test_table_functions_from_sql(spark):
    tables.register(spark)
    texts = ['{"a": ["x", {"b": "y"}], "n": 1}', "no json", None, "[]"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    df.createOrReplaceTempView("bodies")
    got = spark.sql("SELECT id, location, value FROM bodies, LATERAL json_strings(body, 'root')").collect()
    want = injection.json_leaves(df, "id", {"body": "root"}).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3
    hits = [(1, "T1", "g1"), (1, "T2", "g1"), (1, "T1", "g2"), (1, "T1", "g1"), (2, None, "g9"), (2, "T3", "g3"), (1, "T4", "g0"), (1, "T5", "g2")]
    spark.createDataFrame(hits, "alert_id long, code string, `group` string").createOrReplaceTempView("hits")
    got = spark.sql("SELECT * FROM actor_groups(TABLE(hits), 2) ORDER BY alert_id, rank").collect()
    assert [tuple(r) for r in got] == [(1, "g1", 2, ["T1", "T2"], 1), (1, "g2", 2, ["T1", "T5"], 2), (2, "g3", 1, ["T3"], 1)]
