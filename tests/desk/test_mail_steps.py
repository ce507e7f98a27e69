"""Mail signals at size: rows dealt out, steps compiled, and the odd inputs that shortcuts could get wrong."""

import pytest
from pyspark.sql import functions as F

from wardlight.functions import mail, urls
from wardlight.operators import phishing
from wardlight.plans import content

ATT = "array<struct<name:string,mime:string,urls:array<string>,qr_urls:array<string>,encrypted:boolean>>"


@pytest.fixture
def messages(spark, tmp_path):
    n = F.col("id")
    e = spark.range(200, numPartitions=1).select(n.alias("event_id"), F.timestamp_seconds(n).alias("ts"), (n % 7).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.concat(F.lit('{"k": '), (n % 100).cast("string"), F.lit("}")).alias("props"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    yield content._messages(spark, str(tmp_path))
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_messages_of_one_split_are_dealt_out(spark, messages):
    assert messages.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_signals_stand_outside_of_lambdas(messages):
    plan = optimized(phishing.analyze(messages, {"pay": ["pay.test"]}, ["sh.test"], ["freemail.test"]))
    told = [line for line in plan.splitlines() if "no_aligned_authentication" in line]
    assert told and all("lambda" not in line.split("no_aligned_authentication")[0] for line in told)


def test_a_filter_on_the_result_does_not_repeat_the_steps(messages):
    found = phishing.identify(messages)
    assert optimized(found.where("spf_result = 'pass' and spf_aligned")).count("regexp_extract_all") == optimized(found).count("regexp_extract_all") > 0
    assert found.where("spf_result = 'pass'").count() == 68


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("domain", "org"),
    [
        (None, ""), (" A.B.Co.UK. ", "b.co.uk"), ("a..b.com", "b.com"), (".com", ".com"), ("..x.gov.zz..", "x.gov.zz"), ("gov.zz", "gov.zz"), ("a.uk", "a.uk"), ("b.a.uk", "a.uk"), ("a.b\n", "a.b\n"), ("a.b.\n", "a.b\n"),
    ],
)
def test_organisations_in_columns_and_in_lambdas(spark, domain, org):
    assert one(spark, domain, "string", urls.org_domain) == org
    assert one(spark, [domain], "array<string>", lambda v: F.transform(v, urls.org_within)) == [org]


def test_odd_headers(spark):
    told = lambda h: [(e["method"], e["result"], [tuple(p) for p in e["props"]]) for e in one(spark, h, "string", mail.auth_results)]
    assert told("mx; spf=pass (a (b (c (d)))) x=1; dkim=fail (((((e))))) y=2") == [("spf", "pass", [("x", "1")]), ("dkim", "fail", [("y", "2")])]
    assert told("mx; spf=pass (open x=1; dkim=fail y=2") == [("spf", "pass", [("x", "1")]), ("dkim", "fail", [("y", "2")])]
    assert told('mx; DKIM="pa;ss" reason="a b;" word header.d="x.y"') == [("dkim", "pa;ss", [("reason", "a b"), ("header.d", "x.y")])]
    hops = ["x; 31 Feb 2024 10:00:00 +0000", "x; 1 Anf 2024 10:00:00 +0000", "x; 1 Jan 2024 24:00:00 +0000", "x; 1 Sept 2024 7:05 -0130", "x; 1 Jan 69 0:00:00 EST"]
    assert one(spark, hops, "array<string>", mail.hop_seconds) == [-31518000.0, 1725179700.0]


def test_recipients_in_fragments_are_plain_text(spark):
    row = ("a", ["b@c.com"], None, [], [], ["a+b(c@x.com"], ["https://e.com/#to=A+b(C@x.com&"], [])
    df = spark.createDataFrame([row], f"alert_id string, from_header array<string>, reply_to string, auth_results array<string>, received array<string>, recipients array<string>, urls array<string>, attachments {ATT}")
    assert "recipient_in_url_fragment" in {s["name"] for s in phishing.analyze(df, {}, [], []).first()["signals"]}
