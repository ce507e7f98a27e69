import json

import pytest
from pyspark.sql import functions as F

from wardlight.operators import tools
from wardlight.plans import render
from wardlight.sources import mailbox


def test_tools_answer_errors(spark):
    double = tools.Tool("double", "twice n", {"n": ("integer", True), "note": ("string", False)}, lambda n, note="": spark.range(n * 2))
    broken = tools.Tool("broken", "fails", {}, lambda: 1 / 0)
    kit = tools.Tools(double, broken)
    assert kit.ask("double", {"n": 3}).rows.count() == 6
    for name, arguments, fault in (("none", {}, True), ("double", {}, True), ("double", {"n": 1, "x": 2}, True), ("broken", {}, False)):
        got = kit.ask(name, arguments)
        assert not got.success and got.error and got.callers_fault is fault
    assert [s["name"] for s in kit.schemas()] == ["double", "broken"] and kit.schemas()[0]["input_schema"]["required"] == ["n"]
    assert list(kit.without("double").by_name) == ["broken"] and list(kit.replacing(tools.renamed(broken, "more"), double).by_name) == ["double", "broken", "more"]
    for wrong in (lambda: kit.without("nope"), lambda: tools.Tools(double, double)):
        with pytest.raises(ValueError, match="."):
            wrong()


def test_json_in_free_text():
    assert tools.json_in(' {"a": 1} ') == {"a": 1} and tools.json_in('```json\n{"a": {"b": "}"}}\n```') == {"a": {"b": "}"}}
    assert tools.json_in('first {"alert_id": 1} then {"alert_id": 2, "x": {"y": 3}} and {"note": 4}') == {"alert_id": 2, "x": {"y": 3}}
    assert tools.json_in('see {broken} and {"k": "line\nbreak"} end') == {"k": "line\nbreak"}
    for text in ("", None, "no object", "{open"):
        with pytest.raises(ValueError, match="JSON"):
            tools.json_in(text)


def test_reports_as_text_and_html(spark):
    df = spark.createDataFrame([("a\nb", 1, ["x", "y"]), ("<i>", None, [])], "name string, n int, l array<string>")
    text = render.as_text("Title", df)
    assert text.split("\n")[:2] == ["Title", "====="] and "a b" in text and "x, y" in text and "(none)" in render.as_text("T", df.limit(0))
    page = render.as_html("T & U", df, most=1)
    assert "T &amp; U" in page and "(more rows)" in page and "<td>a b</td>" in page and "&lt;i&gt;" in render.as_html("T", df)


def test_mail_containers(spark):
    logs = [
        {"headers": {"From": "A <a@b.test>", "Received": ["x" * 9000, 5, "two"], "N": 7}, "attachments": [f"f{i}.txt" for i in range(40)]},
        {"email": {"FROM": " x "}, "files": {"fileName": "one.pdf", "links": {"deep": [{"u": "see http://a.test/1, and http://a.test/1"}]}, "is_encrypted": "Yes"}},
        {"headers": "none", "attachments": [7, None, {"file": ["no"]}]},
        {},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(logs)], "alert_id int, raw_log string")
    got = {r["alert_id"]: r for r in mailbox.messages(df).collect()}
    assert got[0]["from_header"] == ["A <a@b.test>"] and [len(x) for x in got[0]["received"]] == [4000, 3]
    assert len(got[0]["attachments"]) == 25 and got[0]["delivered"] == 40 and got[0]["attachments"][0]["name"] == "f0.txt"
    one = got[1]["attachments"][0]
    assert (one["name"], one["urls"], one["encrypted"], got[1]["delivered"]) == ("one.pdf", ["http://a.test/1"], True, 1)
    assert [a["name"] for a in got[2]["attachments"]] == [""] and got[2]["delivered"] == 3 and got[2]["from_header"] == []
    assert got[3]["attachments"] == [] and got[3]["delivered"] == 0
    assert mailbox.load_brands("/nowhere.json") == {"brands": {}, "url_shorteners": [], "free_mail": []}
    assert df.select(F.size(mailbox.headers(F.try_parse_json("raw_log"))).alias("n")).agg(F.max("n")).first()[0] == 3
