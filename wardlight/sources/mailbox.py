"""Mail as gateways write it into raw logs: headers, attachments and links under many names, read into one shape."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mail import MOST_HEADER_CHARS
from ..functions.text import nz
from ..functions.urls import URL, let, urls_in

#: Names under which sources keep headers, attachments and their parts, first one first. Fixed values.
HEADER_CONTAINERS = ("headers", "email_headers", "email")
ATTACHMENT_CONTAINERS = ("attachments", "email_attachments", "files")
NAME_KEYS = ("name", "filename", "file_name", "fileName", "file")
MIME_KEYS = ("mime", "mime_type", "content_type", "contentType", "type")
URL_KEYS = ("urls", "extracted_urls", "embedded_urls", "links", "hrefs")
QR_KEYS = ("qr_urls", "qr_codes", "qr", "qrcode", "qr_code", "decoded_qr")
ENCRYPTED_KEYS = ("encrypted", "password_protected", "is_encrypted", "protected")
MOST_ATTACHMENTS, MOST_LINKS, MOST_TEXT = 25, 25, 100_000


def load_brands(path: str) -> dict:
    """Brands with their domains, URL shorteners and free-mail providers of a JSON file; empty where there is no file or key."""
    found = json.loads(Path(path).read_text()) if Path(path).exists() else {}
    return {"brands": found.get("brands", {}), "url_shorteners": found.get("url_shorteners", []), "free_mail": found.get("free_mail", [])}


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _list(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def headers(raw: Column) -> Column:
    """array of (name, values): the headers of the first container that is an object; names in lower case, values cut to 4000 characters."""
    containers = F.array(*(F.try_variant_get(raw, f"$['{k}']", "variant") for k in HEADER_CONTAINERS))
    box = F.try_element_at(F.filter(containers, lambda v: _kind(v).startswith("OBJECT")), F.lit(1))
    entries = F.map_entries(F.coalesce(F.try_variant_get(box, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    cut = lambda s: F.substring(s, 1, MOST_HEADER_CHARS)
    values = lambda v: F.when(_kind(v).startswith("ARRAY"), F.transform(F.filter(F.transform(_list(v), _string), lambda s: s.isNotNull()), cut)).when(_kind(v) == "STRING", F.array(cut(_string(v)))).otherwise(F.array().cast("array<string>"))
    return F.transform(entries, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("name"), values(e["value"]).alias("values")))


def header(all_headers: Column, name: str) -> Column:
    """All values of a header; the last entry of its name counts."""
    found = F.try_element_at(F.filter(all_headers, lambda h: h["name"] == name), F.lit(-1))
    return F.coalesce(found["values"], F.array().cast("array<string>"))


def links_under(record: Column, keys) -> Column:
    """Distinct URLs anywhere below some keys of a VARIANT record, in order, so many at most.

    What stands below a key is read as JSON text, whose quotes and escapes end a URL as they would in the text itself.
    """
    below = F.concat(*(F.coalesce(let(F.try_variant_get(record, f"$['{k}']", "variant"), lambda v: F.slice(F.regexp_extract_all(F.substring(F.coalesce(_string(v), F.to_json(v)), 1, MOST_TEXT), F.lit(URL), F.lit(0)), 1, 4 * MOST_LINKS)), F.array().cast("array<string>")) for k in keys))
    return F.slice(F.array_distinct(F.transform(below, lambda u: F.regexp_replace(u, "[.,;]+$", ""))), 1, MOST_LINKS)


def _first_text(record: Column, keys) -> Column:
    return F.coalesce(*(nz(F.trim(_string(F.try_variant_get(record, f"$['{k}']", "variant")))) for k in keys))


def _truthy(record: Column, key: str) -> Column:
    v = F.try_variant_get(record, f"$['{key}']", "variant")
    return F.coalesce((_kind(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean"), F.lit(False)) | F.coalesce(F.lower(F.trim(_string(v))).isin("true", "yes", "1"), F.lit(False))


def attachments(raw: Column) -> Column:
    """struct(read: array of (name, mime, urls, qr_urls, encrypted), delivered): attachment records of all containers, 25 read at most.

    A container may be a list or a single record, a record an object or a bare file name.
    """
    box = lambda k: let(F.try_variant_get(raw, f"$['{k}']", "variant"), lambda v: F.when(_kind(v).startswith("OBJECT"), F.array(v)).when(_kind(v).startswith("ARRAY"), _list(v)).otherwise(F.array().cast("array<variant>")))
    every = F.concat(*(box(k) for k in ATTACHMENT_CONTAINERS))

    def read(v: Column) -> Column:
        name = F.when(_kind(v) == "STRING", F.trim(_string(v))).otherwise(_first_text(v, NAME_KEYS))
        encrypted = F.lit(False)
        for k in ENCRYPTED_KEYS:
            encrypted = encrypted | _truthy(v, k)
        return F.struct(F.coalesce(name, F.lit("")).alias("name"), F.lower(F.coalesce(_first_text(v, MIME_KEYS), F.lit(""))).alias("mime"), links_under(v, URL_KEYS).alias("urls"), links_under(v, QR_KEYS).alias("qr_urls"), encrypted.alias("encrypted"))

    usable = lambda v: (_kind(v) == "STRING") | _kind(v).startswith("OBJECT")
    return F.struct(F.transform(F.slice(F.filter(every, usable), 1, MOST_ATTACHMENTS), read).alias("read"), F.size(every).alias("delivered"))


def messages(alerts: DataFrame, raw_json: str = "raw_log") -> DataFrame:
    """What phishing.analyze wants, of alerts with a raw log: headers, recipients, links and attachments."""
    df = alerts.withColumn("_raw", F.try_parse_json(raw_json))
    df = df.withColumns({"_headers": headers(F.col("_raw")), "_files": attachments(F.col("_raw"))})
    h = lambda name: header(F.col("_headers"), name)
    to = F.flatten(F.transform(F.concat(h("to"), h("cc")), lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"[\w.+-]+@[\w.-]+\.\w+"), F.lit(0))))
    return df.select(
        "alert_id", h("from").alias("from_header"), F.try_element_at(h("reply-to"), F.lit(1)).alias("reply_to"), h("authentication-results").alias("auth_results"), h("received").alias("received"),
        F.array_distinct(to).alias("recipients"), urls_in(F.col(raw_json)).alias("urls"), F.col("_files.read").alias("attachments"), F.col("_files.delivered").alias("delivered"),
    )


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a folder of alert files."""
    from .ecs import read_alert_files

    return messages(read_alert_files(spark, path))
