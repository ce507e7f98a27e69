"""Text functions: flattening for reports, digits, addresses, technique codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUAD = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def nz(c: Column) -> Column:
    """An empty string is as good as none."""
    return F.nullif(c, F.lit(""))


def flatten(c: Column) -> Column:
    """No character of a value can start a new line of a report."""
    return F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f\u2028\u2029]", " ")


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(flatten(c), r"(?U)\s+", " "))


def digits_out(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+", "#")


def is_ipv4(c: Column) -> Column:
    return c.rlike(_QUAD)


def net24(ip: Column) -> Column:
    """The /24 of a dotted quad; null for anything else."""
    return F.when(is_ipv4(ip), F.concat(F.substring_index(ip, ".", 3), F.lit(".0")))


def int_to_ipv4(c: Column) -> Column:
    """An address that was recorded as a number."""
    n = c.cast("long")
    part = lambda shift: F.shiftright(n, shift).bitwiseAND(255).cast("string")
    return F.when((n >= 0) & (n < 1 << 32), F.concat_ws(".", part(24), part(16), part(8), part(0)))


#: Address ranges that are not globally routable, as (first octets pattern). Fixed values from the IANA registry.
_LOCAL = r"^(?:0|10|127)\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.0\.0\.|^192\.0\.2\.|^192\.168\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(?:22[4-9]|23\d|24\d|25[0-5])\."


def is_global(ip: Column) -> Column:
    return is_ipv4(ip) & ~ip.rlike(_LOCAL)


def technique_codes(texts: Column) -> Column:
    """Distinct technique codes in an array of strings, the first of each string, in order."""
    return F.array_distinct(F.filter(F.transform(texts, lambda x: F.regexp_extract(x, r"T\d{4}(?:\.\d{3})?", 0)), lambda x: x != ""))


def parent_codes(texts: Column) -> Column:
    """Distinct parent codes of all technique codes in an array of strings."""
    found = F.flatten(F.transform(texts, lambda x: F.regexp_extract_all(x, F.lit(r"(T\d{4})(?:\.\d{3})?"), F.lit(1))))
    return F.array_distinct(found)


def parent_by_cut(texts: Column) -> Column:
    """Another parenting: what stands before the first dot, trimmed and in upper case; a label after the code stays part of it."""
    return F.array_distinct(F.transform(F.filter(texts, lambda x: x != ""), lambda x: F.upper(F.trim(F.substring_index(x, ".", 1)))))


def duration(seconds: Column) -> Column:
    """90s, 12m, 3.5h, 2.1d; a sign stays."""
    size = F.abs(seconds)
    number = lambda by, unit: F.concat(F.when(seconds < 0, "-").otherwise(""), F.format_string("%.1f" + unit, size / by))
    return F.when(size < 60, F.concat(F.format_string("%.0f", seconds), F.lit("s"))).when(size < 3600, number(60.0, "m")).when(size < 86400, number(3600.0, "h")).otherwise(number(86400.0, "d"))


def parse_iso(c: Column) -> Column:
    """A timestamp, or null where the text isn't one; without a zone it is UTC."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(c))
