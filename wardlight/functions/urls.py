"""URLs and domains as a browser reads them: a backslash ends the authority, and text before @ is no host."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Public suffixes of two labels, and second-level labels that are generic under country codes.
SUFFIXES = "co.uk org.uk ac.uk gov.uk me.uk net.uk sch.uk co.jp or.jp ne.jp ac.jp go.jp com.au net.au org.au edu.au gov.au co.nz net.nz org.nz govt.nz co.za org.za web.za com.br net.br org.br gov.br com.mx com.ar com.co com.pe com.cl com.cn net.cn org.cn gov.cn com.sg com.hk com.tw com.my com.ph co.in net.in org.in co.kr or.kr com.tr com.ua com.pl com.sa co.il com.eg com.ng co.ke".split()
GENERIC = "co com net org gov edu ac or ne go govt web sch mil int asn id in nom gen ltd plc firm info biz name pro res gob".split()
CREDENTIAL_PATHS = ("/login", "/signin", "/sign-in", "/auth", "/verify", "/owa", "/webmail", "/account/secure", "/mfa", "/password", "/session", "/validate")
MOST_URLS = 200
URL = r"(?i)https?://[^\s\\\"'<>)\]]+"


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def staged(given: dict[str, Column], *steps) -> Column:
    """A struct built step by step: each step gets the struct so far and gives further fields (name: Column).

    The whole is one expression in which each step is computed once a row, however often later ones read it. As separate
    columns they would be written out again for each reader as soon as a filter is pushed below them.
    """

    def go(s: Column, names: list[str], rest) -> Column:
        if not rest:
            return s
        new = rest[0](s)
        kept = [n for n in names if n not in new]
        whole = F.struct(*(s[n].alias(n) for n in kept), *(c.alias(n) for n, c in new.items()))
        return let(whole, lambda t: go(t, [*kept, *new], rest[1:]))

    return let(F.struct(*(c.alias(n) for n, c in given.items())), lambda s: go(s, list(given), steps))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:.*?://)?+([^/?#\\]*)", 1)


def host_in(authority: Column) -> Column:
    """The host of an authority: without user, port and brackets, in lower case."""
    behind_user = F.when(F.contains(authority, F.lit("@")), F.regexp_replace(authority, r"^.*@", "")).otherwise(authority)
    return let(behind_user, lambda bare: F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[*([^\]]*)", 1)).otherwise(F.substring_index(bare, ":", 1))))


def host(url: Column) -> Column:
    return host_in(authority(url))


def has_userinfo(url: Column) -> Column:
    return F.contains(authority(url), F.lit("@"))


def _bare(domain: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(domain, F.lit(""))))
    return F.when(F.contains(F.substring(name, -3, 3), F.lit(".")), F.regexp_replace(name, r"\.+$", "")).otherwise(name)


def _single_dots(bare: Column) -> Column:
    return F.when(F.startswith(bare, F.lit(".")) | F.contains(bare, F.lit("..")), F.regexp_replace(bare, r"^\.+|(?<=\.)\.+", "")).otherwise(bare)


def _cut(bare: Column, dotted: Column) -> Column:
    """The last labels of a domain; dotted has no empty label."""
    tail = lambda k: F.substring_index(dotted, ".", -k)
    last, second = tail(1), F.substring_index(tail(2), ".", 1)
    deep = tail(2).isin(*SUFFIXES) | ((F.length(last) == 2) & last.rlike("^[a-z]{2}$") & second.isin(*GENERIC))
    return F.when(~F.contains(dotted, F.lit(".")), bare).when(deep, tail(3)).otherwise(tail(2))


def org_domain(domain: Column) -> Column:
    """The registrable domain: two labels, or three under a two-label public suffix.

    An expression without lambdas, so Spark compiles it, finds its repeated parts and folds it over constants. Inside of a
    lambda nothing is compiled and repeated parts are computed again; org_within is for there.
    """
    return _cut(_bare(domain), _single_dots(_bare(domain)))


def org_within(domain: Column) -> Column:
    """org_domain for the body of a lambda."""
    return let(_bare(domain), lambda bare: let(_single_dots(bare), lambda dotted: _cut(bare, dotted)))


def aligned(a: Column, b: Column) -> Column:
    """Whether two domains belong together; null if one isn't known."""
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(known, org_domain(a) == org_domain(b))


def urls_in(text: Column, most: int = MOST_URLS) -> Column:
    """Distinct URLs of a text in order, without the punctuation that ends a sentence."""
    found = F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;]+$", ""))
    return F.slice(F.array_distinct(found), 1, most)


def is_raw_ip(h: Column) -> Column:
    return h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def brand_in(text: Column, brand: str) -> Column:
    """The brand at the start of a word; a short one as a whole word."""
    return text.rlike(rf"(?<![a-z0-9])\Q{brand}\E" + ("(?![a-z0-9])" if len(brand) <= 4 else ""))


def after_authority(url: Column) -> Column:
    """Path, query and fragment, in lower case."""
    return F.lower(F.regexp_replace(url, r"^.*?://[^/?#\\]*", ""))


def is_credential_path(rest: Column) -> Column:
    return reduce(lambda a, p: a | F.contains(rest, F.lit(p)), CREDENTIAL_PATHS, F.lit(False))


def credential_path(url: Column) -> Column:
    return let(after_authority(url), is_credential_path)


#: Scripts whose mixture in one word marks a homograph.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Hebrew")


def mixed_script(text: Column) -> Column:
    """Whether a word of the text mixes letters of two of the scripts."""
    count = lambda w: sum((w.rlike(rf"\p{{Is{s}}}").cast("int") for s in SCRIPTS[1:]), w.rlike(r"\p{IsLatin}").cast("int"))
    beyond_ascii = F.octet_length(text) > F.length(text)  # all scripts but Latin are, so other texts aren't split
    return F.coalesce(beyond_ascii, F.lit(False)) & F.exists(F.split(F.coalesce(text, F.lit("")), r"[\s@._\-<>()\"',]+"), lambda w: (F.length(w) > 1) & (count(w) > 1))


@F.pandas_udf(T.StringType())
def decode_punycode(hosts: pd.Series) -> pd.Series:
    """Labels with xn-- as they are shown; a label that can't be decoded stays. Whole batches; only hosts with such a label are touched."""

    def shown(label: str) -> str:
        try:
            return label.encode("ascii").decode("idna") if label.startswith("xn--") else label
        except (UnicodeError, ValueError):
            return label

    marked = hosts.str.contains("xn--", regex=False, na=False)
    return hosts.where(~marked, hosts[marked].map(lambda h: ".".join(map(shown, h.split(".")))))
