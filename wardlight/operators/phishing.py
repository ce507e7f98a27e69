"""Mail signals: each a predicate that yields an array of one (name, strength) struct, or of none.

messages have: alert_id, from_header (array), reply_to, auth_results (array of headers, topmost first), received (array),
recipients (array), urls (array), attachments (array of name, mime, urls, qr_urls, encrypted).

What is asked of a message is computed in steps, each a projection whose columns the next one reads by name: so Spark
compiles it. The body of a lambda is interpreted, so lambdas have only what is asked of an element of an array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mail, urls

MOST_CHANNEL_URLS = 5


_NONE = "array<struct<name:string,strength:string>>"


def _signal(test: Column, name: str, strength: str | Column) -> Column:
    level = F.lit(strength) if isinstance(strength, str) else strength
    return F.when(F.coalesce(test, F.lit(False)), F.array(F.struct(F.lit(name).alias("name"), level.alias("strength")))).otherwise(F.array().cast(_NONE))


def _any(cs) -> Column:
    return reduce(lambda a, b: a | b, cs, F.lit(False))


INPUTS = ("from_header", "reply_to", "auth_results", "received", "recipients", "urls", "attachments")
#: What identify adds.
FACTS = ("auth", "spf", "dmarc", "compauth", "header_from", "from_domain", "envelope_from", "spf_result", "dkim_result", "dmarc_result", "dkim_domain", "spf_aligned", "dkim_aligned", "aligned_pass", "authenticated")


class _Fields:
    """The columns of a message by name: its own ones, and those that steps have added."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name if name in INPUTS else f"_mail_{name}")


def _staged(messages: DataFrame, *steps) -> DataFrame:
    """The messages with the columns of each step (name: Column), which reads those of the steps before it.

    Steps stay apart in the plan where a column is read more than once. Results leave through _fenced, lest a filter on
    them be pushed below the steps, which would write their expressions out for each of its readers.
    """
    for step in steps:
        messages = messages.withColumns({f"_mail_{n}": c for n, c in step(_Fields()).items()})
    return messages


def _fenced(staged: DataFrame, names) -> DataFrame:
    """The messages' own columns, and these ones of the steps under their names."""
    out = staged.select("*", F.inline_outer(F.array(F.struct(*(_Fields()[n].alias(n) for n in names)))))
    return out.drop(*(c for c in staged.columns if c.startswith("_mail_")))


def _same(domain: Column, org: Column, s) -> Column:
    """Whether an organisation is that of the author's domain; null if either domain isn't known."""
    known = lambda x: F.coalesce(x, F.lit("")) != ""
    return F.when(known(domain) & known(s["from_domain"]), org == s["from_org"])


def _parsed(s) -> dict[str, Column]:
    return {"author": F.try_element_at(s["from_header"], F.lit(1)), "auth": mail.auth_results(F.try_element_at(s["auth_results"], F.lit(1)))}


def _methods(s) -> dict[str, Column]:
    one = {n: mail.method(s["auth"], n) for n in ("spf", "dmarc", "compauth")}
    return one | {"header_from": mail.address(s["author"]), "dkim": F.filter(s["auth"], lambda e: e["method"] == "dkim")}


def _domains(s) -> dict[str, Column]:
    signer = lambda e: F.coalesce(mail.prop(e, "header.d"), mail.domain_of(mail.prop(e, "header.i")))
    return {
        "from_domain": F.coalesce(mail.domain_of(s["header_from"]), mail.prop(s["dmarc"], "header.from")), "sender": mail.prop(s["spf"], "smtp.mailfrom"),
        "spf_result": s["spf"]["result"], "dmarc_result": s["dmarc"]["result"], "sigs": F.transform(s["dkim"], lambda e: F.struct(e["result"].alias("result"), signer(e).alias("domain"))),
    }


def _envelope(s) -> dict[str, Column]:
    return {"envelope_from": F.when(~s["sender"].isin("<>", "", "@"), F.coalesce(mail.domain_of(s["sender"]), s["sender"]))}


def _orgs(s) -> dict[str, Column]:
    named = F.transform(s["sigs"], lambda e: F.struct(e["result"].alias("result"), e["domain"].alias("domain"), urls.org_within(e["domain"]).alias("org")))
    return {"from_org": urls.org_domain(s["from_domain"]), "envelope_org": urls.org_domain(s["envelope_from"]), "sigs": named}


def _signed(s) -> dict[str, Column]:
    passing = F.filter(s["sigs"], lambda e: e["result"] == "pass")
    good = F.filter(s["sigs"], lambda e: (e["result"] == "pass") & F.coalesce(_same(e["domain"], e["org"], s), F.lit(False)))
    return {"spf_aligned": _same(s["envelope_from"], s["envelope_org"], s), "passing": passing, "good": good}


def _concluded(s) -> dict[str, Column]:
    first = lambda c: F.try_element_at(c, F.lit(1))
    none = F.array().cast("array<string>")
    passed = F.coalesce((s["spf_result"] == "pass") & s["spf_aligned"], F.lit(False)) | (F.size(s["good"]) > 0) | F.coalesce(s["dmarc_result"] == "pass", F.lit(False))
    signers = F.transform(F.filter(s["passing"], lambda e: e["domain"].isNotNull()), lambda e: e["org"])
    return {"shown": F.coalesce(first(s["good"]), first(s["passing"]), first(s["sigs"])), "aligned_pass": passed, "authenticated": F.array_distinct(F.concat(F.when(s["spf_result"] == "pass", F.array(s["envelope_org"])).otherwise(none), signers))}


def _shown(s) -> dict[str, Column]:
    return {"dkim_domain": s["shown"]["domain"], "dkim_result": s["shown"]["result"], "dkim_aligned": F.when(F.size(s["good"]) > 0, True).otherwise(_same(s["shown"]["domain"], s["shown"]["org"], s))}


_IDENTITY = (_parsed, _methods, _domains, _envelope, _orgs, _signed, _concluded, _shown)


def identify(messages: DataFrame) -> DataFrame:
    """Adds who sent the message and what was authenticated (FACTS); spf_aligned and dkim_aligned are null where a side isn't known."""
    return _fenced(_staged(messages, *_IDENTITY), FACTS)


def auth_signals(s) -> list[Column]:
    c = lambda n: s[n]
    return [
        _signal(c("from_domain").isNotNull() & ~c("aligned_pass") & (c("spf").isNotNull() | c("dkim_result").isNotNull() | c("dmarc").isNotNull()), "no_aligned_authentication", "strong"),
        _signal(c("dmarc_result") == "fail", "dmarc_fail", "strong"), _signal(c("dmarc_result") == "none", "dmarc_no_policy", "moderate"), _signal(c("dmarc_result") == "bestguesspass", "dmarc_best_guess", "moderate"),
        _signal(c("compauth")["result"] == "fail", "composite_auth_fail", "moderate"), _signal(F.size(c("auth_results")) > 1, "untrusted_authentication_results", "moderate"),
    ]


def _org_of(domains: list[str]) -> Column:
    """The organisations of listed domains, as an array of constants that the optimizer folds."""
    return F.array(*(urls.org_domain(F.lit(d)) for d in domains)).cast("array<string>")


def _among(org: Column, domains: list[str]) -> Column:
    return F.array_contains(_org_of(domains), org) if domains else F.lit(False)


def header_facts(s) -> dict[str, Column]:
    """The name that a reader sees, and where answers go."""
    return {"name": mail.display_name(s["author"]), "reply": mail.domain_of(mail.address(s["reply_to"]))}


def brand_facts(s, brands: dict[str, list[str]]) -> dict[str, Column]:
    """Whose answers those are, and the first brand in the name."""
    name = F.lower(s["name"])
    return {"reply_org": urls.org_domain(s["reply"]), "brand": F.coalesce(*(F.when(urls.brand_in(name, b), F.lit(b)) for b in brands), F.lit(None).cast("string"))}


def header_signals(s, brands: dict[str, list[str]], free_mail: list[str]) -> list[Column]:
    c = lambda n: s[n]
    elsewhere = c("from_domain").isNotNull() & c("reply").isNotNull() & (c("reply_org") != c("from_org"))
    inside = F.lower(F.regexp_extract(c("name"), r"(?U)[\w.+-]+@[\w.-]+\.\w+", 0))
    owners = _any((c("brand") == b) & _among(c("from_org"), own) for b, own in brands.items())
    return [
        _signal(F.size(c("from_header")) > 1, "multiple_from_headers", "strong"),
        _signal(elsewhere & c("reply").isin(*free_mail), "reply_to_free_mail", "moderate"), _signal(elsewhere & ~c("reply").isin(*free_mail), "reply_to_other_domain", "weak"),
        _signal((inside != "") & c("header_from").isNotNull() & (inside != c("header_from")), "display_name_contains_other_address", "moderate"),
        _signal(urls.mixed_script(c("name")), "display_name_mixed_script", "strong"), _signal(c("from_domain").isNotNull() & c("brand").isNotNull() & ~owners, "display_name_brand_mismatch", "moderate"),
    ]


def url_facts(links: Column) -> Column:
    """For each URL what the signals ask of it: (authority, host, org, before, path, fragment)."""

    def told(u: Column, authority: Column, host: Column) -> Column:
        before = F.when(F.substring_index(host, ".", -2) != host, F.regexp_replace(host, r"\.[^.]*\.[^.]*$", "")).otherwise("")
        mark = F.instr(u, "#")
        fragment = F.when(mark > 0, F.lower(F.substring(u, mark + 1, F.length(u)))).otherwise("")
        return F.struct(authority.alias("authority"), host.alias("host"), urls.org_within(host).alias("org"), before.alias("before"), urls.after_authority(u).alias("path"), fragment.alias("fragment"))

    return F.transform(links, lambda u: urls.let(urls.authority(u), lambda a: urls.let(urls.host_in(a), lambda h: told(u, a, h))))


def url_signals(facts: Column, brands: dict[str, list[str]], shorteners: list[str], recipients: Column | None = None, decoded: Column | None = None) -> list[Column]:
    """Signals of an array of url_facts; each comes once, those of a brand once a brand. decoded: the first host with a punycode label as it is shown."""
    some = lambda test: F.exists(facts, test)

    def branded(b: str, own: list[str]) -> Column:
        return _signal(some(lambda x: urls.brand_in(x["before"], b) & ~_among(x["org"], own)), "brand_in_subdomain", "strong")

    level = F.lit("moderate") if decoded is None else F.when(urls.mixed_script(decoded), "strong").otherwise("moderate")
    out = [
        _signal(some(lambda x: F.contains(x["host"], F.lit("xn--"))), "punycode_domain", level),
        _signal(some(lambda x: F.contains(x["authority"], F.lit("@"))), "url_userinfo_authority", "strong"), _signal(some(lambda x: urls.is_raw_ip(x["host"])), "url_raw_ip_host", "moderate"),
        _signal(some(lambda x: x["host"].isin(*shorteners)), "url_shortener", "weak"), *(branded(b, own) for b, own in brands.items()), _signal(some(lambda x: urls.is_credential_path(x["path"])), "credential_harvest_path", "weak"),
    ]
    if recipients is not None:
        bounded = lambda r: F.concat(F.lit(r"(?<![a-z0-9._%+-])\Q"), r, F.lit(r"\E(?![a-z0-9._%+-])"))
        named = lambda x: (x["fragment"] != "") & F.exists(recipients, lambda r: (F.length(r) >= 4) & F.contains(x["fragment"], F.lower(r)) & F.regexp_like(x["fragment"], bounded(F.lower(r))))
        out.append(_signal(some(named), "recipient_in_url_fragment", "strong"))
    return out


def first_punycode(links: Column) -> Column:
    """The first host of an array of URLs that has a punycode label."""
    return F.try_element_at(F.filter(F.transform(F.filter(links, lambda u: F.contains(F.lower(u), F.lit("xn--"))), urls.host), lambda h: F.contains(h, F.lit("xn--"))), F.lit(1))


def attachment_facts(s) -> dict[str, Column]:
    """The distinct links of all attachments that have a host."""
    hosted = lambda key: F.filter(F.array_distinct(F.flatten(F.transform(s["attachments"], lambda a: F.coalesce(a[key], F.array().cast("array<string>"))))), lambda u: urls.host(u) != "")
    return {"qr_urls": hosted("qr_urls"), "file_urls": hosted("urls")}


def attachment_signals(s, brands: dict[str, list[str]]) -> Column:
    """Signals of all attachments, in their order."""
    every = [o for own in brands.values() for o in own]

    def of(a: Column) -> Column:
        parts = lambda e: F.filter(F.split(F.lower(e), r"\."), lambda p: p != "")
        read = lambda e: F.struct(a["name"].alias("name"), F.lower(a["mime"]).alias("mime"), a["encrypted"].alias("encrypted"), mail.base_name(a["name"]).alias("base"), e.alias("effective"), mail.extension_of(e).alias("ext"), parts(e).alias("parts"))
        return urls.let(urls.let(mail.effective_name(a["name"]), read), judged)

    def judged(x: Column) -> Column:
        name, ext, effective, parts = x["name"], x["ext"], x["effective"], x["parts"]
        last, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
        is_in = lambda c, s: c.isin(*sorted(s))
        wrong = _any((x["mime"] == m) & ~is_in(ext, e) for m, e in mail.EXPECTED.items())
        by_type = (
            F.when(is_in(ext, mail.EXECUTABLE | mail.SCRIPT), _signal(F.lit(True), "attachment_executable_type", "strong"))
            .when(is_in(ext, mail.SHORTCUT), _signal(F.lit(True), "attachment_shortcut_type", "strong"))
            .when(is_in(ext, mail.CONTAINER), _signal(F.lit(True), "attachment_mark_of_the_web_container", "moderate"))
            .when(is_in(ext, mail.MACRO), _signal(F.lit(True), "attachment_macro_enabled_document", "moderate"))
            .otherwise(_signal(is_in(ext, mail.HTML), "attachment_html_document", "strong"))
        )
        return F.concat(
            _signal(F.contains(name, F.lit("‮")), "attachment_bidi_filename", "strong"), _signal((effective != "") & (effective != x["base"]), "attachment_filename_obscured", "moderate"),
            _signal((F.size(parts) >= 3) & is_in(last, mail.EXECUTABLE | mail.SCRIPT | mail.SHORTCUT) & is_in(before, mail.DOCUMENT), "attachment_double_extension", "strong"), by_type,
            _signal(x["encrypted"] & (is_in(ext, mail.ARCHIVE) | (ext == "")), "attachment_encrypted_archive", "moderate"), _signal((ext != "") & wrong, "attachment_type_mismatch", "moderate"),
        )

    def qr(u: Column) -> Column:
        level = urls.let(urls.org_within(urls.host(u)), lambda org: F.when(s["from_domain"].isNull(), "moderate").when(org == s["from_org"], "weak").when(_among(org, every), "moderate").otherwise("strong"))
        return F.struct(F.lit("attachment_qr_url").alias("name"), level.alias("strength"))

    plain = lambda u: F.struct(F.lit("attachment_embedded_url").alias("name"), F.lit("moderate").alias("strength"))
    shown = lambda key, f: F.transform(F.slice(s[key], 1, MOST_CHANNEL_URLS), f)
    many = [_signal(F.size(s[k]) > MOST_CHANNEL_URLS, f"attachment_{n}_urls_truncated", "moderate") for k, n in (("qr_urls", "qr"), ("file_urls", "embedded"))]
    return F.concat(F.flatten(F.transform(s["attachments"], of)), shown("qr_urls", qr), shown("file_urls", plain), *many)


def analyze(messages: DataFrame, brands: dict[str, list[str]], shorteners: list[str], free_mail: list[str], senders: dict[str, list[str]] | None = None) -> DataFrame:
    """(alert_id, header_from, envelope_from, dkim_domain, results, alignments, signals); no row for a message without From and results.

    senders: authorized domains of mail providers by author domain, from the inventory.
    """
    own = messages.where((F.size("from_header") > 0) | (F.size("auth_results") > 0)).select("alert_id", *INPUTS)

    def facts(s) -> dict[str, Column]:
        return header_facts(s) | attachment_facts(s) | {"links": url_facts(s["urls"]), "hops": mail.hop_seconds(s["received"])}

    def judge(s) -> dict[str, Column]:
        known = _any(_among(s["from_org"], [a]) & F.arrays_overlap(s["authenticated"], _org_of(ds)) for a, ds in (senders or {}).items() if ds)
        single = [*auth_signals(s), *header_signals(s, brands, free_mail), *url_signals(s["links"], brands, shorteners, s["recipients"], s["decoded"])]
        after = [_signal(mail.goes_backwards(s["hops"]), "received_chain_non_monotonic", "strong"), _signal(known, "sanctioned_bulk_sender", "weak")]
        return {"signals": F.concat(*single, attachment_signals(s, brands), *after)}

    told = _staged(own, lambda s: {"decoded": urls.decode_punycode(first_punycode(s["urls"]))}, *_IDENTITY, facts, lambda s: brand_facts(s, brands), judge)
    return _fenced(told, ("header_from", "envelope_from", "dkim_domain", "spf_result", "dkim_result", "dmarc_result", "spf_aligned", "dkim_aligned", "signals")).drop(*INPUTS)
