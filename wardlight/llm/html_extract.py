"""Main text of web pages by consensus: pages of a host vote for the path of the container that holds the article."""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import Given
from .store import Scratch

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript title textarea iframe noembed noframes xmp".split())
HIDDEN = frozenset("template svg math object select datalist".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body center".split())
BOILERPLATE = frozenset("nav header footer aside form menu button dialog".split())
CLOSES_P = BLOCK - {"br", "body", "html"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: The support that one unseen page gives a path, and the part of a page's best score that covers its article.
PRIOR, COVER = 0.95, 0.5
#: Words of class, id and role that mark what surrounds an article, and that mark the article itself.
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
MAIN_WORDS = frozenset("article body content entry main post story text".split())
#: Words that tell where a part stands or what shape it has, and nothing about what is in it; and those of ASIDE_WORDS that mark even a paragraph or a heading.
PLACE_WORDS = frozenset("area bar bottom box col column container fixed global group inner item items left link links list main outer page primary right row secondary section site sticky top wrap wrapper".split())
LINE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner comment comments consent cookie cookies notice notices promo promoted sponsor sponsored".split())
#: Words that mark reader comments whatever stands beside them in a name, but for words that tell only whether there are any; and what a name of a cookie notice may hold besides.
COMMENT_WORDS = frozenset("comment comments disqus replies reply".split())
STATE_WORDS = frozenset("allowed closed count disabled enabled has no number off on open with without".split())
CONSENT_WORDS = frozenset("accept alert gdpr info law message policy settings wall warning".split())
LINES = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption dd dt li td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

# a tag holds no further "<" outside quotes; what does is text
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/><]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[A-Za-z][^<>]*\Z|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/><]*)(?P<rest2>[^<>]*)>", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "path", "aside", "lead", "weight", "parent", "words", "linked")

    def __init__(self, name, path, aside, lead, weight, parent):
        self.name, self.path, self.aside, self.lead, self.weight, self.parent = name, path, aside, lead, weight, parent
        self.words = self.linked = 0


def _marks(rest: str) -> tuple[str, set[str], set[str]]:
    """The generalised class names of a tag, all words of its class, id and role, and those words that alone say what it is.

    A name of several words, such as ``share-prices``, says so only if its other words are words of place; one with a
    word for comments, such as ``reader-comments``, says so in any case but ``comments-open`` and its like.
    """
    classes, found, sure = [], set(), set()
    for key, *value in _MARK.findall(rest):
        text = (value[0] or value[1] or value[2]).lower()
        for name in text.split():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            found.update(words)
            if all(w in ASIDE_WORDS or w in PLACE_WORDS for w in words) or {"cookie", "cookies", "consent"}.intersection(words) and all(w in ASIDE_WORDS or w in PLACE_WORDS or w in CONSENT_WORDS for w in words):
                sure.update(words)
            elif not STATE_WORDS.intersection(words):
                sure.update(COMMENT_WORDS.intersection(words))
        if key.lower() == "class":
            classes = sorted({re.sub(r"\d+", "#", c) for c in text.split()})
    return "".join(f".{c}" for c in classes), found, sure & ASIDE_WORDS


def _is_aside(name: str, words: set[str], sure: set[str]) -> bool:
    """Whether an element, by its own marks, stands beside the article."""
    if name in BOILERPLATE:
        return True
    if name in LINES:
        return bool(sure & LINE_WORDS)
    return bool(sure) and not (name in ("article", "main", "body", "html") or words & MAIN_WORDS & {"main"} and name in CONTAINER)


def _within(node: Node, names) -> bool:
    while node is not None and node.name not in names:
        node = node.parent
    return node is not None


def parse(page: str) -> tuple[list[tuple[str, Node]], list[Node]]:
    """(blocks, containers): text blocks in page order with the element they stand in, and all container elements.

    What stands beside the article is marked. Headings in the header of an article belong to it, the rest of that header doesn't.
    """
    root = Node("", "", False, False, 0.0, None)
    here, blocks, containers, parts = root, [], [], []
    at, link = 0, 0
    hidden: list[str] = []  # open elements from a hidden one on

    def flush():
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(x for x, _ in parts))).strip()
            if text:
                blocks.append((text, here))
                linked = sum(len(x) for x, in_link in parts if in_link)
                node = here
                while node is not None and not node.aside:
                    node.words += len(text)
                    node.linked += linked
                    node = node.parent
            parts.clear()

    def close(names, fence):
        nonlocal here
        node = here
        while node is not root and node.name not in names and node.name not in fence:
            node = node.parent
        if node is not root and node.name in names:
            flush()
            here = node.parent

    while (m := _TOKEN.search(page, at)) is not None:
        if not hidden and m.start() > at:
            parts.append((page[at : m.start()], link > 0))
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if not hidden and m["cdata"]:
                parts.append((html.escape(m["cdata"]), link > 0))
            continue
        if m["end"] or m["end2"]:
            if hidden and name in hidden:
                while hidden.pop() != name:
                    pass
                continue
            if hidden and not (name in BLOCK and _within(here, {name})):
                continue
            hidden.clear()  # an element around it ends: it was never closed
            if name == "a":
                link = max(0, link - 1)
            elif name == "p" or name in BLOCK and name != "br":
                flush()
                close({name}, {"table"} if name in ("li", "p") else ())
            continue
        if name in RAW:  # no tags inside; a title or textarea that never ends is none
            if (over := _RAW_END[name].search(page, at)) is not None:
                at = over.end()
            elif name in ("script", "style"):
                at = len(page)
            continue
        if hidden or name in HIDDEN:
            if not m.group().endswith("/>") and (name in HIDDEN or name in BLOCK and name not in VOID):
                hidden.append(name)
            continue
        if name == "a":
            link += 1
        if name not in BLOCK:
            continue
        flush()
        if name in VOID:
            continue
        if name in CLOSES_P and here.name == "p":
            here = here.parent
        if name in SAME_CLOSES:
            close(SAME_CLOSES[name], {"ul", "ol", "dl", "table"})
        shown, words, sure = _marks(m["rest"] or m["rest2"] or "")
        mine = words & MAIN_WORDS
        lead = here.lead or name == "header" and not here.aside and _within(here, ("article", "main"))
        aside = here.aside and not (here.lead and name in HEADINGS) or _is_aside(name, words, sure)
        weight = {"article": 1.0, "main": 0.97, "body": 0.7}.get(name, 0.97 if "main" in words else 0.9 if mine else 0.8)
        here = Node(name, f"{here.path}>{name}{shown}" if name in CONTAINER else here.path, aside, lead and aside, weight, here)
        if name in CONTAINER and not aside:
            containers.append(here)
    if not hidden and at < len(page):
        parts.append((page[at:], link > 0))
    flush()
    return blocks, containers


def path_key(host: str | None, path: str) -> int:
    """What names a path of a host."""
    return int.from_bytes(hashlib.blake2b(f"{host}\0{path}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def votes(page: str) -> list[tuple[str, int]]:
    """(path, score) of all containers of a page that hold text: characters outside links in the container, by what kind it is."""
    best: dict[str, float] = {}
    _, containers = parse(page)
    for c in containers:
        if c.words:
            best[c.path] = best.get(c.path, 0.0) + max(0, c.words - 2 * c.linked) * c.weight
    return [(p, round(s)) for p, s in best.items()]


def extract(page: str, host: str | None, key: int | None) -> str:
    """The text of the containers whose path has this key; without one, of all that isn't boilerplate."""
    blocks, containers = parse(page)
    kept = [(text, node) for text, node in blocks if not node.aside]
    for path in {c.path: None for c in containers} if key is not None else ():
        if path_key(host, path) == key:
            return "\n".join(text for text, node in kept if node.path == path or node.path.startswith(path + ">"))
    return "\n".join(text for text, _ in kept)


def host(url):
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _packed(rows: DataFrame, place: int) -> DataFrame:
    """rows with the text column at this place compressed, as it goes through the shuffle whole."""

    def pack(batches):
        for batch in batches:
            pages = [None if p is None else zlib.compress(p, 1) for p in batch.column(place).cast(pa.binary()).to_pylist()]
            columns = [pa.array(pages, pa.binary()) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    fields = [T.StructField(f.name, T.BinaryType()) if i == place else f for i, f in enumerate(rows.schema.fields)]
    return rows.mapInArrow(pack, T.StructType(fields))


def _unpacked(page: bytes | None) -> str:
    return zlib.decompress(page).decode("utf-8", "replace") if page else ""


def extract_pages(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """All columns of pages that don't clash, with text (the article) in place of the markup.

    First each page scores all its containers by their generalised tag-class paths. A path's support is its part of the
    best score of the pages of the host that have it, with PRIOR for one page more. Then each page takes the containers
    under that one of its own paths with the most support among those that cover its article, which is COVER of its
    best score; without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments. All
    paths of a host are rows, and none is left out.

    A null or empty page gives an empty text; pages without a host share one vote; of paths with equal support the shortest
    is taken; html of any length is read whole; repeated rows are treated alike; an empty table gives an empty result; a
    column named text is replaced, further ones of any name are kept.
    """
    scratch = Scratch(pages.sparkSession, "html")

    def ballot(batches):
        for batch in batches:
            out = []
            for page, h, p1, p2 in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                found = votes(page.as_py() or "")
                best = max((score for _, score in found), default=0)
                out += [(p1, p2, path_key(h, path), score, best, len(path)) for path, score in found]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (zip(*out, strict=True) if out else [()] * 6)], ["p1", "p2", "k", "score", "best", "length"])

    given = Given(pages)
    kept = given.kept("text", source)
    mine = host(given[url])
    names = (F.xxhash64(mine, given[source]), F.xxhash64(given[source], F.lit(1), mine))
    cast = scratch.keep(given.table.select(given.of(source), mine.alias("mine"), names[0].alias("p1"), names[1].alias("p2")).mapInArrow(ballot, "p1 long, p2 long, k long, score long, best long, length long"))
    n, part = F.count("*"), F.coalesce(F.sum("score") / F.sum("best"), F.lit(PRIOR))
    support = cast.where("best > 0").groupBy("k").agg(((n * part + PRIOR) / (n + 1)).alias("support"))
    own = cast.where(F.col("score") >= COVER * F.col("best")).join(support, "k", "left")
    first = F.struct(F.coalesce("support", F.lit(0.0)).alias("support"), (-F.col("length")).alias("length"), "k")
    chosen = scratch.keep(own.groupBy("p1", "p2").agg(F.max(first)["k"].alias("chosen")))
    scratch.drop(cast)
    here = _packed(given.table.select(*kept, given[source].alias("page"), mine.alias("mine"), names[0].alias("o1"), names[1].alias("o2")), len(kept))
    joined = here.join(chosen.hint("shuffle_hash"), (F.col("o1") == F.col("p1")) & (F.col("o2") == F.col("p2")), "left").select(*kept, "page", "mine", "chosen")
    schema = joined.select(*kept).schema.add("found", "string")

    def take(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(len(kept))]
            texts = [extract(_unpacked(page.as_py()), h, key) for page, h, key in zip(batch.column(len(kept)), batch.column(len(kept) + 1).to_pylist(), batch.column(len(kept) + 2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*kept, "found"])

    out = joined.mapInArrow(take, schema)
    names_out = [(i, c) for i, c in zip(given.inner, given.names, strict=True) if i in kept]
    return out.select(*(F.col(i).alias(c) for i, c in names_out), F.col("found").alias("text"))
