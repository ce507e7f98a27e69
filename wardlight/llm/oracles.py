"""DuckDB SQL for the queries that SQL can express."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"


def _host(url: str) -> str:
    return f"translate(regexp_extract({url}, '{_PARTS}', 1), '{_UP}', '{_LOW}')"


def _path(url: str) -> str:
    return f"regexp_extract({url}, '{_PARTS}', 2)"


def _undotted(path: str) -> str:
    """A path with its dot segments carried out."""
    folded = f"list_reduce(list_prepend('', string_split(substr({path}, 2), '/')), lambda done, x: CASE WHEN x = '.' THEN done WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END)"
    whole = f"(CASE WHEN {folded} = '' THEN '/' ELSE {folded} END) || (CASE WHEN regexp_matches({path}, '/\\.\\.?$') AND {folded} <> '' THEN '/' ELSE '' END)"
    return f"CASE WHEN regexp_matches({path}, '/\\.\\.?(/|$)') THEN {whole} ELSE {path} END"


def _node(url: str) -> str:
    return f"CASE WHEN {_host(url)} <> '' THEN {_host(url)} || (CASE WHEN {_path(url)} = '' THEN '/' ELSE {_undotted(_path(url))} END) || regexp_extract({url}, '{_PARTS}', 3) END"


def _resolved(link: str, base: str) -> str:
    folder = f"CASE WHEN {_path(base)} = '' THEN '/' ELSE regexp_extract({_path(base)}, '(?s)^(.*/)', 1) END"
    page = f"'http://' || {_host(base)} || (CASE WHEN {_path(base)} = '' THEN '/' ELSE {_path(base)} END)"
    return f"""CASE WHEN regexp_matches({link}, '(?i)^[a-z][a-z0-9+.-]*://') THEN {link} WHEN starts_with({link}, '//') THEN 'http:' || {link} WHEN regexp_matches({link}, '(?i)^[a-z][a-z0-9+.-]*:') OR {_host(base)} = '' THEN NULL
    WHEN starts_with({link}, '/') THEN 'http://' || {_host(base)} || {link} WHEN starts_with({link}, '?') THEN {page} || {link} WHEN starts_with({link}, '#') THEN {page} || regexp_extract({base}, '{_PARTS}', 3) ELSE 'http://' || {_host(base)} || ({folder}) || {link} END"""


def _judged(host: str, path: str) -> str:
    """The verdict of the longest rule that fits."""
    return f"(SELECT max_by(verdict, length(rh || rp)) FROM rules WHERE ({host} = rh OR ends_with({host}, '.' || rh)) AND starts_with({path}, rp))"


_REF = r"""["'']?([^"''\s>]+)"""

OP4 = rf"""
WITH RECURSIVE rules(verdict, rh, rp) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
page AS (SELECT page_id, html, url, {_host("coalesce(url, '')")} AS host, {_path("coalesce(url, '')")} AS path, {_node("coalesce(url, '')")} AS node FROM pages),
fit AS (SELECT page_id, url, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS verdict
  FROM (SELECT DISTINCT page_id, url, host, path FROM page) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, url),
judged AS (SELECT p.*, f.rule, f.verdict AS own FROM page p LEFT JOIN fit f ON p.page_id IS NOT DISTINCT FROM f.page_id AND p.url IS NOT DISTINCT FROM f.url),
tag AS (SELECT node AS a, url, regexp_extract(list_filter(regexp_extract_all(html, '(?is)<base\b[^>]*'), lambda t: regexp_matches(t, '(?is)\bhref\s*=\s*{_REF}'))[1], '(?is)\bhref\s*=\s*{_REF}', 1) AS base,
    regexp_extract(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>?'), lambda t: regexp_matches(t, '(?is)\brel\s*=\s*["'']?\s*canonical["''\s/>]') AND regexp_matches(t, '(?is)\bhref\s*=\s*{_REF}'))[1], '(?is)\bhref\s*=\s*{_REF}', 1) AS canonical,
    regexp_extract(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*'), lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh') AND regexp_matches(t, '(?is)\burl\s*=\s*{_REF}'))[1], '(?is)\burl\s*=\s*{_REF}', 1) AS refresh
  FROM judged WHERE html IS NOT NULL),
link AS (SELECT a, url, regexp_replace(coalesce(base, ''), '&amp;', '&', 'gi') AS base, regexp_replace(unnest([canonical, refresh]), '&amp;', '&', 'gi') AS href FROM tag),
based AS (SELECT a, href, CASE WHEN base = '' THEN url ELSE coalesce({_resolved("base", "coalesce(url, '')")}, url) END AS base FROM link WHERE href <> ''),
target AS (SELECT a, {_resolved("href", "coalesce(base, '')")} AS url FROM based),
edge AS (SELECT a, {_node("url")} AS b FROM target WHERE url IS NOT NULL AND a IS NOT NULL),
named AS (SELECT a AS node FROM edge WHERE b IS NOT NULL AND a <> b UNION SELECT b FROM edge WHERE b IS NOT NULL AND a <> b),
bad AS (SELECT node FROM (SELECT node, {_host("'http://' || node")} AS h, {_path("'http://' || node")} AS p FROM named) WHERE {_judged("h", "p")} = 'block'),
shut(node) AS (
  SELECT node FROM judged WHERE own = 'block' AND node IS NOT NULL
  UNION SELECT node FROM bad
  UNION SELECT CASE WHEN e.a = s.node THEN e.b ELSE e.a END FROM shut s JOIN edge e ON e.b IS NOT NULL AND (e.a = s.node OR e.b = s.node))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN node IN (SELECT node FROM shut) THEN 'block' END, 'allow') AS verdict FROM judged
"""

OP2 = r"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS s FROM doc, unnest(range(1, greatest(2, len(w) - 1))) t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
linked AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(x, y) AS (SELECT a, b FROM linked UNION SELECT r.x, t.b FROM reach r JOIN linked t ON r.y = t.a),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id FROM doc d LEFT JOIN n USING (doc_id) LEFT JOIN least_of l ON l.x = d.doc_id
"""


def _quality() -> str:
    from .quality import LINE_LIMIT, NGRAM_LIMITS

    sizes = [3, *NGRAM_LIMITS]
    steps = [
        "doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)",
        "word AS (SELECT rid, p, length(w[p]) AS c FROM doc, unnest(range(1, len(w) + 1)) t(p))",
        "line AS (SELECT rid, l, count(*) AS n, coalesce(list_sum(list_transform(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'), lambda x: length(x))), 0) AS c FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM doc) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY ALL)",
        "dup AS (SELECT rid, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines, CAST(sum((n - 1) * c) AS BIGINT) AS dup_line_chars FROM line GROUP BY rid)",
    ]
    for n in sizes:
        steps.append(f"g{n} AS (SELECT rid, k, row_number() OVER (PARTITION BY rid, g ORDER BY k) AS nth, count(*) OVER (PARTITION BY rid, g) AS times FROM (SELECT rid, k, array_to_string(w[k:k + {n - 1}], ' ') AS g FROM doc, unnest(range(1, len(w) - {n - 2})) t(k)))")
        which = "times > 1" if n == 3 else "nth > 1"
        steps.append(f"c{n} AS (SELECT x.rid, count(*) AS n, CAST(sum(c) AS BIGINT) AS c FROM (SELECT DISTINCT rid, p FROM g{n}, unnest(range(k, k + {n})) t(p) WHERE {which}) x JOIN word USING (rid, p) GROUP BY x.rid)")
    joins = " ".join(f"LEFT JOIN c{n} USING (rid)" for n in sizes)
    limits = " AND ".join([f"dup_line_chars <= {LINE_LIMIT}::DOUBLE * word_chars", *(f"dup_chars_{n} <= {most}::DOUBLE * word_chars" for n, most in NGRAM_LIMITS.items())])
    dups = ", ".join(f"coalesce(c{n}.c, 0) AS dup_chars_{n}" for n in NGRAM_LIMITS)
    steps.append(f"""m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c3.n, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {dups} FROM doc LEFT JOIN dup USING (rid) {joins})""")
    steps.append("f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)")
    return f"WITH {', '.join(steps)} SELECT *, NOT base_failed AND {limits} AS kept FROM f"


OP5 = r"""
WITH doc AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) AS name,
    CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
thin AS (SELECT source, name, CAST(sum(size) AS BIGINT) AS size FROM doc GROUP BY source, name),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w
  FROM thin GROUP BY source),
cap AS (SELECT *, CAST(source_size AS DOUBLE) * 2 AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget FROM src),
lev AS (
  SELECT *, (budget - coalesce(sum(cap) OVER f, 0.0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0.0::DOUBLE)) AS lv
  FROM cap WINDOW f AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, budget, least(cap, coalesce(w * (SELECT max(lv) FROM lev WHERE lv * w <= cap), cap)) AS target FROM lev),
line AS (
  SELECT t.source, t.name, t.size, e.epoch, md5(t.name || ':' || e.epoch || ':17') AS place, g.target, g.budget
  FROM thin t JOIN goal g ON t.source IS NOT DISTINCT FROM g.source, (VALUES (1), (2)) e(epoch) WHERE t.size > 0 AND g.target > 0),
fin AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY epoch, place, name ROWS UNBOUNDED PRECEDING) AS DOUBLE) / target AS finish FROM line),
tot AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, epoch, place, name ROWS UNBOUNDED PRECEDING) AS total FROM fin),
took AS (SELECT source, name, count(*) AS repeats FROM tot WHERE total <= budget GROUP BY source, name)
SELECT d.doc_id, d.size, g.source_size, g.target, CAST(d.size * coalesce(k.repeats, 0) AS BIGINT) AS taken
FROM doc d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN took k ON d.source IS NOT DISTINCT FROM k.source AND d.name = k.name
"""

OP6 = r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS phrase, least(len(w), 10) AS n
        FROM item, unnest(range(1, greatest(2, len(w) - 8))) t(k) WHERE len(w) > 0),
doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS phrase FROM doc, sizes, unnest(range(1, len(w) - n + 2)) t(k)),
hit AS (SELECT a.rid, a.k, a.n, v.item_id FROM spot a JOIN win v ON a.phrase = v.phrase AND a.n = v.n),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + n)) t(p) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c USING (rid) LEFT JOIN found f USING (rid)
"""

OP11 = r"""
WITH doc AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM doc),
one AS (SELECT row_number() OVER () AS r, * FROM doc),
word AS (SELECT lang, source, t, r, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS t FROM one) GROUP BY ALL),
kept AS (SELECT lang, t, CAST(sum(n) AS BIGINT) AS n FROM word GROUP BY lang, t HAVING count(*) >= 10),
cnt AS (SELECT lang, source, t, CAST(sum(n) AS BIGINT) AS n FROM word JOIN (SELECT lang, t FROM kept) USING (lang, t) GROUP BY ALL),
size AS (SELECT lang, CAST(count(*) AS BIGINT) AS v, CAST(sum(n) AS BIGINT) AS n FROM kept GROUP BY lang),
tot AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM cnt GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(o.n, 0) + 2 * s.v) AS p, 1 + 1000000000 * (k.n + 2) // (s.n + 2 * s.v) AS q
      FROM grp g JOIN kept k ON g.lang = k.lang JOIN size s ON s.lang = g.lang LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t LEFT JOIN tot o ON o.lang = g.lang AND o.source = g.source),
pair AS (SELECT x.lang, x.source, y.source AS item, CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL),
every AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(v.value, 0) AS value FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair v ON v.lang = x.lang AND v.source = x.source AND v.item = y.source),
term AS (SELECT lang, source, 'term' AS part, t AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP12 = """
WITH RECURSIVE vec AS (
  SELECT vec_id, v FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
  WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vec a JOIN vec b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(x, y) AS (SELECT a, b FROM link UNION SELECT r.x, l.b FROM reach r JOIN link l ON r.y = l.a),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
n AS (SELECT a, CAST(count(*) AS BIGINT) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(l.y, e.vec_id)) AS component_id, coalesce(e.vec_id <= l.y, true) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least_of l ON l.x = e.vec_id
"""

OP13 = r"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
same AS (SELECT text, min(doc_id) AS least FROM doc GROUP BY text),
bad AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(d.text, '[A-Z]')) > 3 * length(d.text), regexp_matches(d.text, '[#$%&*|]'), coalesce(d.doc_id > s.least, false)] AS f
  FROM doc d JOIN same s ON d.text = s.text LEFT JOIN lab l ON d.doc_id = l.doc_id),
mask AS (SELECT part, f, CAST(count(*) AS BIGINT) AS n, CAST(sum(good) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic FROM bad GROUP BY part, f),
perm(o) AS (SELECT '' UNION ALL SELECT o || x FROM perm, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(x) WHERE NOT contains(o, x)),
place AS (SELECT o AS filter_order, k AS step, CAST(ascii(o[k]) - 64 AS INT) AS x FROM perm, unnest(range(1, 6)) t(k) WHERE length(o) = 5),
went AS (SELECT m.*, p.filter_order, list_min(list_filter([1, 2, 3, 4, 5], lambda k: m.f[ascii(p.filter_order[k]) - 64])) AS gone FROM mask m, (SELECT DISTINCT filter_order FROM place) p),
step AS (
  SELECT w.part, p.filter_order, p.step, p.x, CAST(sum(CASE WHEN coalesce(gone, 9) > p.step THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN gone = p.step THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN f[p.x] AND gone < p.step THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN f[p.x] AND len(list_filter(f, lambda y: y)) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN gone = p.step THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN gone = p.step THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM went w JOIN place p USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM step
"""

ORACLES = {"op2_jaccard": OP2, "op4_url_filters": OP4, "op5_mixing": OP5, "op6_decontamination": OP6, "op9_quality": _quality(), "op11_divergence": OP11, "op12_embedding_dedup": OP12, "op13_filter_audit": OP13}
