import random
from collections import defaultdict

from wardlight.llm import html_extract


def deep(name, text, side):
    return f"<body><div class=w-{name}><div class=v-{name}><section class=u-{name}><div class=t-{name}><p>{text}</p></div></section></div></div><div class=extra><p>{side}</p></div></body>"


def test_every_template_of_a_host_finds_its_article(spark):
    rows, want = [], {}
    letters = "abcdefghijklmnopqrstuvwxyz"
    for t in range(24):
        for i in range(1 + 40 // (t + 1)):
            text = f"article {letters[t]} {i} " + "long words of it " * 30
            rows.append((len(rows), f"https://hot.test/{t}/{i}", deep(letters[t], text, "short remark beside")))
            want[len(rows) - 1] = text.strip()
    for i in range(26):  # class names made anew for each page, and one block in a frequent path
        text = "generated " + letters[i] + " long words of it" * 30
        rows.append((len(rows), f"https://hot.test/g/{i}", f"<body><div class=w-a><p>stray</p></div><div class=zz{letters[i] * 3}><p>{text}</p></div></body>"))
        want[len(rows) - 1] = text
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_pages_of_a_host_settle_on_one_path(spark):
    page = "<body><article class=post><p>{}</p></article><div class=box><p>{}</p></div></body>"
    rows = [(i, f"https://o.test/{i}", page.format("words of the article " * 20, "short")) for i in range(10)]
    rows.append((10, "https://o.test/10", page.format("words of the article " * 20, "a long remark in a box " * 22)))
    rows.append((11, "https://o.test/11", "<body><article class=post><a href=/>all linked</a></article></body>"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == ("words of the article " * 20).strip() for i in range(11)) and got[11] == "all linked"


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, f"https://t{i}.test/", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html_extract.extract_pages(df).orderBy("page_id").collect()]


def test_pages_against_their_known_articles(spark):
    pages = {
        "<head><title>T</title><p>Text one</p><p>Text two": "Text one\nText two",
        "<html><head><meta charset=x><style>p{}</style><body><p>In body</p></body>": "In body",
        "<body><div id=main><section class='share-prices'><p>Prices went up by a lot today in all of the markets.</p></section></div><nav>menu</nav></body>": "Prices went up by a lot today in all of the markets.",
        "<article><p>First words of it.</p><p class=related>Related work is part of this text.</p><p class=ad>Buy now</p></article>": "First words of it.\nRelated work is part of this text.",
        "<article><header><h1>Title of it</h1><p>by line</p></header><p>Body of the text.</p></article><header><h1>Site</h1></header>": "Title of it\nBody of the text.",
        "<article><p>One</p><div class='share-box'>Tweet</div><div class='comment-list'><p>nice!</p></div><div class='top bar'>x</div></article>": "One\nx",
        "<main><div class=part1><p>Half of the text.</p></div><div class=part2><p>Other half of it.</p></div></main><aside>no</aside>": "Half of the text.\nOther half of it.",
        "<p>a &lt;b&gt; &amp;amp; &#x41;&#66; &nbsp; c\n\td</p><script>no</script><!-- no --><textarea>no</textarea>": "a <b> &amp; AB c d",
        "<body><table><tr><td>x<td>y</table><ul><li>1<li>2</ul></body>": "x\ny\n1\n2",
        "": "", "   ": "", "<div>": "", "plain": "plain",
    }
    assert texts_of(spark, list(pages)) == list(pages.values())


def test_long_pages_and_clashing_names(spark):
    long = "<article>" + "<p>some words here</p>" * 40_000 + "</article>"
    df = spark.createDataFrame([(1, "https://l.test/", long, 4, "k", 9)], "page_id long, url string, html string, _mine int, chosen string, mine int")
    r = html_extract.extract_pages(df).first()
    assert r["text"].count("\n") == 39_999 and (r["_mine"], r["chosen"], r["mine"]) == (4, "k", 9)


def test_what_stands_in_scripts_and_other_raw_elements_opens_nothing(spark):
    pages = {
        "<script>for(var i=0;i<n;i++){x()}</script><article><p>The article.</p></article>": "The article.",
        "<article><p>One.</p><script>if(a<b){c()}</script><p>Two.</p></article>": "One.\nTwo.",
        "<script>var s='<!-- ';</script><p>Shown.</p>": "Shown.",
        "<p>A</p><textarea>x <b y</textarea><p>B</p>": "A\nB",
        "<p>A</p><SCRIPT>a</b</Script ><p>B</p><style>p>b{}</STYLE\n><p>C</p>": "A\nB\nC",
        "<script>var t='</p>'; if (x<y) z('</scripts>');</script><p>Rest</p>": "Rest",
        "<title>never closed <p>A</p>": "never closed\nA",
        "<p>A</p><script>never closed <p>B</p>": "A",
        "<p>if a <b and b> c then 5 <a 6 or more</p><p>next</p>": "if a c then 5 <a 6 or more\nnext",
        "<p>1 < 2 <3 and x<y</p>": "1 < 2 <3 and x<y",
    }
    assert texts_of(spark, list(pages)) == list(pages.values())


def test_hidden_elements_end_with_what_is_around_them(spark):
    pages = {
        "<datalist><option value=a><option value=b></datalist><article><p>Text.</p></article>": "Text.",
        "<p>A <select><option>x<option>y</select> B</p>": "A B",
        "<article><div><p>A <select><option>x<option>y</p></div><p>B</p></article>": "A\nB",
        "<article><template><div><p>no</p></div></template><p>yes</p></article>": "yes",
        "<p>A<svg viewBox='0 0 1 1'><title>t</title><text>no</text></svg>B</p><p>C<svg/>D</p>": "AB\nCD",
        "<object data=x><object data=y><p>no</p></object><p>no</p></object><p>yes</p>": "yes",
        "<math><mi>x</mi></math><p>yes</p>": "yes",
    }
    assert texts_of(spark, list(pages)) == list(pages.values())


def test_reader_comments_and_notices_go(spark):
    text = "<p>" + "Words of the article itself. " * 10 + "</p>"
    names = ["div class=reader-comments", "div class='user-comment-thread'", "section id=post-comments-list", "p class=notice", "div class=cookie-consent", "div class='gdpr-cookie-policy'", "div class=reply", "li class=comment", "div id=disqus_thread"]
    pages = [f"<article>{text}<{n}>Unwanted words here.</{n.split()[0]}></article>" for n in names]
    kept = ["div class=comments-open", "div class='commentary'", "div class=cookie-recipes", "div class='no-comments'"]
    pages += [f"<article>{text}<{n}><p>Wanted words here.</p></div></article>" for n in kept]
    article = ("Words of the article itself. " * 10).strip()
    assert texts_of(spark, pages) == [article] * len(names) + [article + "\nWanted words here."] * len(kept)


def test_consensus_equals_a_plain_count_of_votes(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choices(["plain", "words", "of", "many", "pages"], k=n))
    rows = []
    for i in range(120):
        boxes = [f"<div class={rng.choice('abcd')}{rng.choice(['', ' x1', ' x2'])}><p>{words(rng.randrange(1, 40))}</p><section><p>{words(rng.randrange(1, 60))}</p></section></div>" for _ in range(rng.randrange(1, 5))]
        url = rng.choice([f"https://h{rng.randrange(3)}.test/{i}", None, "no host"])
        rows.append((i, url, None if i % 40 == 7 else rng.choice(["<body>{}", "<body><main>{}</main>", "<article>{}</article>"]).format("".join(boxes))))
    rows += rows[:5]
    hosts = [(u.split("/")[2] if u and "://" in u else "") for _, u, _ in rows]
    ballots = [dict(html_extract.votes(p or "")) for *_, p in rows]
    shares = defaultdict(list)
    for h, b in zip(hosts, ballots, strict=True):
        for path, score in b.items():
            if max(b.values()) > 0:
                shares[h, path].append((score, max(b.values())))
    support = {k: (len(v) * (sum(s for s, _ in v) / sum(m for _, m in v) if sum(m for _, m in v) else html_extract.PRIOR) + html_extract.PRIOR) / (len(v) + 1) for k, v in shares.items()}
    want = {}
    for (i, _, page), h, b in zip(rows, hosts, ballots, strict=True):
        fit = [(support.get((h, p), 0.0), -len(p), html_extract.path_key(h, p)) for p, s in b.items() if s >= html_extract.COVER * max(b.values())]
        want[i] = html_extract.extract(page or "", h, max(fit)[2] if fit else None)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract_pages(df).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and len(got) == 125
    assert html_extract.extract_pages(df.limit(0)).count() == 0
