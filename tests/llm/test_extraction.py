import html
import math
import re
from collections import Counter, defaultdict

import pytest
from helpers import D, words

from fedseek.llm.common import stored
from fedseek.llm.extraction import DECAY, READ, _read, extracted, importance, op12_html_extraction, read

PAGES = "page_id long, url string, html string"


def ours(spark, rows, **how):
    return {r.page_id: r for r in extracted(spark.createDataFrame(rows, PAGES).repartition(3), **how).collect()}


def blocks(page):
    return [t for t, _ in read(page)[0]]


def test_articles_of_the_table_by_a_pattern(spark):
    """These pages have one article element of headings and paragraphs, so a pattern finds the same."""
    got = {r.page_id: r for r in op12_html_extraction(spark, D).collect()}
    pages = spark.read.parquet(f"{D}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        text = "\n\n".join(x for x in want if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (text, len(text), p.url)
        assert text


FULL = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">
<div id="cookie-banner">We use cookies</div><header class="site-header"><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav>
<div class="container"><aside>Side</aside><div class="ad-slot">Buy</div>
<main><article class="post has-sidebar"><header class="entry-header"><h1>The   headline</h1></header>
<p>First &lt;b&gt; para&shy;graph &#233;&nbsp;x <b>bold</b>, <i>it<b>al</i>ic</b>.<br>After<br/>break
<p>Second <a href="#">link</a> 1 < 2 && 3 &copy 4 &amp;amp; &unknown;<ul><li>a<li>b <em>c</em></ul>
<table><tr><td>x<td>y</table><blockquote>Quoted<p>deep</blockquote><div class="share-buttons">Share</div><form><label>Name</label><input value=q></form>
<!-- <p>comment</p> --><div class="notice">Notice</div><figure><img alt=no><figcaption>Figure</figcaption></figure>
</article><section id="comments"><h2>Comments</h2><article class="comment">Great!</article></section></main></div>
<footer>&copy; site</footer><script>tail()"""


def test_what_a_page_has_besides_its_text():
    assert blocks(FULL) == [
        "The headline", "First <b> para­graph é x bold, italic. After break", "Second link 1 < 2 && 3 © 4 &amp; &unknown;", "a", "b c", "x", "y", "Quoted", "deep", "Figure",
    ]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []), ("", []), ("plain  text", ["plain text"]), ("<p>a<p>b</p>c", ["a", "b", "c"]), ("<article>", []), ("<article><p>cut &am", ["cut &am"]),
        ("<main><h1>H</h1>x<article><p>a</article></main>y", ["H", "a"]), ("<div role=main>m</div><p>n", ["m"]), ("<article>a</article><article>b</article>c", ["a", "b"]),
        ("<body><nav>n<div>m</div></nav><p>t</p><footer>f", ["t"]), ("<div class='main-menu'>m</div><div class='no-menu'>t</div>", ["t"]), ("</p></div>t<p", ["t"]),
        ("<nav><p>a</nav>b", ["b"]), ("<p hidden>h<p>t", ["t"]), ("<article><div><p>a<div><p>b</article>", ["a", "b"]), ("<article>a<nav>b</article>c", ["a"]), ("<script>x", []), ("a<!-- x <p>b", ["a"]), ("a<!-->b<!--x--!>c<!-- <p> -->d", ["abcd"]), ("<script>s='<!--'</script>a", ["a"]),
        ("<article><svg><title>s</title></svg>t</article>", ["t"]), ("<DIV ID=Sidebar>s</DIV><P CLASS='Lead'>t", ["t"]), ("a&#0;b&#x1F600;", ["a�b\U0001f600"]),
    ],
)
def test_broken_and_small_pages(page, want):
    assert blocks(page) == want


def site(i, own, active=0):
    """A page without a main element: a strip and a box that all pages share, a list that changes a little, and its own text."""
    links = "".join(f"<li class='{'on' if j == active else 'off'}'>Go {j}</li>" for j in range(6))
    return f"<div class=strip>Welcome to the site</div><div class=links><ul>{links}</ul></div><div class=box><p>Same box</p><p>Same line</p></div><div class=body><p>{own}</p><p>More of {i} {own[:9]}</p></div><p>Loose</p>"


def test_style_tree_removes_what_pages_share(spark):
    rows = [(i, f"http://one.example/{i}", site(i, words(20, i), i % 6)) for i in range(40)]
    rows += [(100 + i, f"http://small.example/{i}", site(i, words(20, 50 + i))) for i in range(3)]
    got = ours(spark, rows)
    for i in range(40):
        assert got[i].text == f"{words(20, i)}\n\nMore of {i} {words(20, i)[:9]}"
    # three pages are no evidence, so nothing but names counts
    assert got[100].text.startswith("Welcome to the site\n\nGo 0") and got[100].text.endswith("Loose")


def test_importance_by_plain_sums(spark):
    rows = [(i, f"http://Host{i % 2}.example:80/{i}", site(i, words(5, i % 9), i % 3)) for i in range(30)] + [(99, "http://host0.example/x", site(0, words(5, 0)))] * 3
    pages = spark.createDataFrame(rows, PAGES).selectExpr("page_id", "url", "html", "xxhash64(page_id, url, html) as k")
    branch, block = importance(stored(pages.mapInArrow(_read, READ)))
    seen, once = defaultdict(Counter), set()
    for i, _, page in rows:
        at = f"host{i % 2 if i != 99 else 0}.example"
        found, shown = read(page)
        if (at, "\n\n".join(t for t, _ in found)) not in once:
            once.add((at, "\n\n".join(t for t, _ in found)))
            for node, kind, variant in shown:
                seen[at, node, kind][variant] += 1
    want, of_blocks = {}, []
    for at, node, kind in list(seen):
        if kind:
            continue
        styles, texts = seen[at, node, 0], seen[at, node, 1]
        m = sum(styles.values())
        own = lambda n, m=m: math.log(n) / math.log(m)
        entropy = -sum(n / m * math.log(n / m) / math.log(m) for n in styles.values())
        content = 1 - sum(n * own(n) for n in texts.values()) / sum(texts.values())
        want[at, node] = (1 - DECAY ** len(styles)) * entropy + DECAY ** len(styles) * content
        of_blocks += [(at, v, round(1 - own(n), 6)) for v, n in texts.items()]
    got = {(r.host, r.node): r.importance for r in branch.collect()}
    assert got.keys() == want.keys() and len(got) > 8
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert sorted(set(of_blocks)) == sorted({(r.host, r.node, round(r.importance, 6)) for r in block.collect()})


def test_copies_of_an_article_stay(spark):
    """A hot host with as many copies of one article as other pages, exact and nearly so; a branch in the article that all pages share goes."""
    text = [f"<p>{words(30, j)}</p>" for j in range(4)]
    page = lambda body, n: f"<nav>n{n % 3}</nav><article><h1>Title</h1>{body}<div class=k>Sign up here</div></article><footer>{n}</footer>"
    rows = [(i, f"http://hot.example/{i}", page("".join(text), i)) for i in range(20)]
    rows += [(20 + i, f"http://hot.example/{i}", page("".join(text[:3]) + f"<p>{words(30, 100 + i)}</p>", i)) for i in range(20)]
    rows += [(40 + i, f"http://hot.example/{i}", page(f"<p>{words(30, 200 + i)}</p>", i)) for i in range(20)]
    got = ours(spark, rows)
    for i in range(60):
        assert "Sign up" not in got[i].text
        assert got[i].text.startswith("Title\n\n") and got[i].text.count("\n\n") == (4 if i < 40 else 1)


def test_hard_rows(spark):
    """Nulls in every column, repeated rows, extra columns with clashing names, a page of ten thousand blocks, one of deep nesting, no rows."""
    long, deep = "<article>" + "<p>x &amp; y</p>" * 10_000, "<article>" + "<b>" * 3000 + "<div>" * 1000 + "t"
    rows = [(None, "http://a.example/", "<article>n</article>"), (1, None, "<div class=q>one</div>"), (2, "not a url", "two"), (3, "http://a.example", None), (None, None, None)]
    rows += [(4, "http://a.example/4", "<article><p>same</article>")] * 9 + [(5, "http://a.example/5", long), (6, "http://a.example/6", deep), (4, "http://a.example/4", "<article>other</article>")]
    pages = spark.createDataFrame([(*r, 1, "h", "t") for r in rows], PAGES + ", k long, host string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extracted(pages).collect()), key=repr)
    texts = ["n", "one", "two", "", "", *["same"] * 9, "\n\n".join(["x & y"] * 10_000), "t", "other"]
    assert got == sorted(((i, u, t, len(t)) for (i, u, _), t in zip(rows, texts, strict=True)), key=repr)
    assert extracted(pages.limit(0)).collect() == []
