"""Main text of pages: parsing, tree matching against all mappings, wrappers, copies and odd tables."""

import itertools
import random

from lexloom.llm import extraction
from lexloom.llm.extraction import main_text


def test_what_stays_and_what_goes():
    page = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style><script>if (a<b) "</p>";</script></head><body class="has-sidebar">
    <!-- <p>not this</p> --><header><h1>Site name</h1><nav><a href=/>Home</a></nav></header>
    <div class="cookie-notice">We use cookies</div><main><article><header class="entry-header"><h1>The <em>title</em></h1></header>
    <p>One&nbsp;two &lt;three&gt; &#8211; caf&eacute; &amp four<br>five<p><b>Six</b>seven <span class="ad">buy</span>
    <div class="advert-box"><p>Buy now</p></div><table><tr><td>a<td>b<tr><th>c</table>
    <ul><li>x<li>y</ul><pre> z
    z </pre><form><p>Your mail</p><button>Go</button></form><aside>Aside</aside><p hidden>no</p><noscript>js</noscript>tail</article></main>
    <section id="comments"><article class="comment"><p>A reader says a very long thing, longer than all of the article.</p></article></section>
    <div class="sideBar">Side</div><footer>&copy; 2024</footer></body></html>"""
    assert main_text(page).split("\n") == ["The title", "One two <three> \N{EN DASH} caf\N{LATIN SMALL LETTER E WITH ACUTE} & four five", "Sixseven", "a", "b", "c", "x", "y", "z z", "tail"]


def test_pages_without_an_article_element():
    assert main_text("<div id=nav><a href=/>Home</a></div><div id='content'><h2>Head</h2><p>Body text</p></div><div class=widget>w</div>") == "Head\nBody text"
    assert main_text("<p>plain <a href=x>link</a> text</p><p><a href=y>only a link</a></p><p>\N{COPYRIGHT SIGN} owner") == "plain link text"
    assert main_text("<form><div class=sidebar>s</div><main><p>kept in a form</p></main></form>") == "kept in a form"
    assert main_text("<div class='page-sidebar'><article><p>whole page in an odd wrapper</p></article></div>") == "whole page in an odd wrapper"
    assert main_text("no tags < at all & more") == "no tags < at all & more"


def test_broken_pages():
    for cut in ("<p", "<p class='x", '<a href="', "<!-- open", "<script>var x = 1", "</art", "<style", "<![CDATA[ x"):
        assert main_text(f"<article><p>kept</p>{cut}") == "kept", cut
    assert main_text("") == "" and main_text("<article></article>") == ""
    assert main_text("<article>" + "<div>" * 20_000 + "deep" + "</div>" * 20_000 + "<p>after") == "deep\nafter"
    many = "<article>" + "".join(f"<p>line {i}</p>" for i in range(30_000)) + "</article>"
    assert main_text(many).count("\n") == 29_999
    assert main_text("<a '" * 50_000) == "" and main_text("<!--" * 50_000) == "" and main_text("<p>" * 50_000) == ""
    assert main_text('<article><p title="a > b">attribute</p></article>') == "attribute"


def random_tree(draw, depth):
    return [draw.choice("abc"), 1, [random_tree(draw, depth - 1) for _ in range(draw.randint(0, 3 if depth else 0))]]


def all_mappings(a, b):
    """The largest ordered mapping below two equal roots, over all choices of children."""
    best = 0
    for k in range(1, min(len(a), len(b)) + 1):
        for xs in itertools.combinations(a, k):
            for ys in itertools.combinations(b, k):
                if all(x[0] == y[0] for x, y in zip(xs, ys, strict=True)):
                    best = max(best, sum(1 + all_mappings(x[2], y[2]) for x, y in zip(xs, ys, strict=True)))
    return best


def test_tree_matching_equals_all_mappings():
    draw = random.Random(4)
    for _ in range(300):
        a, b = random_tree(draw, 2)[2], random_tree(draw, 2)[2]
        size, pairs = extraction._matched(a, b)
        assert size == all_mappings(a, b) and pairs == sorted(pairs)
        assert all(a[i][0] == b[j][0] for i, j in pairs) and len({i for i, _ in pairs}) == len(pairs)


def test_merged_trees_hold_both():
    draw = random.Random(9)
    for _ in range(100):
        a, b = (["r", 1, random_tree(draw, 2)[2]] for _ in "ab")
        whole = extraction.merged(a, b)
        for tree in (a, b):
            slots = extraction.slots(whole, tree)
            assert slots[0] == 0 and -1 not in slots and len(set(slots)) == len(slots)


def host_pages(host, n, same_article=False):
    rows = []
    for i in range(n):
        article = "".join(f"<p>{host} {0 if same_article else i} paragraph {k} says w{(0 if same_article else i) * 7 + k}.</p>" for k in range(1 + i % 4))
        optional = "<div><p>An optional part</p></div>" if i % 2 else ""
        rows.append((i, f"https://u@{host.upper()}:80/p{i}", f"<div><div>Welcome to {host}</div>{optional}<div class=text{i}>{article}<p>Share this page</p></div><div>All about {host}</div></div>"))
    return rows


def test_wrappers_find_what_is_constant(spark):
    rows = [*host_pages("many.example", 90), *((500 + i, u, h) for i, u, h in host_pages("few.example", 3))]
    copies = [(700 + i, f"https://copy.example/{i}", host_pages("c", 1)[0][2]) for i in range(6)]
    table = spark.createDataFrame([*rows, *copies], "page_id long, url string, html string").repartition(5)
    out = {r["page_id"]: r["text"] for r in extraction.extract(table).collect()}
    for i, _, _ in rows[:90]:
        expected = [f"many.example {i} paragraph {k} says w{i * 7 + k}." for k in range(1 + i % 4)]
        assert out[i].split("\n") == (["An optional part"] if i % 2 else []) + expected
    assert out[500].split("\n")[0] == "Welcome to few.example"  # too few pages to tell
    assert "says w0." in out[700] and "Welcome" in out[700]  # copies of one page are one page


def test_wrappers_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(extraction, "GROUP", 4)
    monkeypatch.setattr(extraction, "BROADCAST_BYTES", -1)
    shapes = [(i, "http://h.example/", "<div>Same head</div>" + "<ol></ol><ul></ul>" * (i % 13) + "<h5></h5>" * (i % 2) + f"<p>own text {i}</p><div><dl></dl></div>") for i in range(120)]
    out = extraction.extract(spark.createDataFrame(shapes, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == {i: f"own text {i}" for i in range(120)}


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, TEXT string, host string, _host string, tree string, template string"
    assert extraction.extract(spark.createDataFrame([], schema)).collect() == []
    x = ("t", "h", "x", "y", "z")
    rows = [(1, None, "<p>a</p>", *x), (1, None, "<p>a</p>", *x), (None, "http://x/", None, *x), (3, "no url", "", *x), (4, "http://x/", "<article>" + "long text " * 200_000 + "</article>", *x)]
    out = extraction.extract(spark.createDataFrame(rows, schema))
    assert [c.lower() for c in out.columns].count("text") == 1 and {"host", "_host", "tree", "template"} <= set(out.columns)
    assert sorted((r["page_id"] or 0, len(r["text"]), r["host"]) for r in out.collect()) == [(0, 0, "h"), (1, 1, "h"), (1, 1, "h"), (3, 0, "h"), (4, 1_999_999, "h")]
