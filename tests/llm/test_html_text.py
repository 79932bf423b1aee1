import html
import re

import pytest

from kerege.llm import html_text

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


@pytest.fixture(scope="module")
def tree():
    return html_text.grown()


def test_the_tree_agrees_with_its_table(tree):
    x, y = html_text.labelled()
    assert (tree.predict(x) == (y > 0.5)).all()


def used(tree):
    return set() if tree.feature is None else {html_text.FEATURES[tree.feature]} | used(tree.low) | used(tree.high)


def test_the_tree_looks_at_neighbours(tree):
    assert {"words", "links", "links_before", "words_after", "links_after"} <= used(tree) and html_text.FEATURES[tree.feature] in html_text.FEATURES[:6]


def test_unclosed_links_end_with_their_block(tree):
    long = "This is a longer paragraph of running text that tells the reader what has happened in the town on that day."
    found = html_text.blocks(f"<p><a href='x'>Read more<p>{long}</p><div><a>here</div><p>{long}</p><a href='y'><div>card</div></a>")
    assert [(b[1], b[2]) for b in found] == [(2, 2), (21, 0), (1, 1), (21, 0), (1, 1)]


def test_page_that_ends_with_its_text(tree):
    long = "This is a longer paragraph of running text that tells the reader what has happened in the town on that day."
    assert html_text.extract(f"<article><h1>News of it</h1><p>{long}</p><p>{long}</p></article>", tree) == f"News of it\n\n{long}\n\n{long}"
    assert html_text.extract(f"<p>{long}</p>", tree) == long


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header class="site-header"><a href="/">Home</a> The daily site of things that happen</header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="cookie-notice">We use cookies on this site to make it work for you.</div>
<div class="ad">Buy this now at a very low price, today only.</div><!-- <p>gone</p> -->
<article><header><h1>A headline of it</h1></header><p><b>First paragraph &amp; more\n of  <a href="x">it</a> here.<br><p>Second &lt;one&gt;.</p>
<div class="ad">Buy that too.</div><p>A.</p><aside>Read this other thing that we wrote last week as well.</aside><form><p>Your mail address please</p></form></article>
<section id="comments"><p>I think that this article is a very good one and I would read it again.</p></section>
<div class="sidebar"><p>Some other words that stand at the side of the page as always.</p></div>
<footer>&copy; site &middot; words of the footer that nobody reads</footer></body>"""


def test_page(tree):
    assert html_text.extract(PAGE, tree) == "A headline of it\n\nFirst paragraph & more of it here.\n\nSecond <one>.\n\nA."


@pytest.mark.parametrize("named", [True, False])
@pytest.mark.parametrize("share", [0.1, 0.16, 0.2, 0.3, 0.4, 0.5, 0.6])
def test_paragraphs_with_links_are_kept(tree, share, named):
    """Whatever their length, first, between others and last in the text, in an article and in plain boxes."""
    menu = "<div>" + "".join(f'<p><a href="{k}">Menu{k}</a></p>' for k in range(4)) + "</div>"
    plain = " ".join(f"plain{k}" for k in range(35))
    for n in (5, 7, 10, 13, 20, 40, 80, 120, 200):
        linked = max(1, round(n * share))
        words = [f"w{k}" for k in range(n)]
        inner = f'{" ".join(words[: n - linked])} <a href="x">{" ".join(words[n - linked :])}</a>'
        for order in (["L", "P", "P"], ["P", "L", "P"], ["P", "P", "L"], ["P", "L", "L", "P"]):
            body = "".join(f"<p>{inner if x == 'L' else plain}</p>" for x in order)
            page = f"<body>{menu}{'<article>' if named else '<div>'}<h1>Some headline of six words here</h1>{body}{'</article>' if named else '</div>'}<footer>words of the foot of this page</footer></body>"
            want = ["Some headline of six words here", *(" ".join(words) if x == "L" else plain for x in order)]
            got = html_text.extract(page, tree).split("\n\n")
            assert got == want or (not named and n < 10 and set(want) - set(got) <= {" ".join(words)}), (n, share, order)


def test_page_without_article(tree):
    long = "This is a longer paragraph of running text that tells the reader what has happened in the town on that day, and why it matters to all."
    page = f'<body><div><a href="1">One</a> <a href="2">Two</a></div><div><p>{long}</p><p>{long} Again.</p><p>{long}</p></div><div><a href="3">Three</a></div>'
    assert html_text.extract(page, tree) == f"{long}\n\n{long} Again.\n\n{long}"


@pytest.mark.parametrize("page", ["", None, "   ", "<", "<p", "<!-- open", "<script>x", "<article>", "&", "<a href='x>y", "</p></div>", "<" * 50000, "<div>" * 20000, "<p a=\"" * 3000])
def test_odd_pages(tree, page):
    html_text.extract(page, tree)


def test_rows(spark):
    rows = [(1, None, None, "x", "y"), (1, "u", PAGE, None, None), (None, "u", "", "x", "y"), (2, "u", "<article><p>" + "word " * 200000 + "</p></article>", "x", "y")]
    got = {(r.page_id, r.url): r for r in html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, None].text == "" and got[1, None].n_chars == 0 and got[None, "u"].text == ""
    assert got[1, "u"].n_chars == len(got[1, "u"].text) and got[2, "u"].n_chars == 200000 * 5 - 1
    assert html_text.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def main_texts(page):
    """In these pages the text is what the article element encloses."""
    article = re.search("<article>(.*)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", " " if x.startswith("<br") else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article.replace("<br>", " ").replace("<b>", ""))]
    return [p for p in parts if p]


def test_query_gives_the_articles(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html_text.op8_text_blocks(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == "\n\n".join(main_texts(pages[r.page_id]))


def test_pages_without_an_article_element_or_named_containers(spark, sf, tree):
    wanted = kept = more = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        bare = r.html
        for name in ("article", "nav", "footer"):
            bare = bare.replace(f"<{name}>", "<div>").replace(f"</{name}>", "</div>")
        found = html_text.extract(bare.replace(' class="ad"', ""), tree).split("\n\n")
        want = main_texts(r.html)
        wanted, kept, more = wanted + len(set(want)), kept + len(set(want) & set(found)), more + len(set(found) - set(want))
    assert kept >= 0.95 * wanted and more < 0.02 * wanted, (kept, more, wanted)
