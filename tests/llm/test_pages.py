import random
import re
import time

import duckdb
import numpy as np
import pytest

from tidemark.llm import pages as P


def plain(markup):
    """The article of the test data's pages, cut by hand."""
    article = re.search(r"<article>(.*)</article>", markup, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", article.replace("<br>", " ").replace("<b>", "").replace("</b>", ""))
    names = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#x27;": "'", "&#39;": "'", "&amp;": "&"}
    out = []
    for part in parts:
        part = re.sub("|".join(names), lambda m: names[m[0]], part)
        if part.split():
            out.append(" ".join(part.split()))
    return "\n\n".join(out)


def test_articles_of_the_test_data(spark, small):
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{small}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in P.main_text(spark.read.parquet(f"{small}/pages.parquet")).collect()}
    assert len(got) == len(rows)
    for page_id, url, markup in rows:
        assert got[page_id]["text"] == plain(markup)
        assert (got[page_id]["url"], got[page_id]["n_chars"]) == (url, len(plain(markup)))


def test_zones_and_references():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar">
      <header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav>
      <div class="cookie-notice">We use cookies</div>
      <main><article><header><h1>Title &amp; more</h1></header><p>One&nbsp;two<br>three <b>fo</b>ur &copy; &#65; &nope;
      <p>a &lt;b&gt; c</p><script>if (a < b) "</p>"</script><form>Mail <input></form>
      <aside>Read also</aside><ul><li>x<li>y</ul><table><tr><td>1</td><td>2</td></tr></table>
      <section id="comments"><p>First!</p></section></article></main>
      <div title="a>b" class='ad'>Buy</div><footer>(c)</footer><!-- <p>gone</p> --></body></html>"""
    text = [t for z, t in P.blocks(page) if z == P.ARTICLE]
    assert text == ["Title & more", "One two three four © A &nope;", "a <b> c", "x", "y", "1 2"]


def site(r, i, host):
    words = lambda n: " ".join(f"w{r.randint(0, 99999)}" for _ in range(n))
    own = [words(r.randint(8, 40)) for _ in range(3)]
    menu = f"Start About {host} Contact Imprint Press"
    page = f"<div>{menu}</div><div><p>{own[0]}</p><p>{own[1]}</p></div><p>{own[2]}</p><div>All rights reserved by {host}</div>"
    return page, own


def test_boilerplate_of_pages_without_structure(spark, monkeypatch):
    r = random.Random(2)
    rows, want = [], {}
    for i in range(60):
        host = f"h{i % 3}.example.org"
        page, own = site(r, i, host)
        rows.append((i, f"https://{host}/{i}", page, "x"))
        want[i] = "\n\n".join(own)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for cell in (1 << 20, 4000):  # a host in one cell, and in several
        assert {x["page_id"]: x["text"] for x in P.main_text(df, cell).collect()} == want


def test_repeated_substrings_against_brute_force():
    r = np.random.default_rng(4)
    for seed in range(20):
        streams = [[str(x) for x in r.integers(0, 4, r.integers(0, 30))] for _ in range(8)]
        kinds = [0, 0, 1, 2, 3, 4, 5, 6]
        got = P.repeated(streams, kinds, 4, 3)
        where = {}
        for s, k in zip(streams, kinds):
            for i in range(len(s) - 3):
                where.setdefault(tuple(s[i : i + 4]), set()).add(k)
        for s, covered in zip(streams, got):
            want = np.zeros(len(s), bool)
            for i in range(len(s) - 3):
                if len(where[tuple(s[i : i + 4])]) >= 3:
                    want[i : i + 4] = True
            assert covered.tolist() == want.tolist()


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "not an address", "<p>alone</p>"), (4, "http://h/x", "no markup & so on"),
            (4, "http://h/x", "no markup & so on"), (5, "http://h/y", "<p>" * 5000 + "deep"), (6, "http://h/z", "<"),
            (7, "http://h/z", "<p a='" + "b" * 100000), (8, "http://q/", "<article></article><p>outside</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["text"]) for r in P.main_text(df).collect()), key=repr)
    want = [(1, ""), (2, ""), (None, "alone"), (4, "no markup & so on"), (4, "no markup & so on"), (5, "deep"), (6, "<"),
            (7, rows[7][2]), (8, "outside")]
    assert got == sorted(want, key=repr)
    assert P.main_text(df.limit(0)).collect() == []


def test_articles_in_wrappers():
    article = "<article><h1>Title</h1><p>one two three</p></article>"
    for around in ('div class="layout has-sidebar"', 'div class="no-header"', 'div id="page-with-nav"', "form method=post", 'div class="search"'):
        page = f"<body><{around}><nav>Home</nav>{article}<footer>(c)</footer></{around.split()[0]}></body>"
        assert [t for z, t in P.blocks(page) if z == P.ARTICLE] == ["Title", "one two three"], around
        plain_page = page.replace("<article>", "<div>").replace("</article>", "</div>")
        assert [t for z, t in P.blocks(plain_page) if z == P.OPEN] == ["Title", "one two three"], around
    for beside in ("aside", 'div class="comments"', 'section id="related-posts"'):
        page = f"<body>{article}<{beside}>{article.replace('three', 'four')}</{beside.split()[0]}></body>"
        assert [t for z, t in P.blocks(page) if z == P.ARTICLE] == ["Title", "one two three"], beside


def test_sections_of_articles_named_like_chrome():
    page = """<article><p>a b c d e f</p><div class="section-search"><p>g h</p></div><div class="related-work"><p>i j</p></div>
      <div class="share-buttons">Share</div><div class="related-posts">More</div></article>"""
    assert [t for z, t in P.blocks(page) if z == P.ARTICLE] == ["a b c d e f", "g h", "i j"]


def test_short_phrases_of_running_text_stay(spark):
    """Texts of few words, where any four of them recur; a notice and a menu recur as blocks."""
    r = random.Random(3)
    notice = " ".join(f"n{i}" for i in range(40))
    rows, want = [], {}
    for i in range(40):
        own = [" ".join(r.choice("abcd") for _ in range(r.randint(12, 60))) for _ in range(3)]
        page = f"<div>Start Menu</div><p>{own[0]}</p><p>{own[1]}</p><p>{notice} page {i}</p><p>{own[2]}</p>"
        rows.append((i, f"https://h.example.org/{i}", page))
        want[i] = "\n\n".join(own)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x["page_id"]: x["text"] for x in P.main_text(df).collect()} == want


def test_boilerplate_does_not_depend_on_the_cells(spark):
    """Three pages of a host with a passage, and so many cells that hardly two of them meet."""
    r = random.Random(4)
    words = lambda n: " ".join(f"w{r.randint(0, 99999)}" for _ in range(n))
    passage = words(40)
    rows, want = [], {}
    for i in range(60):
        own = [words(30), words(30)]
        extra = f"<p>{passage}</p>" if i % 20 == 0 else ""
        rows.append((i, f"https://h.example.org/{i}", f"<div>Start Menu</div><p>{own[0]}</p>{extra}<p>{own[1]}</p>"))
        want[i] = "\n\n".join(own)
    rows += [(100 + i, f"https://h.example.org/copy{i}", f"<p>Only here {passage[:150]}</p>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, many = ({x["page_id"]: x["text"] for x in P.main_text(df, size).collect()} for size in (1 << 20, 1000))
    assert one == many
    assert {i: t for i, t in many.items() if i < 100} == want


@pytest.mark.parametrize(
    "page",
    ["<script " * 100_000, "<a " * 100_000, '<a "' * 100_001 + ">", "<a " * 50_000 + '">', "<!" * 100_000, "</ " * 100_000,
     "<p '" * 50_000 + '<p "' * 50_000, "<!--" * 100_000, "<div>" * 20_000 + "</nav>" * 20_000, "<a b='>" * 60_000],
)
def test_unclosed_markup_takes_one_run(page):
    start = time.process_time()
    P.blocks(page)
    assert time.process_time() - start < 3


@pytest.mark.parametrize(
    "name",
    ["user-comments", "reader-comments", "post-comments", "comments-section", "comment-respond", "fb-comments", "discussion",
     "sponsored-content", "subscribe-cta", "social-media", "article-sidebar", "story-footer"],
)
def test_names_headed_by_what_they_are(name):
    page = f"<article><p>Main text.</p><div class='{name}'><p>Not of it.</p></div><p>More.</p></article>"
    assert [t for z, t in P.blocks(page) if z == P.ARTICLE] == ["Main text.", "More."]


@pytest.mark.parametrize("name", ["related-work", "has-comments", "no-sidebar", "with-footer", "section-search", "text"])
def test_names_that_only_mention_it(name):
    page = f"<article><p>Main text.</p><div class='{name}'><p>Also of it.</p></div></article>"
    assert [t for z, t in P.blocks(page) if z == P.ARTICLE] == ["Main text.", "Also of it."]
