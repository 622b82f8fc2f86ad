import re
import time
from html import unescape

import pytest

from helixframe.llm import html
from helixframe.llm.queries import op1_html


def article(page):
    """What these pages hold between the article's tags, block by block."""
    inside = re.search(r"<article>(.*)", page, re.S)[1].split("</article>")[0]
    blocks = re.split(r"</?(?:p|h1)>", inside)
    texts = (" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def test_query_matches_the_articles(spark):
    for at in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
        rows = op1_html(spark, at).collect()
        assert len(rows) == len(pages)
        for r in rows:
            assert r["text"] == article(pages[r["page_id"]])
            assert r["n_chars"] == len(r["text"])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home sidebar-left">
<header class="site"><a href=/>Home</a><p>Welcome to the site, dear reader, it is a nice, long, welcome text.</p></header><nav><ul><li><a href=x>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them, to make this better, faster, stronger for all of you.</p></div>
<div id="wrap"><div class="sidebar"><p>About the author, who has written a lot, of all kinds of things, in all of the years.</p></div>
%s<div class="ad">Buy now, cheap, fast, and all of it for free, if only you call us at once!</div></div>
<div id="comments"><div class="comment"><p>I liked it, really, a lot, and would read it again, and again, and again, and again.</p></div></div>
<form><label>Mail</label><input name=q><textarea>write, here</textarea></form><footer>&copy; 2020, all rights</footer><script>var a="<p>no</p>";</script></body></html>"""
BODY = """<h1>The  title</h1><p>First <b>paragraph</b>, with a <a href="y">link</a> &amp; more&nbsp;text, so that it counts.<p>Second
one<br>here, unclosed, and <!-- gone --> long enough to be a paragraph of its own.<ul><li>item a<li>item b</ul><p>Short.</p>"""
TEXT = "The title\n\nFirst paragraph, with a link & more text, so that it counts.\n\nSecond one here, unclosed, and long enough to be a paragraph of its own.\n\nitem a\n\nitem b\n\nShort."


@pytest.mark.parametrize("tag", ["<article>%s</article>", "<main>%s</main>", '<div class="post-content">%s</div>', "<div>%s</div>", '<section id="content">%s</section>'])
def test_containers(tag):
    assert html.main_text(PAGE % (tag % BODY)) == TEXT


def test_inner_parts_go():
    inner = BODY + '<div class="share">Share, it, now</div><aside>Read also</aside><div class="comments"><p>Nice, one.</p></div><form><p>Subscribe, now</p></form>'
    assert html.main_text(PAGE % f"<article>{inner}</article>") == TEXT


@pytest.mark.parametrize(
    "part",
    [
        '<div class="post-comments"><p>Nice, one.</p></div>', '<section id="mainSidebar"><p>About, me.</p></section>', '<div class="article-footer">Filed, here</div>', '<ins class="adsbygoogle">Buy, it</ins>',
        '<div role="alert">Watch, out</div>', "<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div>", '<article class="comment-body"><p>Me, too.</p></article>', "<dialog>Hi, there</dialog>",
        '<div style="display: none">Hidden, text</div>', "<noscript><p>Turn, it on</p></noscript>", '<div class="cookieConsent">We, use</div>', '<ul class="main-menu"><li>Home<li>More</ul>',
    ],
)
def test_no_content(part):
    assert html.main_text(PAGE % f"<article>{BODY}{part}</article>") == TEXT
    assert html.main_text(PAGE % f'<div class="content has-sidebar">{part}{BODY}</div>') == TEXT


def test_content_by_name():
    inner = '<header class="entry-header"><h1>The title</h1></header><div class="post tag-travel with-sidebar"><p>Some, text.</p></div><div class="article-header"><p>Lead, in.</p></div>'
    assert html.main_text(PAGE % f"<article>{inner}</article>") == "The title\n\nSome, text.\n\nLead, in."


def test_edges(spark):
    assert html.main_text(None) == html.main_text("") == html.main_text("<html>") == ""
    assert html.main_text("plain, text &lt;3") == "plain, text <3"
    assert html.main_text("<p>a<p>b") == "a\n\nb"
    assert html.main_text("<article><p>cut &am") == "cut &am"
    assert html.main_text("<div>" * 5000 + "deep, text" + "</div>" * 5000) == "deep, text"
    long = "word, " * 100000
    assert html.main_text(f"<article><p>{long}</article>") == long.strip()
    rows = [(1, None, None, "x"), (1, "u", "<p>A</p>", "x"), (1, "u", "<p>A</p>", "x"), (None, "v", "<p>B", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in html.extract(df).collect()) == [("", 0), ("A", 1), ("A", 1), ("B", 1)]
    assert html.extract(df.limit(0)).count() == 0


def test_letters_that_grow_when_lower_cased_shift_nothing():
    page = "<html><body><article><p>" + "İ" * 40 + " first.</p><script>var x = '<p>no</p>';</SCRIPT ><p>Second, kept whole.</p></article></body></html>"
    assert html.main_text(page) == "İ" * 40 + " first.\n\nSecond, kept whole."


def test_hostile_tags_take_time_in_proportion():
    n = 20000
    for page in ("<b>" * n + "</i>" * n + "text", "<b>" * n + "<p>" * n + "text", "<div>" * n + "</p>" * n + "text", "<li><b>" * n + "text", "<header>" * n + "text"):
        began = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - began < 10


def test_short_lists_and_tables_beside_the_text_stay():
    words = "The story goes on, with many words, in a paragraph of its own. " * 6
    page = f"<body><div class='main'><div><p>{words}</p><p>{words}</p></div><ul><li>one</li><li>two</li></ul><table><tr><td>cell</td></tr></table></div></body>"
    assert all(x in html.main_text(page).split("\n\n") for x in ("one", "two", "cell"))


@pytest.mark.parametrize(
    "start",
    ['<p title="The hidden truth">', '<p data-hidden="false">', '<p data-id="sidebar">', "<p data-role='form'>", '<p lang=en class=lead data-x="class=&quot;sidebar&quot;">', '<p title=\'id="sidebar"\'>', '<p class="lead" class="sidebar">', "<p data-style='display: none'>"],
)
def test_attributes_are_read_whole(start):
    """Only an attribute's own name counts, never another's name or value."""
    page = PAGE % f'<article>{BODY}{start}Told, and kept, in <a href="/hidden/role=form">a place</a>, as it is.</p></article>'
    assert html.main_text(page) == TEXT + "\n\nTold, and kept, in a place, as it is."


@pytest.mark.parametrize("start", ["<p hidden>", "<p HIDDEN=''>", '<p data-x="1" hidden>', "<p id=sidebar>", '<p title="a>b" class="share">', "<p class = 'ad'>"])
def test_telling_attributes_still_cut(start):
    assert html.main_text(PAGE % f"<article>{BODY}{start}Gone, and never seen, by any reader.</p></article>") == TEXT


def test_short_parts_beside_the_best_stay():
    words = "The story goes on, with many words, in a paragraph of its own. " * 6
    parts = '<div class="part3"><p>END short para.</p></div><section><h2>HB</h2><p>Short closing words.</p></section><div><table><tr><td>cell</td></tr></table></div><div>Written by hand.</div>'
    page = f'<body><main><div class="part1"><p>{words}</p><p>{words}</p></div>{parts}</main></body>'
    assert html.main_text(page).split("\n\n")[2:] == ["END short para.", "HB", "Short closing words.", "cell", "Written by hand."]
