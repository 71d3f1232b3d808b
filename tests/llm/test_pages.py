"""Main text against pages whose text is known by construction, and the supplied ones."""

import html
import random
import re
import time

import pytest

from beaconry.llm.pages import extract_main_text, main_text

PARAGRAPHS = [
    "The council met on Tuesday, and after a long debate, it voted for the new bridge, which opens in May.",
    "Costs have risen by 5 % & more; engineers, planners and neighbours <all> were heard.",
    "Short.",
    "A third paragraph, with a <a href='/x'>single link</a> in it, goes on for quite a while to say little, but does so at length.",
]
PLAIN = "The council met on Tuesday, and after a long debate, it voted for the new bridge, which opens in May. " \
    "Costs have risen by 5 % & more; engineers, planners and neighbours <all> were heard. Short. " \
    "A third paragraph, with a single link in it, goes on for quite a while to say little, but does so at length."
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>About us</a></li></ul>"
BODY = "".join(f"<p>{p.replace('&', '&amp;').replace('<all>', '&lt;all&gt;')}</p>\n" for p in PARAGRAPHS)


@pytest.mark.parametrize("page", [
    f"<body><header><h1>Site</h1>{MENU}</header><div id=content>{BODY}</div><div class=sidebar><p>Buy, buy, buy this thing now.</p></div>"
    "<div id='comments'><p>I disagree, strongly, with all of it, and here is a long reason, with commas, to score.</p></div><footer>(c) 2020</footer>",
    f"<html><body><nav>{MENU}</nav><main><article>{BODY}</article><aside><p>Related, things, to read.</p></aside></main></body></html>",
    f"<div><div>{MENU}</div><div class='post'><section>{BODY}</section><form><p>Sign up, please, for more, and more.</p><input></form></div></div>",
    f"<div class='cookie-notice'>We use cookies, to track, you, all day long, on every page.</div><div class='layout has-sidebar'><div>{BODY}</div>{MENU}</div>",
    f"<table><tr><td>{MENU}<td>{BODY}</table><script>if (a < b) document.write('<p>no, no</p>')</script><style>p > a {{}}</style>",
    f"<article>{BODY}<!-- <p>hidden, text</p> --><div style='display: none'>no</div><div hidden>no</div><template><p>no</p></template></article>",
    f"<article>{BODY}<section class=comments><article class=comment><p>First, of all, this is a comment, is it not?</p></article></section></article>",
    f"<ARTICLE>{BODY.replace('</p>', '')}</ARTICLE><div role='complementary'>Other, matters, entirely.</div>",
    f"<article><div class='article-body'>{BODY}</div><div class='ad'>An advert.</div></article><div class='related'><article>{MENU}</article></div>",
])
def test_layouts(page):
    assert main_text(page) == PLAIN


def test_text():
    assert main_text("<article>a<b>b</b>c<br>d&nbsp;e &#233;&eacute;&amp;lt; \n\t f<p>g<p>h<li>i</article>j") == "abc d e éé&lt; f g h i"
    assert main_text("<article><h1>Title</h1><p>One<p>Two</p></article>") == "Title One Two"
    assert main_text("no markup, at all") == "no markup, at all"
    assert main_text("<article><p>1 < 2 and a <3 b<p>cut off <a href='x") == "1 < 2 and a <3 b cut off"
    assert main_text("<article><p>x<!-- never closed <p>y") == "x"
    assert main_text("<article></b></p></div></article>") == main_text(None) == main_text("") == main_text("<nav><p>a, b</p></nav>") == ""
    assert main_text("<article><script>x</script y><p>kept</p><textarea>no</textarea><svg><text>no</text></svg></article>") == "kept"


def test_long_and_deep():
    start = time.time()
    assert main_text("<article>" + "<p>one, two</p>" * 50_000 + "</article>") == " ".join(["one, two"] * 50_000)
    assert main_text("<div>" * 20_000 + "deep, text" + "</div>" * 20_000) == "deep, text"
    assert main_text("<article><p><b>x" * 3000).endswith("x")
    assert main_text("<article><p>" + "<a '" * 3000 + "x").startswith("<") is False
    assert time.time() - start < 60


def test_mutilated():
    """Pages cut or shuffled anywhere give some text and never fail."""
    rng, page = random.Random(5), f"<body>{MENU}<div id=content>{BODY}</div><!-- x --><div class=ad>ad</div>"
    for _ in range(400):
        i, j = sorted(rng.sample(range(len(page)), 2))
        assert isinstance(main_text(page[:i] + page[j:]), str)


def test_supplied_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        inside = re.search("<article>(.*?)</article>", r.html, re.S).group(1)
        text = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inside))).split())
        assert got[r.page_id] == (r.url, text, len(text))


def test_odd_rows(spark):
    rows = [(1, "u", None, "old", 3), (1, "u", None, "old", 3), (None, None, "", None, None), (2, "v", "<p>x, \U0001f600</p>", "old", 1), (3, "w", "<p>" + "y " * 100_000, "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _html int")
    out = extract_main_text(pages)
    assert out.columns == ["page_id", "url", "_html", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text[:5], r.n_chars) for r in out.collect()) == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "x, \U0001f600", 4), (3, "y y y", 199_999)]
    assert extract_main_text(pages.limit(0), keep_html=True).collect() == []
