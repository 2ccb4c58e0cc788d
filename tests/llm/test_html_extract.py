"""Main text of pages with every kind of surrounding."""

import time

import pytest

from corrobora.llm import html_extract as module
from corrobora.llm.html_extract import extract, grow, main_text, text_blocks

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
<header class="site"><a href="/">Home</a> The Daily Example of news</header><nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav>
<!-- ad <p>hidden</p> --><div class="cookie-notice">We use cookies on this site to serve you better, please accept them all.</div>
<article><h1>The  title</h1><p>First &lt;b&gt; <b>bold</b>er&nbsp;paragraph<br>with   a break.<p>Short.</p>
<div class="ad">Buy this now while the offer of a lifetime lasts for you and yours.</div>
<aside>Related: something else that is long enough to look like a paragraph of text.</aside>
<p>See <a href="x">this link</a> for more of the story that goes on and on for a while.</p>
<form><label>Your name</label><input value="x"></form></article>
<section id="comments"><h2>Comments</h2><p>I read the whole article twice and I must say that it was quite good, thanks.</p></section>
<footer>&copy; 2020 Example &middot; all rights reserved for ever</footer></body></html>"""


def test_parts_of_a_page():
    want = ["The title", "First <b> bolder paragraph with a break.", "Short.", "See this link for more of the story that goes on and on for a while."]
    assert main_text(PAGE) == "\n\n".join(want)


def test_page_without_article():
    body = "".join(f"<p>{'Words of a long enough paragraph follow here. ' * 5}</p>" for _ in range(3))
    page = f"<body><div class=menu><a href=1>A</a> <a href=2>B</a></div>{body}<div class='comment-list'>{'Nice words from a reader of this. ' * 6}</div></body>"
    assert main_text(page).count("\n\n") == 2


@pytest.mark.parametrize("page", ["", "plain < text & more", "<", "<!-- open", "<script>x", "</div></p>", "<p", "<div " + "'" * 3000, "<a>" * 500, "<div>" * 3000 + "deep"])
def test_odd_pages_do_not_fail(page):
    main_text(page)
    text_blocks(page)


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<a b='" * 170_001, "<a b='" * 170_001 + ">", "<a b=\"x>" * 120_000 + "'>", '<a ">"' * 170_000 + "'", "<svg>" + "<svg " * 200_000, "<div>" * 100_000 + "</section>" * 100_000, "<head>" * 170_000 + "<p>", "<" * 1_000_000, "<!--" * 250_000, "<button><p>" * 90_000, "<p>" + "&amp" * 250_000, "<div id" * 140_000 + ">", "<b <b>" * 170_000, "<p>" + "word " * 200_000],
)
def test_long_pages_take_time_in_proportion(page):
    """A megabyte each; what searches to the end at every tag takes minutes here."""
    main_text("<p>warm</p>")
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 2


def test_quotes_and_brackets_in_tags():
    long = "Words of a long enough paragraph follow here, and then some more of them."
    assert main_text(f"<p title='a > b' id=\"<p>\">{long}</p><p <b>{long}</b></p><p title='open>{long}</p>") == "\n\n".join([long] * 3)
    assert main_text(f"<p>{long} 1 < 2 and 3 > 2 <3</p>") == f"{long} 1 < 2 and 3 > 2 <3"


def test_parts_of_an_article_that_names_and_links_do_not_take():
    links = "".join(f"<li><a href={k}>Source number {k} of them</a></li>" for k in range(4))
    for part, kept in [
        (f"<div class='text-widget'><p>{LONG}</p></div>", LONG),
        (f"<div class='share'><p>{LONG}</p></div>", LONG),
        (f"<ul>{links}</ul>", "Source number 3 of them"),
        ("<header><h1>The title of it</h1></header>", "The title of it"),
    ]:
        assert kept in main_text(f"<nav><a href=x>One</a></nav><article><p>{LONG}</p>{part}<p>{LONG}</p></article><footer>Two words</footer>"), part
    widgets = "".join(f"<div class='elementor-widget'><p>{x}</p></div>" for x in (LONG, "Short one here.", LONG))
    assert "Short one" in main_text(f"<div><a href=x>One</a></div>{widgets}")
    for part in (f"<div class='advert'><p>{LONG}</p></div>", "<div class='share'>Share it <a href=x>now</a></div>", f"<nav><ul>{links}</ul></nav>", f"<div class='related'><ul>{links}</ul></div>", f"<aside><p>{LONG[:300]}</p></aside>"):
        assert main_text(f"<article><p>{LONG}</p>{part}<p>{LONG}</p></article>") == f"{LONG}\n\n{LONG}", part


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "v", None, "y"), (None, None, "", "z"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = extract(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == sorted([("1", len(main_text(PAGE)))] * 2 + [("2", 0), ("None", 0)])
    assert all(len(r.text) == r.n_chars for r in got)
    assert extract(pages.limit(0)).count() == 0


def test_tree_separates_its_table():
    import numpy as np

    x, y = np.array([[0, 1], [1, 0], [1, 1], [0, 0]], float), np.array([1, 1, 0, 0], float)
    tree = grow(x, y)
    assert [tree(r) for r in x] == [True, True, False, False]


@pytest.mark.parametrize(
    "opened,closed",
    [
        ("<main class='content no-sidebar'>", "</main>"),
        ("<div id='content' class='right-sidebar'><article>", "</article></div>"),
        ("<div class='search-enabled'><article>", "</article></div>"),
        ("<div class='content-sidebar-wrap'><main>", "</main></div>"),
    ],
)
def test_layout_names_around_the_article(opened, closed):
    text = "Words of a long enough paragraph follow here, and then some more of them."
    advert = "<div class='ad'>Buy this now while the offer of a lifetime lasts for you.</div>"
    assert main_text(f"<body>{opened}<p>{text}</p>{advert}<p>{text}</p>{closed}</body>") == f"{text}\n\n{text}"


LONG = ("Words of a long enough paragraph follow here, and then some more of them, until there are sixty of them. " * 3).strip()


@pytest.mark.parametrize(
    "page,parts",
    [
        ("<main class='has-sidebar'>{p}{p}</main>", 2),
        ("<div class='layout has-sidebar'><article>{p}{p}</article></div>", 2),
        ("<div class='sidebar-layout'><div>{p}{p}</div></div>", 2),
        ("<article class='post comments-open'>{p}{p}</article>", 2),
        ("<nav><a href=x>One</a></nav><article class='sidebar'>{p}{p}</article><footer>Two words</footer>", 2),
        ("<form id='page'><div class='menu'><a href=x>One</a></div><article>{p}{p}</article></form>", 2),
        ("<form>{p}{p}</form>", 2),
        ("<article>{p}<button>Share{p}</article>", 2),
        ("<article>{p}<button>Share{p}<button>Print</button>{p}</article>", 3),
        ("<article>{p}<svg><path d='M0'>{p}</article>", 2),
        ("<article>{p}<noscript>{p}</article>", 2),
        ("<article>{p}<noscript>none</noscript>{p}<script>var x = '<p>';</article>{p}", 2),
        ("<article>{p}</article><div class='comments'>{p}{p}{p}</div>", 1),
    ],
)
def test_pages_of_misleading_names_and_unclosed_elements(page, parts):
    assert main_text(page.replace("{p}", f"<p>{LONG}</p>")) == "\n\n".join([LONG] * parts)


def test_short_pages():
    assert main_text("<body><p>Hello there you.</p><p>Second short one.</p></body>") == "Hello there you.\n\nSecond short one."
    assert main_text("<ul><li><a href=x>One</a><li><a href=y>Two</a></ul>") == ""


def test_neighbours_decide():
    """The same short block: among running text, and among links."""
    short = "<div>Five words and no link</div>"
    assert "Five words" in main_text(f"<div>{LONG}</div>{short}<div>{LONG}</div>")
    assert "Five words" not in main_text(f"<div>{LONG}</div><div>{LONG}</div><div><a href=x>One of the links</a></div>{short}<div><a href=y>Another one of the links</a></div>")


def test_the_labelled_pages_are_told_apart():
    rows, answers = module._labelled()
    assert len(rows) == len(answers) > 100
    assert sum(module.fitted()(r) == bool(y) for r, y in zip(rows, answers, strict=True)) >= 0.97 * len(rows)


def test_hints_that_stay():
    comment = "I read the whole article twice and I must say that it was quite good, thanks."
    page = f"<body><article><p>{'Main words go here. ' * 5}</p></article><div class='comments'><article><p>{comment}</p></article></div><article class='comment'><p>{comment}</p></article></body>"
    assert main_text(page) == ("Main words go here. " * 5).strip()


def test_formulas_stay_in_the_article():
    math = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='TeX'>x=2</annotation></semantics></math>"
    assert main_text(f"<article><p>We know that {math} holds for all of these many cases.</p></article>") == "We know that x=2 holds for all of these many cases."
