"""Main text of pages of several builds."""

import re

import pytest
from pyspark.sql import functions as F

from jobloom.llm import html_text as ht
from jobloom.llm import queries

LONG = "This is a long paragraph of the article, and it is here so that the rules see what they need to see in it."
MENU = "".join(f'<li><a href="/{i}">Section number {i}</a></li>' for i in range(8))

PAGES = [
    (None, ""), ("", ""), ("   \n ", ""), ("plain words only", "plain words only"),
    ("<p>a &amp; b&nbsp;&lt;c&gt; &#233;&#x4e2d;</p>", "a & b <c> é中"),
    (f"<nav><ul>{MENU}</ul></nav><article><h1>T</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; x</footer>", f"T\n{LONG}\nShort."),
    ("<article><p>one<br>two</p><p>%%% ||| ###</p></article>", "one two\n%%% ||| ###"),
    ('<script>var t="</p><article>no</article>";</script><style>p{}</style><article><p>yes</p></article>', "yes"),
    ("<article><p>a<!-- <p>no</p> -->b</p><!-- open", "ab"),
    (f'<div class="ad">{LONG}</div><div id="cookie-notice">{LONG}</div><main><p>{LONG}</p></main><aside>{LONG}</aside>', LONG),
    (f'<article><p>{LONG}</p><div class="comments"><p>{LONG} me too</p></div><form><p>{LONG}</p><input></form></article>', LONG),
    (f'<div class="wrapper"><div class="sidebar"><p>{LONG}</p></div><div class="post"><h2>Head</h2><p>{LONG}</p><p>Yes.</p></div></div>', f"Head\n{LONG}\nYes."),
    (f"<body><div><ul>{MENU}</ul></div><p>{LONG}</p><p>{LONG}</p></body>", f"{LONG}\n{LONG}"),
    (f'<div class="menu-layout"><article><p>{LONG}</p></article></div>', LONG),
    ("<article><p><b>unclosed<br><p>next</p></article>after", "unclosed\nnext"),
    ("<article><p>x</p></div></p></article>", "x"), ("<p", ""), ("<article>a<b>b</b>c</article>", "abc"),
    (f'<p hidden>{LONG}</p><p style="display: none">{LONG}</p><p>{LONG}</p>', LONG),
    ('<article><header><h1>Own head</h1></header><p>Body.</p><footer>By me</footer></article>', "Own head\nBody."),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_pages(page, want):
    assert ht.main_text(page) == want


def test_second_pass_takes_the_nearest_label():
    short = [ht.Block("s", 0, False, False)] * 7
    labels = [None, True, None, None, False, None, None]
    assert ht.second_pass(short, labels) == [True, True, True, False, False, False, False]
    between = ht.second_pass(short[:3], [True, None, False])
    assert between == [True, True, False]
    head = [short[0], ht.Block("h", 0, True, False), short[0]]
    assert ht.second_pass(head, [True, None, False]) == [True, False, False]


def test_very_long_and_deep_pages():
    assert ht.main_text("<div>" * 20_000 + "<p>deep enough</p>") == "deep enough"
    text = ht.main_text("<article>" + f"<p>{LONG}</p>" * 5000)
    assert text.count("\n") == 4999


def test_column(spark):
    kind = "page_id long, url string, html string, text string, n_chars string"
    df = spark.createDataFrame([(i, "u", p, "x", "y") for i, (p, _) in enumerate(PAGES)], kind)
    rows = df.select("page_id", ht.extracted("html").alias("t")).collect()
    assert {r.page_id: r.t for r in rows} == {i: w for i, (_, w) in enumerate(PAGES)}
    assert df.limit(0).select(ht.extracted("html")).count() == 0


def test_given_pages_by_another_way(spark):
    """The given pages have one build: the article's tags, stripped, are the text."""
    import html

    def simple(page):
        body = re.search("<article>(.*)</article>", page, re.S)[1]
        parts = re.split(r"</?(?:h1|p)>", body)
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in parts)
        return "\n".join(x for x in lines if x)

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op2(spark, sf).withColumn("n", F.length("text")).collect()
    assert {r.page_id: r.text for r in rows} == {i: simple(h) for i, h in pages.items()}
    assert all(r.n_chars == r.n == len(r.text) for r in rows)


def test_open_quotes_end_at_the_next_bracket():
    assert ht.main_text('<article><p title="x>one</p><p>two</p></article>') == "one\ntwo"
    assert ht.main_text('<p title="' + "<a " * 3000) == ""


OTHER = "There was a man who had it all, and he was not in the least sure that this is what they had for him."


@pytest.mark.parametrize("page,want", [
    (f'<div id="content"><p>{LONG}</p><p>{OTHER}</p></div><div class="related"><article><p>{OTHER}</p></article></div>', f"{LONG}\n{OTHER}"),
    (f'<div id="content"><p>{LONG}</p><p>{OTHER}</p></div><div><article><p>Teaser.</p></article></div>', f"{LONG}\n{OTHER}\nTeaser."),
    (f'<div class="promo"><article><p>{OTHER}</p></article></div><article><p>{LONG}</p></article>', LONG),
    (f'<p>{OTHER}</p><article><p>{LONG}</p><p>{OTHER}</p></article>', f"{LONG}\n{OTHER}"),
    (f'<article><p>{LONG}</p><ul><li><a href="/">{OTHER}</a></li></ul><p>{"Price table 12 EUR, " * 6}</p><p><a href="/">{OTHER}</a></p></article>', LONG),
])
def test_an_article_element_is_evidence_only(page, want):
    assert ht.main_text(page) == want


@pytest.mark.parametrize("name", ["with-sidebar", "content-no-sidebar", "menu-open", "has-toc", "search-results", "related-topics",
                                  "post no-comments", "comments-open"])
@pytest.mark.parametrize("tag", ["div", "article", "main"])
def test_a_wrapper_that_holds_a_name_keeps_its_text(name, tag):
    assert ht.main_text(f'<{tag} class="{name}"><h1>Head</h1><p>{LONG}</p><p>{OTHER}</p></{tag}>') == f"Head\n{LONG}\n{OTHER}"


@pytest.mark.parametrize("name", ["comments", "post-comments", "comment-list", "site-footer", "left-sidebar", "related_posts"])
def test_named_elements_beside_the_text_go(name):
    assert ht.main_text(f'<div class="post"><p>{LONG}</p></div><div class="{name}"><p>{LONG[:90]}</p></div>') == LONG


S = "The council has agreed on a plan for the old harbour, and the work is to begin in the spring of next year."
REMARK = "I think that this is a very long remark about the thing and it is not a part of the article that was written at all. " * 3


@pytest.mark.parametrize("element", [
    'div class="comments-area"', 'div class="comment-list"', 'ol class="commentlist"', 'section id="comments-section"',
    'div id="disqus_thread"', 'div class="post-comments"', "div class=comment", 'div class="comment-respond"',
])
def test_remarks_never_count(element):
    tag = element.split()[0]
    inner = f"<li>{REMARK}<li>{REMARK}" if tag == "ol" else f"<p>{REMARK}</p><p>{REMARK}</p>"
    page = f"<div><h1>Title</h1><p>{S}</p></div><{element}>{inner}</{tag}>"
    assert ht.main_text(page) == f"Title\n{S}"
    assert ht.main_text(f"<article><h1>Title</h1><p>{S}</p><{element}>{inner}</{tag}></article>") == f"Title\n{S}"


@pytest.mark.parametrize("page", [
    f'<div title="the hidden valley">{S}</div>', f"<p class=notice>Cookies.<p>{S}", f"<ul><li class=ad>Buy now.<li>{S}</ul>",
    f'<div class="article search">{S}</div>', f'<div id="public-notice">{S}</div>', f'<div data-x="class=sidebar">{S}</div>',
    f"<table><tr><td class=ad>Buy now.<td>{S}<tr><td class=menu>Menu</table>", f"<dl><dt class=ad>Buy<dd>{S}</dl>",
    f'<div class="search-results"><p>{S}</p></div>', f'<div class="sidebar"><p>{S}</p></div>',
    f'<div><p>{S}</p></div><div class="related-posts"><p>{REMARK}</p></div>',
])
def test_article_text_is_kept_and_asides_go(page):
    assert ht.main_text(page) == S


@pytest.mark.parametrize("text", [
    "Городской совет утвердил план восстановления старой гавани, и работы должны начаться весной следующего года.",
    "市议会已经同意了旧港口的重建计划，工程将于明年春天开始，届时市民可以前往参观并提出意见和建议。",
    "Kaupunginvaltuusto hyväksyi vanhan sataman kunnostussuunnitelman, ja työt alkavat ensi vuoden keväällä.",
])
def test_languages_without_stop_words(text):
    page = f"<ul class=menu><li><a href=x>a</a></ul><div><h1>Z</h1><p>{text}</p><p>{text}</p></div><div><a href=a>{text}</a></div>"
    assert ht.main_text(page) == f"Z\n{text}\n{text}"
