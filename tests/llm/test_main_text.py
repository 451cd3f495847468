import html as entities
import re
import time

import pytest

from visitlens.llm.html_main import main_text, main_texts

P = "<p>Some long paragraph, with commas, and with words enough to count as text of an article.</p>"
TEXT = "Some long paragraph, with commas, and with words enough to count as text of an article."

CASES = {
    "plain &amp; simple&nbsp;text": "plain & simple text",
    "": "",
    "<p>a<b>b</b>c<br>d</p>e": "abc d e",
    "<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>": "one two x y",
    "<p>one<p>two &lt;b&gt;": "one two <b>",
    "<nav><a href=/>Home</a></nav><footer>&copy; me</footer>": "",
    "<script>var a = '<p>x</p>';</script><style>p{}</style><p>kept</p>": "kept",
    "<!-- <p>gone</p> --><p>kept</p><!-- open": "kept",
    f"<div class='sidebar'>{P}</div><div id=content>{P}{P}</div><div class='comments'>{P}{P}{P}</div>": f"{TEXT} {TEXT}",
    f"<main><header><h1>Site</h1></header><article><header><h1>Head</h1><i>by X</i></header>{P}<aside>{P}</aside></article>"
    f"<section class=related>{P}</section></main>": f"Head {TEXT}",
    f"<div class=cookie-notice>{P}</div><article>{P}<form>{P}<input></form><div hidden>{P}</div>"
    f"<div style='display: none'>{P}</div><div class='ad'>{P}</div></article>": TEXT,
    f"<article>{P}<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>": TEXT,
    f"<article>{P}<ul><li>with <a href=1>one</a> link</ul></article>": f"{TEXT} with one link",
    f"<div class='layout has-sidebar'><div id=mainContent><h1 class='post header'>T</h1>{P}</div><div class=articleComments>{P}</div></div>": f"T {TEXT}",
    f"<div role=navigation><p>menu, menu, menu</p></div><div class='post-body'>{TEXT}<br>{TEXT}</div><div class='reader-comments'>{P}{P}{P}</div>": f"{TEXT} {TEXT}",
    f"<article><div class='entry-header'><h1>Head</h1><span>by X</span></div><div class='entry-content'>{P}<figure><figcaption>shown</figcaption></figure></div>"
    f"<div class='share-buttons'><p>Share, now</p></div></article>": f"Head {TEXT} shown",
    f"<div><h2>Title</h2><div>{P}{P}{P}</div></div>": f"Title {TEXT} {TEXT} {TEXT}",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert main_text(page) == CASES[page]


def test_broken_pages_end_soon():
    for page in ("<p>" * 20000 + "x", '<div "' * 3000, "<" * 50000, "<div>" * 5000 + "x", "<a href='" * 2000, "</p>" * 5000):
        main_text(page)


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in main_texts(pages).collect()}
    for row in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        inside = re.sub(r"<(/?)(p|h1|br|ul|li|div)[^>]*>", " ", inside)
        want = " ".join(entities.unescape(re.sub(r"<[^>]*>", "", inside)).split())
        assert got[row["page_id"]]["text"] == want and got[row["page_id"]]["n_chars"] == len(want)


def test_edges(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a</p>", "y"), (2, "v", "", "z")]
    got = main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "a", 1), (2, "v", "", 0)], key=str)
    assert main_texts(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


PARAGRAPH_1 = "The first paragraph tells, at some length, what happened on the river, and who was there to see it. " * 4
PARAGRAPH_2 = "The second one goes on about the weather, the boats, and the long way home through the green hills. " * 4


@pytest.mark.parametrize(
    "wrapper",
    [
        '<div class="wrapper header-fixed">{}</div>',
        '<div class="content social-science">{}</div>',
        '<div id="page" class="layout sidebar-right">{}</div>',
        '<div class="story legal-news">{}</div>',
        '<form id="aspnetForm">{}</form>',
        '<form><div class="sidebar"><div class="related">{}</div></div></form>',
        '<div class="comments-enabled comment-page">{}</div>',
    ],
)
def test_a_word_on_a_box_around_the_page_drops_nothing(wrapper):
    page = f"<p>{PARAGRAPH_1}</p><p>{PARAGRAPH_2}</p>"
    side = '<div class="sidebar">Weather today is fine, tomorrow too.</div><nav><a href="/">Home</a></nav>'
    want = f"{PARAGRAPH_1.strip()} {PARAGRAPH_2.strip()}"
    assert main_text(f"<html><body>{wrapper.format(page)}</body></html>") == want
    assert main_text(f"<html><body>{wrapper.format(page + side)}</body></html>") == want


def test_comments_and_forms_beside_an_article_stay_out():
    """However long they are: they come back only where next to nothing remains without them."""
    article = f'<div class="post"><p>{PARAGRAPH_1}</p></div>'
    comments = '<div class="comments">' + f"<div class='comment'><p>{PARAGRAPH_2}</p></div>" * 20 + "</div>"
    form = f"<form class='search'><p>{PARAGRAPH_2}</p></form>"
    assert main_text(f"<body>{article}{comments}{form}</body>") == PARAGRAPH_1.strip()
    short = f"<article><p>Short, but an article.</p></article>{comments}"
    assert main_text(f"<body>{short}</body>") == "Short, but an article."
    hidden = f'<div hidden><p>{PARAGRAPH_1}</p></div><div style="display: none">{PARAGRAPH_2}</div>'
    assert main_text(f"<body>{hidden}<p>Seen.</p></body>") == "Seen."
    both = f'<div class="sidebar"><p>{PARAGRAPH_1}</p></div>{comments}'
    assert main_text(f"<body>{both}</body>") == PARAGRAPH_1.strip()


def test_attributes_of_any_length_and_stray_quotes():
    for size in (800, 80_000, 1_000_000):
        image = f"<img alt='a>b' src=\"data:image/svg+xml,<svg>{'x' * size}</svg>\">"
        assert main_text(f"<body><p>{PARAGRAPH_1}{image}</p></body>") == PARAGRAPH_1.strip()
    stray = f'<p class=it\'s><b title=5">{PARAGRAPH_1}</b></p><p data-x="unclosed>{PARAGRAPH_2}</p>'
    text = main_text(f"<body>{stray}</body>")
    assert PARAGRAPH_1.strip() in text and "title" not in text
    began = time.time()
    assert main_text("<body>" + "<p a='" * 50_000 + f"<p>{PARAGRAPH_1}</p>")
    assert time.time() - began < 20
