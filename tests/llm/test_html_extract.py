"""HTML extraction: the fixture pages' articles, and rules by example."""

import html
import re

import pytest

from faultline.llm import html_extract as H
from faultline.llm.queries import op9_html_extract

LONG = "The cat is on the mat and the dog is in the house of a man. " * 5


def article(page):
    """The text inside <article>, which the fixture's pages keep in h1 and p."""
    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    plain = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts)
    return "\n".join(x for x in plain if x)


def test_query_gives_the_articles(spark, sf001):
    want = {r.page_id: r for r in spark.read.parquet(f"{sf001}/pages.parquet").collect()}
    rows = op9_html_extract(spark, sf001).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.text == article(want[r.page_id].html)
        assert r.n_chars == len(r.text) and r.url == want[r.page_id].url


@pytest.mark.parametrize(("page", "text"), [
    ("<nav><a href=x>Home</a></nav><main><h2>T</h2><p>A &amp; B is  the\n one.</p></main><footer>c</footer>", "T\nA & B is the one."),
    ("<article><p>One of the things.<div class='ad box'>Buy the thing.</div><p>Two.</article>", "One of the things.\nTwo."),
    ("<article><header><h1>Head</h1></header><p>Body of it.</p><form>Name <input></form></article>", "Head\nBody of it."),
    (f"<div class=menu>x</div><div><p>{LONG}</p><p>So it is.</p><p>{LONG}</p></div><div>Contact</div>",
     f"{LONG.strip()}\nSo it is.\n{LONG.strip()}\nContact"),
    (f"<p>{LONG}</p><p><a href=1>{LONG}</a></p>", LONG.strip()),
    ("<article><p>Text of the day.</p><section id='comments'><article class=comment><p>I like the text.</p></article>"
     "</section></article>", "Text of the day."),
    ("<div class='ad'>never closed<article><p>Still the article.</p></article>", "Still the article."),
    ("<article><p>a<script>var t='</p><p>no</p>'</script>b</p><!-- <p>no</p> --><style>p{}</style></article>", "ab"),
    ("<article><p>x<br>y<b>z</b></p><p>cut off in a <b", "x yz\ncut off in a <b"),
    ("<body class='no-sidebar'><main class='content with-sidebar'><p class=ad>Buy.<p>The text.<li class=share>x<li>Item</main>",
     "The text.\nItem"),
    ("", ""), ("<p></p>", ""), ("<<<>>><", ""),
])
def test_rules(page, text):
    assert H.main_text(page) == text


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "<article>x</article>", 1), (4, "u", "<article>x</article>", 1),
            (4, "u", "<article>x</article>", 1), (5, "u", "<p>" + "<div>" * 20_000 + LONG * 100, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = [(r.page_id, r.text) for r in H.extract(pages).collect()]
    assert got[:5] == [(1, ""), (2, ""), (None, "x"), (4, "x"), (4, "x")]
    assert got[5][1] == (LONG * 100).strip()
    assert H.extract(pages.limit(0)).collect() == []


TAGS = "Berlin Paris Oslo Madrid Vienna Prague Warsaw Lisbon Athens Dublin Helsinki Zagreb Sofia Riga Tallinn"


@pytest.mark.parametrize(("page", "text"), [
    (f"<div class='post-meta'>May 3</div><div class='text'><p>{LONG}</p><p>{LONG}</p></div>", f"May 3\n{LONG.strip()}\n{LONG.strip()}"),
    (f"<div class='text'><h1>Head</h1><p>{LONG}</p></div><div class='content'><p>{TAGS}</p></div>", f"Head\n{LONG.strip()}"),
    (f"<div class='main-image'>A photo</div><p>{TAGS}</p><p>{LONG}</p><p>{TAGS}</p>", LONG.strip()),
    (f"<div>About us</div><article><h1>Head</h1><p>{LONG}</p><p>{TAGS}</p></article><div>Contact</div>",
     f"Head\n{LONG.strip()}\n{TAGS}"),
    (f"<article><h1>Head</h1><p>{TAGS * 12}</p></article><div class=x>{LONG[:80]}</div><footer>c</footer>",
     f"Head\n{TAGS * 12}\n{LONG[:80].strip()}"),
])
def test_density_decides_and_main_names_only_help(page, text):
    assert H.main_text(page) == text


def test_fixture_articles_without_their_tag(spark, sf001):
    """Without <article> stop words, length and links find nearly all of the same text."""
    same = total = 0
    for r in spark.read.parquet(f"{sf001}/pages.parquet").collect():
        got = set(H.main_text(re.sub(r"</?article>", "", r.html)).split("\n"))
        for line in article(r.html).split("\n"):
            same, total = same + len(line) * (line in got), total + len(line)
    assert same > 0.8 * total


@pytest.mark.parametrize(("body", "text"), [
    ("<p>A <svg class=i/> rest of the article</p>", "A rest of the article"),
    ("<p>A <svg><title>t</title><svg>x</svg>y</svg>rest</p>", "A rest"),
    ("<p>A <video-player a=1></video-player>b <button-group>c</button-group> <select-box/>d</p>", "A b c d"),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x=2</annotation></math> be.</p>", "Let x=2 be."),
    ("<p><button>Open <p>Two <svg><path/></svg>three<p><button>no</button>four", "Open\nTwo three\nfour"),
    ("<p>x<object>open</p><p>y<object><object>a</object>b</object>z</p>", "x open\ny z"),
    ("<p>x<textarea><p>no</p></textarea>y<script-like>z</script-like>", "x yz"),
])
def test_elements_are_skipped_only_to_their_own_end(body, text):
    assert H.main_text(f"<article>{body}</article>") == text


def test_unclosed_marks_are_text_and_cost_one_pass():
    """A megabyte of code or of one long name: quadratic work would take half an hour."""
    code = "for i <n; " * 100_000
    assert [len(b.text) for b in H.blocks_of(code)] == [len(code) - 1]
    assert H.blocks_of("<" + "a" * 1_000_000)[0].text == "<" + "a" * 1_000_000
    assert len(H.blocks_of("<p>x</p>" + "<b 'c " * 100_000)) == 2
    assert [b.text for b in H.blocks_of("<p>a</p> tail <x <!-- hidden <p")] == ["a", "tail <x"]
    assert [b.text for b in H.blocks_of("<p>a</p><!-- hidden <p>b</p> c")] == ["a"]
    assert [b.text for b in H.blocks_of("<p>a</p><script>x <p>b</p> c")] == ["a"]
