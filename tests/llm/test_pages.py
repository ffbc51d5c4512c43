"""Main text of pages: markup cases, and the minimum cut against all labellings."""

import html
import itertools
import re

import numpy as np
import pytest

from turnwise.llm.html_mincut import extract_pages, main_text, minimum_cut
from turnwise.llm.queries import op7_html_mincut

PAGE = """<html><body class="home"><header><h1>Site</h1><a href=x>Home</a></header><div id="cookie-notice">We use cookies.
Accept them please now.</div><div class="layout"><div class="sidebar"><p>Popular posts of the week are here.</p></div>
<div class="post-content"><h2>Title here</h2><p>First paragraph with &lt;b&gt; and<br>break &nbsp; x. <p>Second one, longer
text follows with many words.<aside>Ad: buy this now.</aside><ul><li>item one<li>item two</ul></div></div>
<section id="comments"><h3>Comments</h3><p>Nice article, I really liked it a lot.</p></section>
<form><label>Email</label><input></form><script>var a = "</p>";</script><footer><p>All rights reserved.</p></footer>"""


def test_boilerplate_goes_and_content_stays():
    assert main_text(PAGE) == (
        "Title here\n\nFirst paragraph with <b> and break x.\n\nSecond one, longer text follows with many words.\n\n"
        "item one\n\nitem two"
    )


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<", ""),
        ("<p>a < b, and so on, and on.</p>", "a < b, and so on, and on."),
        ("<article><p>x &amp y &#233; &eacute;</p></article>", "x & y é é"),
        ("<article><p>one<p>two</article>", "one\n\ntwo"),
        ("<article><h1>t</h1><p><b>bold<br></article><footer>f</footer>", "t\n\nbold"),
        ("<article><p>kept</p><div class='ad'>Buy now!</div><p>also kept</p></article>", "kept\n\nalso kept"),
        ("<nav><a href=a>One link</a></nav>", ""),
        ("<article><!-- <p>no</p> --><p title='a > b'>yes</p></article>", "yes"),
        ("<article><p>The sum <math><mi>a</mi>+<mi>b</mi></math> is small.</p></article>", "The sum a+b is small."),
    ],
)
def test_markup(page, text):
    assert main_text(page) == text


ARTICLE = "<h1>A title</h1><p>The first paragraph of it, with many words to read.</p><p>And the second one, as long as that.</p>"
TEXT = "A title\n\nThe first paragraph of it, with many words to read.\n\nAnd the second one, as long as that."
AROUND = "<nav><a href=a>Home</a></nav>{}<div class='sidebar'><p>Popular posts of this week.</p></div><footer><p>All rights.</p></footer>"


@pytest.mark.parametrize(
    "page",
    [
        "<form id='aspnetForm'>" + AROUND.format(f"<article>{ARTICLE}</article>") + "</form>",
        AROUND.format(f"<article class='share-story'>{ARTICLE}</article>"),
        AROUND.format(f"<article id='form-1040-tax'>{ARTICLE}</article>"),
        AROUND.format(f"<div class='header-widget'><main>{ARTICLE}</main></div>"),
        AROUND.format(f"<article>{ARTICLE}<form><p>Send us your opinion of this, please.</p></form></article>"),
        AROUND.format(f"<article>{ARTICLE}</article><section id='comments'>" + "<article class='comment'><p>I liked it a lot, thanks.</p></article>" * 9 + "</section>"),
    ],
)
def test_what_holds_the_article_is_not_dropped_for_a_word(page):
    assert main_text(page) == TEXT


def test_pages_of_many_alternating_blocks():
    import time

    one = "<p>A sentence of an article with some words in it.</p><div class='ad'>Buy this thing now!</div>"
    start = time.process_time()
    text = main_text("<article>" + one * 10_000 + "</article>")
    assert time.process_time() - start < 10
    assert text == "\n\n".join(["A sentence of an article with some words in it."] * 10_000)


def test_letters_that_grow_in_lower_case_before_a_script():
    """U+0130 is two code points in lower case; places must be those of the page itself."""
    page = "<article><p>" + "\u0130" * 200 + "</p><ScrIpt>var a = '<p>no</p>';</sCRIPT ><p>The text after it, all of it.</p>" + "</article>"
    assert main_text(page) == "\u0130" * 200 + "\n\nThe text after it, all of it."


def test_op7_against_the_pages_articles(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in op7_html_mincut(spark, folder).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
        assert r.url == pages[r.page_id].url


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>Some words to read here.</p>", "y"), (1, "u", None, "x"), (2, "v", "<p>" * 5000 + "z", "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_pages(pages).collect())
    assert got[:3] == [(0, "Some words to read here.", 24), (1, "", 0), (1, "", 0)]
    assert extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(25))
def test_cut_is_minimal(seed):
    r = np.random.default_rng(seed)
    n = 9
    scores = r.normal(0, 2, n).round(3).tolist()
    edges = [(k - 1, k, float(r.random())) for k in range(1, n)]
    edges += [(int(a), int(b), float(r.random())) for a, b in (r.choice(n, 2, replace=False) for _ in range(6))]

    def cost(labels):
        wrong = sum(max(s, 0) if not kept else max(-s, 0) for s, kept in zip(scores, labels, strict=True))
        return wrong + sum(w for a, b, w in edges if labels[a] != labels[b])

    best = min(cost(labels) for labels in itertools.product([False, True], repeat=n))
    assert cost(minimum_cut(scores, edges)) == pytest.approx(best)
