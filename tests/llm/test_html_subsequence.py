import html as html_lib
import random
import re

import pytest

from conftest import DATA
from glotsieve.llm import queries
from glotsieve.llm.html_subsequence import PLAIN, Page, extract, fit, maximal_runs, weights_of

WEIGHTS = {"word": 1.0, "tag:/article": -9.0, "tag:article": -9.0, "tag:other": -1.0, "tag:p": -0.02, "tag:/p": -0.02,
           "tag:h1": -0.02, "tag:/h1": -0.02, "boilerplate:nav": -9.0, "boilerplate:aside": -1.0, "tag:a": -1.0, "tag:/a": -1.0}


def text_of(page, weights=WEIGHTS):
    return Page(page).text(weights)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        ("plain words", "plain words"),
        ("<p>a &amp; b&nbsp;&#233; &lt;i&gt;</p>", "a & b é <i>"),
        ("<p>one\n two<br>three <b>bo</b>ld</p><p>four</p>", "one two three bold\n\nfour"),
        ("<nav>menu words here</nav><article><h1>T</h1><p>some more text</article><footer>foot</footer>", "T\n\nsome more text"),
        ("<article><p>a b c</p><aside class=x>no <b>no</b></aside><p>d e f</p></article>", "a b c\n\nd e f"),
        ("<p>x y z<script>var a = '<p>no</p>'</script> w<style>p{}</style></p>", "x y z w"),
        ("<head><title>no</title></head><body><p>yes yes", "yes yes"),
        ("<!-- no <p>no --><p>yes<!-- never closed <p>no", "yes"),
        ('<div class="cookie-notice">no no no<p>no</p></div><p>yes yes</p>', "yes yes"),
        ('<div id="comments"><p>no no</p></div><p>yes yes</p>', "yes yes"),
        ('<a href="x>y" title=\'a"b\'>in link</a> out again', "in link out again"),
        ("<p>1 < 2 and 3 <4</p>", "1 < 2 and 3 <4"),
        ('<p>open quote <a href="never>text goes on', "open quote text goes on"),
        ("<form><input>no</form><p>yes</div></p></nav>", "yes"),
        ('<div class="ad">ad ad ad<article><p>inside still counts</p></article>', "inside still counts"),
        ("<p hidden>kept</p><p aria-hidden='true'>too</p><p>yes</p>", "kept\n\ntoo\n\nyes"),
    ],
)
def test_pages(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><h2 id="related-work">Related work</h2><p>a b</p></article>', "Related work\n\na b"),
        ('<article><section id="search-algorithms"><p>a b c</p></section></article>', "a b c"),
        ('<h3 id="social-science">Social science</h3><p>a b c</p>', "Social science\n\na b c"),
        ('<article><div class="comments share"><p>a b c</p></div></article>', "a b c"),
        ('<article><p>d e f</p><div class="comments share"><p>a b c</p></div></article>', "d e f"),
        ('<article><header><h1>The title</h1></header><p>a b</p><nav>no</nav><div role="navigation">no</div><form>no</form></article>', "The title\n\na b"),
        ('<a href="/show?id=search">some words</a> here again', "some words here again"),
        ('<p data-id="search" data-class=nav>words here</p>', "words here"),
        ('<p title="id=search">words here</p>', "words here"),
        ('<p title="The hidden valley">words here</p>', "words here"),
        ('<p title=\'aria-hidden="true"\'>words here</p>', "words here"),
        ('<p>no title <title>yes yes</p><p>end', "no title yes yes\n\nend"),
        ('<p>a <svg class="x"/> b</p><p>c <svg/>d</p>', "a b\n\nc d"),
        ("<p>a <svg><path d=x/>no</svg> b</p>", "a b"),
        ("<p>a b</p><script>var never = closed", "a b"),
        ("<svg><p>a b<template><p>c d", "a b\n\nc d"),
        ('<div class="widget"><p>all of the page</p></div>', "all of the page"),
        ('<p>a b c d e f</p><div class="related">x y</div><p>g h i j k l m</p>', "a b c d e f\n\ng h i j k l m"),
        ('<p>a b c d e f</p><div class="related">x y z x y z x y z</div>', "a b c d e f"),
    ],
)
def test_names_of_blocks(page, text):
    assert text_of(page) == text


LONG = " ".join(f"word{i}" for i in range(30))


@pytest.mark.parametrize(
    "page, text",
    [
        # (a) a comment that is longer than the article
        (f"<main><article><p>only nine words make up this very short article</p></article><section class=comments><p>{LONG}</p></section></main>",
         "only nine words make up this very short article"),
        (f"<article><p>a b c</p></article><div id=comments><article class=comment><p>{LONG}</p></article></div>", "a b c"),
        # (b) two articles
        (f"<nav>no</nav><article><p>first one</p></article><div>between</div><article><p>{LONG}</p></article>", f"first one\n\n{LONG}"),
        # (c) lists, tables and parts of any kind
        (f"<main><h1>T</h1><ul><li>one</li><li>two</li></ul><p>{LONG}</p><table><tr><td>c1</td><td>c2</td></tr></table></main>",
         f"T\n\none\n\ntwo\n\n{LONG}\n\nc1\n\nc2"),
        (f"<article><div><div>x y</div></div><p>{LONG}</p><blockquote>q</blockquote><unknown>u v</unknown></article>", f"x y\n\n{LONG}\n\nq\n\nu v"),
        # (d) adverts, newsletters, notices in the article, and elsewhere
        (f'<article><p>{LONG}</p><div class="ad">Buy now</div><p>a b</p><div class="newsletter"><p>Sign up</p></div></article>', f"{LONG}\n\na b"),
        (f'<article><p>{LONG}</p><p class="cookie-notice">We use them</p><p class="notable">a b</p></article>', f"{LONG}\n\na b"),
        (f'<div><p>{LONG}</p><div class="ad">Buy now</div><p>{LONG}</p></div>', f"{LONG}\n\n{LONG}"),
        # (e) hidden parts are not named
        (f"<article><p hidden>a</p><p>{LONG}</p><p aria-hidden=true>b</p></article>", f"a\n\n{LONG}\n\nb"),
        # divisions that hold the text of a page without article
        (f"<body><div><p>{LONG}</p></div><div><ul><li>a b c</li></ul><p>{LONG}</p></div></body>", f"{LONG}\n\na b c\n\n{LONG}"),
        (f'<div class="widget"><p>{LONG}</p></div>', LONG),
    ],
)
def test_page_forms_with_learned_weights(learned, page, text):
    assert text_of(page, learned) == text
    assert text_of(f"<html><body><nav><a href=/>Home page of all</a></nav>{page}<footer>foot</footer></body></html>", learned) == text


@pytest.fixture(scope="module")
def learned(spark):
    return fit(spark.read.parquet(f"{DATA}/pages.parquet"))


def test_runs_are_maximal():
    """Against the definition: runs by falling sum, each from what the better ones leave between them."""

    def parts(scores, first, past):
        best = max(((sum(scores[a:b]), a - b, -a, b) for a in range(first, past) for b in range(a + 1, past + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, a, b = best
        return [*parts(scores, first, -a), (best[0], -a, b), *parts(scores, b, past)]

    rng = random.Random(3)
    for _ in range(300):
        scores = [float(rng.choice([-4, -3, -2, -1, 1, 2, 3, 5])) + rng.random() / 1000 for _ in range(rng.randint(0, 18))]
        got = maximal_runs(scores)
        expected = parts(scores, 0, len(scores))
        assert [r[1:] for r in got] == [r[1:] for r in expected]
        assert all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(got, expected))


def test_raw_elements_without_end_are_linear():
    for name in ("svg", "title", "head", "template"):
        assert text_of(f"<{name}>x " * 60000).count("x") == 60000


def test_region_is_the_maximum():
    """Against all runs of tokens."""
    rng = random.Random(5)
    for _ in range(60):
        page = "".join(rng.choice(["<p>", "</p>", "<a>", "</a>", "w ", "w w w ", "<nav>x</nav>", "<article>", "<x>"]) for _ in range(14))
        read = Page(page)
        value = [WEIGHTS["word"] * w if k == "word" else WEIGHTS.get(k, -1.0) for k, w, *_ in read.tokens]
        first, past = read.region(WEIGHTS)
        best = max([0.0] + [sum(value[a:b]) for a in range(len(value)) for b in range(a + 1, len(value) + 1)])
        assert abs(sum(value[first:past]) - best) < 1e-9


def test_long_pages_are_linear():
    for page in ("<" * 300000, "<a " * 100000, '<a href="' * 60000, "<div>" * 50000 + "x", "<!--" * 60000, "</b>" * 60000, "<p>w</p>" * 60000, '<a b="c' * 50000 + ">"):
        assert isinstance(text_of(page), str)


def test_weights():
    assert weights_of({}) == PLAIN
    found = weights_of({"word": (900, 50), "tag:p": (40, 0), "tag:li": (0, 60), "boilerplate:nav": (0, 20)})
    assert found["word"] > 0 > found["tag:p"] > found["tag:li"] and found["boilerplate:nav"] < 0


def test_extract(spark):
    pages = ["<nav>a b</nav><article><p>text here</article><footer>f</footer>", None, "", "<p>no label</p>"] * 2
    df = spark.createDataFrame([(i, None, p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    weights = fit(df)
    got = {r.page_id: r.text for r in extract(df, weights).collect()}
    assert [got[i] for i in range(8)] == ["text here", "", "", "no label"] * 2
    assert fit(df.limit(0)) == PLAIN and extract(df.limit(0), PLAIN).count() == 0


def test_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = queries.op9_html_subsequence(spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        blocks = (" ".join(html_lib.unescape(re.sub("</?b>|<br>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
