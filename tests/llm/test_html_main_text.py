import html
import itertools
import random
import re
import time

import pytest

from tidemark.llm import html_main_text as hm


def cost(scores, edges, n, side):
    return sum(max(s, 0) for s, x in zip(scores, side) if not x) + sum(max(-s, 0) for s, x in zip(scores, side) if x) + sum(w for a, b, w in edges if side[a] != side[b])


def test_cut_is_minimal():
    rng = random.Random(10)
    for _ in range(60):
        n = rng.randint(1, 9)
        scores = [rng.uniform(-3, 3) for _ in range(rng.randint(1, n))]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        got = hm.min_cut(scores, edges, n)
        best = min(cost(scores, edges, n, side) for side in itertools.product((False, True), repeat=n))
        assert cost(scores, edges, n, got) == pytest.approx(best)


def test_data(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    weights = hm.train(pages)
    for r in hm.extract(pages, weights).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert r["text"] == want and r["n_chars"] == len(want)


PAGE = """<html><head><title>T</title></head><body><div id="header"><a href=/>Home</a> Site</div><div class="cookie-notice">We use cookies.</div>
<div class="side-bar sidebar"><ul><li><a>One</a><li><a>Two</a></ul></div><main><h1>A story &amp; more</h1><p>Cats are small animals that people keep, and they sleep
most of the day.<p>They eat <b>fi</b>sh&nbsp;&mdash; and mice, of course.<ul><li>first item<li>second item</ul></main>
<section class="comments"><article class="comment"><p>Great article, I liked it a lot, thanks for writing all of it.</p></article></section>
<form><label>Mail</label><input></form><script>if (a < b) document.write("<p>no</p>")</script><div class="footer">&copy; 2020</div></body></html>"""


def test_page_without_article():
    want = "A story & more Cats are small animals that people keep, and they sleep most of the day. They eat fish — and mice, of course. first item second item"
    assert hm.main_text(PAGE, hm.DEFAULT_WEIGHTS) == want


STORY = "<p>Cats are small animals that people keep, and they sleep most of the day.</p><h2>Food</h2><p>They eat fish, and mice, of course, when they can get them.</p>"
STORY_TEXT = "Cats are small animals that people keep, and they sleep most of the day. Food They eat fish, and mice, of course, when they can get them."
NAV, FOOTER = '<nav><a href="/">Home</a></nav>', '<div class="footer">&copy; 2020</div>'


@pytest.mark.parametrize("raw", ["<svg class=icon/>", '<svg class="icon"/>', "<math/>", '<script src="a.js"/>', "<svg><path>", "<canvas>", "<svg><title>x</title></svg>", "<script src=/a/>var a;</script>"])
def test_nothing_is_skipped_after_an_element_that_closes_itself(raw):
    page = f"<body>{NAV}<article>{raw}{STORY}</article>{FOOTER}</body>"
    assert hm.main_text(page, hm.DEFAULT_WEIGHTS) == STORY_TEXT


@pytest.mark.parametrize(
    "page",
    [
        '<body class="single-post has-sidebar">{nav}<article>{story}</article>{footer}</body>',
        '<body><div class="with-share">{nav}<main>{story}</main>{footer}</div></body>',
        '<body id="widget"><div class="no-sidebar"><div class="with-share">{nav}<article>{story}</article>{footer}</div></div></body>',
        '<body><form id="page">{nav}<main><div class="with-share"><article>{story}</article></div></main>{footer}</form></body>',
    ],
)
def test_wrappers_do_not_outweigh_the_article(page):
    assert hm.main_text(page.format(nav=NAV, story=STORY, footer=FOOTER), hm.DEFAULT_WEIGHTS) == STORY_TEXT


@pytest.mark.parametrize(
    "page",
    [
        '<body>{nav}<article>{story}</article><section class="comments"><article>I liked it a lot, thanks for writing all of it.</article></section></body>',
        '<body>{nav}<main>{story}<div class="related"><article>I liked it a lot, thanks for writing all of it.</article></div></main></body>',
        '<body class="has-sidebar">{nav}<article>{story}</article><aside><article>I liked it a lot, thanks for writing all of it.</article></aside></body>',
    ],
)
def test_articles_beside_the_main_one_stay_out(page):
    assert hm.main_text(page.format(nav=NAV, story=STORY), hm.DEFAULT_WEIGHTS) == STORY_TEXT


@pytest.mark.parametrize("page", ["", "<", "<p", "<<<>>>", '<a href="x>y</a>', "<!-- x", "</p></div>text", "<script>x", "<p>" * 3000 + "x", "&#0;&bogus;&#xD800;<b>q", "<div>" * 500 + "</div>" * 700, '<p class="' * 2000])
def test_broken_pages(page):
    assert isinstance(hm.main_text(page, hm.DEFAULT_WEIGHTS), str)


def test_nulls_and_long_pages(spark):
    text = " ".join(["A sentence of a long article, as there are many."] * 4000)
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", f"<article>{''.join(f'<p>{s}.</p>' for s in text.split('.'))}</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [tuple(r) for r in hm.extract(df, hm.train(df)).collect()]
    assert got[0] == (1, "u", "", 0) and got[1] == (None, None, "", 0) and got[2][3] > 190_000
    assert hm.extract(df.limit(0), hm.train(df.limit(0))).count() == 0


def nameless(page):
    """The page without the names that tell its parts."""
    return re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", page).replace('class="ad"', "")


def test_the_cut_decides(spark):
    """Held-out pages without telling names: labels by the cut differ from the signs of the costs and are right far more often."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = hm.train(pages)
    rows = [r["html"] for r in pages.sort("page_id").collect()]
    right = {"sign": 0, "cut": 0}
    for page in rows:
        truth = [b.good and not b.bad for b in hm.parse(page)[0]]
        blocks, parents = hm.parse(nameless(page))
        assert not any(b.good or b.bad for b in blocks)
        right["sign"] += [c > 0 for c in hm.costs(blocks, parents, weights)] == truth
        right["cut"] += hm.label(blocks, parents, weights) == truth
    assert right["cut"] > 0.95 * len(rows) and right["sign"] < 0.5 * len(rows)


PLAIN = """<body><div><a href=/>Home</a> <a href=/a>About us</a> <a href=/b>Contact</a></div><div><h2>Tides</h2><div>The sea rises and falls twice a day, and the
moon, which pulls at it, sets the pace of both.</div><div>Short line</div><div>Harbours keep tables of these times, so that ships can come in when the water is high enough for
them.</div></div><div>&copy; 2020 Harbour Office. All rights reserved.</div></body>"""


def test_a_page_without_telling_names(spark, data):
    weights = hm.train(spark.read.parquet(f"{data}/pages.parquet"))
    text = hm.main_text(PLAIN, weights)
    assert text.startswith("Tides The sea rises") and "Short line" in text and text.endswith("high enough for them.")


def test_labels_are_of_least_cost():
    """The labels of small pages against all labellings."""
    rng = random.Random(3)
    for _ in range(25):
        parts = "".join(rng.choice(["<div><p>", "</div><div>", "<li>", "</p>", "<h2>", "<a>", "</a>", "Some words, as they come.", "One ", "More of it "]) for _ in range(14))
        blocks, parents = hm.parse(f"<body>{parts}</body>")
        weights = [rng.uniform(-2, 2) for _ in hm.DEFAULT_WEIGHTS]
        scores = hm.costs(blocks, parents, weights)
        edges, nodes = hm.ties(blocks, parents)
        if not 0 < nodes <= 12:
            continue
        got = hm.min_cut(scores, edges, nodes)
        assert got[: len(blocks)] == hm.label(blocks, parents, weights)
        best = min(cost(scores, edges, nodes, side) for side in itertools.product((False, True), repeat=nodes))
        assert cost(scores, edges, nodes, got) == pytest.approx(best)


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x" + "</div>" * 100_000, "<div>y<p>" * 50_000, "<svg>" * 50_000 + "x" + "</b>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000 + "x", "<li>" * 100_000])
def test_time_is_linear_in_the_length(page):
    began = time.perf_counter()
    hm.main_text(page, hm.DEFAULT_WEIGHTS)
    assert time.perf_counter() - began < 5


def test_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", f"<article>{STORY}</article>", "t", 5)] * 3, "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in hm.extract(df, hm.DEFAULT_WEIGHTS).collect()] == [(1, "u", STORY_TEXT, len(STORY_TEXT))] * 3
