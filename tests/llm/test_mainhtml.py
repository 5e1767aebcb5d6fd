"""Main text with trained models: any element may hold the article's text, comments go, deep pages end in time."""

from __future__ import annotations

import os
import time

import duckdb
import pytest

from ledgerlens.llm import mainhtml

PAGES = "/root/testdata/sf0.01/pages.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(PAGES), reason="no driver tables")


@pytest.fixture(scope="module")
def given():
    return [r[0] for r in duckdb.connect().execute(f"select html from '{PAGES}' order by page_id").fetchall()]


@pytest.fixture(scope="module")
def model(given):
    return mainhtml.train(given)


SENTENCE = "Ererha in the tion of anes, and with thread it goes on for some words more."
PARTS = [f"<p>{SENTENCE} {k}.</p>" for k in range(10)]


def page(inner, around="article"):
    return f'<html><body><nav><ul><li><a href="/a">one</a></li></ul></nav><{around}><h1>A title here</h1>{"".join(PARTS[:5])}{inner}{"".join(PARTS[5:])}</{around}><footer>&copy; us</footer></body></html>'


@pytest.mark.parametrize(("inner", "text"), [
    (f"<div>{SENTENCE}</div>", [SENTENCE]), (f"<section>{SENTENCE}</section>", [SENTENCE]), (f"<ul><li>{SENTENCE}</li><li>short</li></ul>", [SENTENCE, "short"]),
    (f"<figure><img src=x><figcaption>{SENTENCE}</figcaption></figure>", [SENTENCE]), ("<h4>A lesser heading</h4>", ["A lesser heading"]),
    ("<dl><dt>Term</dt><dd>What it says</dd></dl>", ["Term", "What it says"]), (f"<table><tr><th>Year</th><th>Sum</th></tr><tr><td>1990</td><td>{SENTENCE}</td></tr></table>", ["Year", "Sum", "1990", SENTENCE]),
    ("<table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>", list("1234")), (f"<details><summary>More</summary>{SENTENCE}</details>", ["More", SENTENCE]),
    ("<address>Laan 1, Delft</address><blockquote>Said so.</blockquote><pre>x = 1</pre>", ["Laan 1, Delft", "Said so.", "x = 1"]),
    (f'<div class="comments"><p>{SENTENCE}</p></div>', []), (f"<section><h2>What readers say</h2><p>{SENTENCE}</p><div>{SENTENCE}</div></section>", []),
    (f'<div id="disqus_thread" class="comment-list"><article class="comment"><p>{SENTENCE}</p></article></div>', []), (f"<h3>3 Comments</h3><p>{SENTENCE}</p><h3>Further on</h3>", ["Further on"]),
    (f'<div class="ad">{SENTENCE}</div>', []), (f'<div class="newsletter-signup"><p>{SENTENCE}</p></div>', []),
])
def test_what_an_article_holds(model, inner, text):
    got = mainhtml.extract(page(inner), model).split("\n")
    assert got == ["A title here", *[f"{SENTENCE} {k}." for k in range(5)], *text, *[f"{SENTENCE} {k}." for k in range(5, 10)]]


def test_comments_behind_the_article(model):
    html = page("") .replace("</article>", "</article>" + f'<section class="comments"><h2>Comments</h2><article class="comment"><p>{SENTENCE}</p></article></section>')
    assert mainhtml.extract(html, model) == mainhtml.extract(page(""), model)


def test_the_cut_decides_on_doubtful_blocks(model):
    """A block that the classifier alone would drop stays between sure neighbours."""
    import numpy as np

    html = page("<p>a | b</p>", "div").replace("<h1>A title here</h1>", "")
    blocks = mainhtml.blocks(html)
    p = mainhtml.logistic(model, mainhtml.features(blocks))
    k = next(i for i, b in enumerate(blocks) if b.text == "a | b")
    doubtful = np.clip(p, 1e-6, 1 - 1e-6)
    doubtful[k] = 0.4
    kept = mainhtml.min_cut(-np.log(1 - doubtful), -np.log(doubtful), mainhtml._smoothness(blocks, 1.0))  # noqa: SLF001
    assert kept[k] and not kept[-1]


def test_given_pages_lose_and_gain_nothing(given, model):
    """On the given pages an article is what stands between its tags."""
    for html in given:
        body = html[html.index("<article>") : html.index("</article>")]
        want = "\n".join(b.text for b in mainhtml.blocks(body))
        assert mainhtml.extract(html, model) == want


@pytest.mark.parametrize("html", [
    "<div>" * 40_000 + "</span>" * 40_000 + "end of it all.", "<b>" + "<div>" * 20_000 + "</b>" * 20_000 + "end.", "<p>" + "<i>" * 20_000 + "x</i> y" * 20_000,
    "<article>" + "<div><p>Some text, it says.</p>" * 3_000 + "</div>" * 3_000 + "</article>", "<ul>" + "<li>one" * 20_000, "<p>" + "word " * 2_000_000,
])
def test_deep_and_long_pages_end_in_time(model, html):
    began = time.perf_counter()
    assert mainhtml.extract(html, model)
    assert time.perf_counter() - began < 20


def test_clashing_columns_and_repeated_rows(spark, given):
    rows = [(1, "u", given[0], "x", 7), (1, "u", given[0], "x", 7), (None, None, None, None, None), (2, "v", "<p>only", "y", 1)]
    got = mainhtml.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert len(got) == 4 and got[0] == got[1] and all(r["n_chars"] == len(r["text"]) for r in got)
