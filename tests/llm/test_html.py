"""Main text of pages: messages against enumeration, reading against small pages, the model on pages it was not fitted on."""

import html
import itertools
import math
import random
import re
import time

import numpy as np
import pytest

from hornbeam.llm import common, html_labels, html_text, queries
from hornbeam.llm.html_tree import read_page


@pytest.fixture(scope="module")
def model():
    return html_text.default_model()


def blocks(source):
    return [t for t in read_page(source).text if t is not None]


def test_marginals_equal_enumeration():
    r = random.Random(3)
    for _ in range(25):
        n = r.randrange(1, 9)
        parent = [-1] + [r.randrange(i) if r.random() < 0.9 else -1 for i in range(1, n)]
        depth = []
        for p in parent:
            depth.append(0 if p < 0 else depth[p] + 1)
        kind = [r.randrange(2) for _ in range(n)]
        unary, edges = np.array([r.uniform(-3, 3) for _ in range(n)]), np.array([r.uniform(-2, 2) for _ in range(8)]).reshape(2, 2, 2)
        forest = html_text.Forest(np.array(parent), np.array(kind), np.array(depth))
        p, pairs, total = forest.marginals(unary, edges, expected=True)
        z, one, both = 0.0, np.zeros(n), np.zeros((2, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(u for u, s in zip(unary, y) if s) + sum(edges[kind[i], y[parent[i]], y[i]] for i in range(n) if parent[i] >= 0))
            z += w
            one += w * np.array(y)
            for i in range(n):
                if parent[i] >= 0:
                    both[kind[i], y[parent[i]], y[i]] += w
        assert np.allclose(p, one / z) and np.allclose(pairs, both / z) and math.isclose(total, math.log(z))


def test_reading():
    assert blocks("") == [] and blocks("  \n ") == [] and blocks("plain &amp; text") == ["plain & text"]
    assert blocks("<p>a<b>b</b> c<br>d<p>e</div>f<hr>g") == ["ab c d", "e", "f", "g"]
    assert blocks("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert blocks("<h1>a<h2>b</h2>c") == ["a", "b", "c"]
    assert blocks("x<script>if (a<b) '<p>no</p>'</script>y<style>p{}</style><!-- <p>no</p> -->z<title>t</title>") == ["xyz"]
    assert blocks("a<script>never closed <p>b</p>") == ["a"] and blocks("a<!-- never closed <p>b</p>") == ["a"]
    assert blocks("1 < 2 &lt;b&gt; &eacute;&#233;&#xe9; &nosuch; &am") == ["1 < 2 <b> ééé &nosuch; &am"]
    assert blocks("<p title='a>b' class=x>c</p><p title=it's>d</p><p class=\"open>e</p>f<foot") == ["c", "d", "e", "f"]
    assert blocks("a  b c") == ["a b c"]
    page = read_page('<div class="A" id=b role=\'c\'><a href="/x">link</a> text</div><input><a>no link</a>')
    assert page.names[1] == "A b c" and page.linked[2] == 4 and page.inputs[0] == 1 and page.linked[3] == 0


def test_reading_is_linear_in_odd_pages(model):
    began = time.time()
    for source in ("<div>" * 20_000 + "x", "<" * 200_000, "<a =\"" * 50_000, "</section>" * 50_000, "<!-" * 100_000, "<p>x" * 30_000, "&" * 200_000, "<b><li>" * 20_000):
        model.blocks([read_page(source)])
    assert time.time() - began < 120


def test_text_of_the_sample(spark, sf_dir, model):
    """Pages of the table hold their text in one article element; the model is not told so."""
    got = {r[0]: (r[1], r[2], r[3]) for r in queries.op11_tree_html(spark, sf_dir).collect()}
    for page_id, url, source in common.table(spark, sf_dir, "pages").select("page_id", "url", "html").collect():
        article = source[source.index("<article>") : source.index("</article>")]
        parts = (" ".join(html.unescape(re.sub(r"</?(b|br)>", "", x)).split()) for x in re.split(r"</?(?:p|h1|article)>", article))
        want = "\n\n".join(filter(None, parts))
        assert got[page_id] == (url, want, len(want))


def test_model_on_other_pages_and_names(model):
    def measure(m, sources):
        hit = false = missed = 0
        for source in sources:
            page = read_page(source)
            marks = [mark for mark, text in zip(page.mark, page.text) if text is not None]
            for (text, p), mark in zip(m.blocks([page])[0], marks):
                hit, false, missed = hit + len(text) * (p >= 0.5 and mark), false + len(text) * (p >= 0.5 and not mark), missed + len(text) * (p < 0.5 and mark)
        return hit / (hit + false), hit / (hit + missed)

    assert min(measure(model, html_labels.labelled_pages(150, 99))) > 0.98
    names = {k: v.split() for k, v in html_labels.NAMES.items()}
    known, new = ({k: v[i::2] for k, v in names.items()} for i in (0, 1))
    some, other = html_labels.Maker(7, known), html_labels.Maker(8, new)
    fitted = html_text.fit(some.page() for _ in range(500))
    assert min(measure(fitted, [other.page() for _ in range(150)])) > 0.94


PAGE = """<html><body><div id="cookie-banner"><p>We use cookies to make this site better. Please accept them.</p><button>Accept all</button></div>
<header class="site-header"><h1>The Daily Example</h1><nav><a href="/">Home</a> <a href="/w">World</a></nav></header>
<div class="layout"><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">First other story</a></li><li><a href="/2">Second other story</a></li></ul></aside>
<div class="article-body"><h1>Bridge opens &amp; closes</h1><p>The bridge opened on Monday, after two years of work. Hundreds of people came to see it.</p>
<div class="advert">Buy new shoes today, they are cheaper than ever before.</div><h2>Weather</h2><ul><li>It rained all morning.</li><li>The sun came out at noon.</li></ul>
<form class="newsletter"><label>Your address</label><input name="e"><button>Subscribe</button></form><p>On Tuesday it closed again, as the mayor said, for good reasons.</p></div></div>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I was there and it was lovely, really.</p></div></section>
<footer>&copy; 2020 The Daily Example. All rights reserved.</footer></body></html>"""
TEXT = (
    "Bridge opens & closes\n\nThe bridge opened on Monday, after two years of work. Hundreds of people came to see it.\n\nWeather\n\nIt rained all morning.\n\n"
    "The sun came out at noon.\n\nOn Tuesday it closed again, as the mayor said, for good reasons."
)


def test_edges(spark, model):
    rows = [(1, PAGE, "mine", 5), (1, PAGE, "mine", 5), (2, None, None, None), (3, "", "", 1), (None, "<script>x", "", 1), (4, "<p>" + "Long text, " * 100_000 + "end.</p>", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars long")
    out = html_text.extract(pages, model).collect()
    assert len(out) == 6 and [r["text"] for r in out[:2]] == [TEXT, TEXT] and all(len(r["text"]) == r["n_chars"] for r in out)
    assert [r["text"] for r in out[2:5]] == ["", "", ""] and out[5]["n_chars"] == len("Long text, ") * 100_000 + 4
    assert html_text.extract(pages.limit(0), model).collect() == []


def test_train_on_a_table(spark):
    rows = [(x,) for x in html_labels.labelled_pages(60, 5)] + [(None,), ("",)]
    table = spark.createDataFrame(rows, "html string")
    s = html_text.Settings(rounds=30)
    small = html_text.train(table, s=s)
    assert small.blocks([read_page("<article><p>One sentence here. And one more.</p></article>")])[0][0][1] > 0.5
    assert html_text.train(table.limit(0), s=s).blocks([read_page("x")])[0][0][0] == "x"
    assert html_text.train(table, s=html_text.Settings(max_pages=3, rounds=2)).tables
