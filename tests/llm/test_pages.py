import html
import re
import time

import numpy as np
import pytest

from fleetstream.llm import pages
from fleetstream.llm.common import table
from fleetstream.llm.crf import Sequences

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def crf(spark):
    return pages.train(table(spark, SF, "pages"))


def plain(page):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_whole_table(spark, crf):
    rows = table(spark, SF, "pages")
    source = {r.page_id: r for r in rows.collect()}
    got = pages.main_text(rows, crf).collect()
    assert len(got) == len(source)
    for r in got:
        assert r.text == plain(source[r.page_id].html) and r.n_chars == len(r.text) and r.url == source[r.page_id].url


def test_pages_without_article_elements(spark, crf):
    rows = table(spark, SF, "pages").limit(60).collect()
    blocks = [pages.leaf_blocks(r.html.replace("<article>", "<div>").replace("</article>", "</div>")) for r in rows]
    marks = crf.decode(Sequences.of([pages.features(b) for b in blocks]))
    at = right = 0
    for r, b in zip(rows, blocks):
        right += " ".join(x.text for x, m in zip(b, marks[at : at + len(b)]) if m) == plain(r.html)
        at += len(b)
    assert right >= 57


def test_unseen_texts_in_labelled_layouts(crf):
    found = [pages.leaf_blocks(p) for p in pages.labelled_pages(16)[48:]]
    marks = crf.decode(Sequences.of([pages.features(b) for b in found]))
    gold = np.concatenate([pages._marked(b) for b in found])
    assert (marks == gold).mean() > 0.97


def text_of(page):
    return [b.text for b in pages.leaf_blocks(page)]


def test_blocks():
    assert text_of("<p>a<b>b</b>c <i>d</i><p>e&amp;f&nbsp;&#65;<br>g") == ["abc d", "e&f A g"]
    assert text_of('<div>x<script>var t="</p><p>no";</script>y<!-- no <p> -->z</div>w') == ["xyz", "w"]
    assert text_of("<ul><li>one<li>two</ul>tail") == ["one", "two", "tail"]
    assert text_of('<p hidden>no</p><div style="display: none"><p>no</p></div><p title="a>b">yes</p>') == ["yes"]
    assert text_of("a < b <p>c</q></p>") == ["a < b", "c"]
    assert text_of("<p>unclosed <b>bold") == ["unclosed bold"]
    assert text_of("<textarea>no <p>no</textarea><select><option>no</select><p>yes") == ["yes"]
    assert text_of("<style>p{}") == [] and text_of(None) == [] and text_of("") == []
    assert text_of("<<<>>>&&&<p") == ["<<<>>>&&&"]


def test_odd_rows(spark, crf):
    long = "<article>" + "<p>A sentence of words, with a point.</p>" * 20000 + "</article>"
    rows = [(1, None, "u"), (2, "", "u"), (3, "   ", None), (None, "<article><p>Text of no id, as it is.</p></article>", "u"), (5, long, "u"), (5, long, "u"), (6, "<div>" * 3000 + "deep", "u")]
    frame = spark.createDataFrame([(i, u, h, "x") for i, h, u in rows], "page_id long, url string, html string, text string")
    got = pages.main_text(frame, crf).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[1].text == by[2].text == by[3].text == "" and by[1].n_chars == 0
    assert by[5].text == " ".join(["A sentence of words, with a point."] * 20000) and by[None].text == "Text of no id, as it is."
    assert pages.main_text(frame.limit(0), crf).count() == 0
    assert pages.train(frame.limit(0)).weights.any()


def test_only_hidden_elements_are_hidden():
    page = (
        '<article><p title="the hidden truth">one</p><p class="card hidden lg">two</p><p>before <math><mi>x</mi><mo>=</mo><mn>2</mn></math> after</p>'
        '<p data-x="display: none">three</p><p hidden>no</p><p HIDDEN="">no</p><p aria-hidden=true>no</p><p style="color:red; display : none">no</p><object><p>four</p></object></article>'
    )
    assert [b.text for b in pages.leaf_blocks(page)] == ["one", "two", "before x=2 after", "three", "four"]


def test_deep_nesting_is_linear():
    started = time.perf_counter()
    blocks = pages.leaf_blocks("".join(f'<div class="c{i}">w{i}' for i in range(20_000)))
    rows = pages.features(blocks)
    assert len(rows) == 20_000 and time.perf_counter() - started < 10
    assert max(map(len, rows)) < pages.NEAR + pages.NAMED + 10
