"""op4: labels drawn from documents, the model fitted to them, and pages of other templates."""

import os
import re
from html import unescape

import pytest

from annalist.llm import html_extract, queries
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
TEXT = "The ferry left the harbour at nine in the morning with forty people on board. It came back empty. The keeper of the light saw nothing, he said."


def page(body):
    return f"<html><body><nav><ul><li><a>Home</a></li><li><a>empty.</a></li></ul></nav><div class=ad>Buy shoes.</div>{body}<footer>(c) us</footer></body></html>"


def labelled(html, document=TEXT):
    nodes, pieces = html_extract.parse(html)
    texts = html_extract.own_texts(nodes, pieces)
    labels = html_extract.aligned_labels(nodes, texts, document)
    return labels and [(n.tag, y) for n, y, t in zip(nodes, labels, texts) if t or n.tag in ("article", "div")]


def test_labels_follow_the_document():
    a, b, c = (x.rstrip(".") + "." for x in TEXT.split(". "))
    got = labelled(page(f"<article><h1>Ferry</h1><p>{a}</p><p><b>{b}</b></p><div class=comment><p>He lies, I was there myself that very morning.</p></div><p>{c}</p></article>"))
    assert got == [("li", 0), ("li", 0), ("div", 0), ("article", 1), ("h1", 1), ("p", 1), ("p", 1), ("div", 0), ("p", 0), ("p", 1), ("footer", 0)]
    assert labelled(page("<article><p>Some other text that no document of ours has ever held before.</p></article>")) is None
    assert labelled(page(f"<div><p>{TEXT}</p></div>"))[3:] == [("div", 1), ("p", 1), ("footer", 0)]
    assert labelled("") is None and labelled("<p>x", "") is None


def test_the_model_is_fitted_to_the_corpus(spark):
    pages, documents = spark.read.parquet(f"{DATA}/pages.parquet"), spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None), (None, None, ""), (-2, "u", "<p>" + "word " * 20), (-2, "u", "<p>" + "word " * 20)], "page_id long, url string, html string")
    drawn = html_extract.training_pages(odd.unionByName(pages.select("page_id", "url", "html")), documents)
    assert 0.5 * pages.count() <= len(drawn) <= pages.count()
    assert html_extract.training_pages(pages.limit(0), documents) == html_extract.training_pages(pages, documents.limit(0)) == []
    model = html_extract.Model(aligned=drawn)
    assert model.clue["tag", "article"] > 2 and model.clue["tag", "footer"] < -2 and model.clue["tag", "nav"] < -2
    right = sum((p > 0.5) == bool(y) for nodes, labels in drawn for p, y in zip(model.marginals(nodes)[1:], labels[1:]))
    assert right / sum(len(y) - 1 for _, y in drawn) > 0.99


def test_all_pages_against_a_plain_extractor(spark):
    """Independent of parser and model: what stands between the tags of the article."""
    got = {r.page_id: r.text for r in queries.op4_html_tree(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inside = re.search(r"(?s)<article[^>]*>(.*)</article>", r.html)[1]
        bare = re.sub(r"</?b>", "", inside)
        assert got[r.page_id] == " ".join(unescape(re.sub(r"<[^>]*>", " ", bare)).split())


HELD_OUT = [
    ("<div id=top-nav><a>a</a><a>b</a></div><main><h1>T</h1><p>{0}</p><p>{1}</p></main><div class=sidebar><p>Popular now</p></div>", "T {0} {1}"),
    ("<header><p>Site</p></header><div class='post-content'><h2>T</h2><p>{0}</p><ul><li>{1}</li></ul></div><section class=comments><p>First comment here.</p></section>", "T {0} {1}"),
    ("<article><header><h1>T</h1></header><p>{0}</p><aside><p>See also this.</p></aside><p>{1}</p><form><p>Subscribe</p></form></article><footer><p>c</p></footer>", "T {0} {1}"),
    ("<div class=cookie-banner><p>We use cookies.</p></div><main><article><h1>T</h1><p>{0}</p><blockquote><p>{1}</p></blockquote></article></main>", "T {0} {1}"),
    ("<nav><p>Menu</p></nav><article><h1>T</h1><p>{1}</p><div class=comments><p>{0}</p><p>Another long comment by somebody who has read the text and does not agree.</p></div></article>", "T {1}"),
]


def test_templates_that_the_corpus_does_not_have(spark):
    drawn = html_extract.training_pages(spark.read.parquet(f"{DATA}/pages.parquet"), spark.read.parquet(f"{DATA}/documents.parquet"))
    model = html_extract.Model(aligned=drawn)
    parts = ("The council met for three hours on Monday and put off the vote on the bridge until the spring.", "Nobody spoke against it.")
    right = [html_extract.main_text(f"<html><body>{t.format(*parts)}</body></html>", model) == want.format(*parts) for t, want in HELD_OUT]
    assert sum(right) >= 4, right
