"""Elements of pages against the standard library's parser, and odd pages."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import pytest

from quirelake.functions import markup
from quirelake.operators import crawl


class Tree(HTMLParser):
    """Elements as the standard parser's events give them: the same stack, other marks."""

    def __init__(self):
        super().__init__()
        self.open, self.found, self.texts, self.piece = [], [], [], ""

    def _flush(self):
        if self.piece.strip():
            self.texts.append(self.piece.strip())
        self.piece = ""

    def handle_starttag(self, tag, attrs, empty=False):
        self._flush()
        one = [tag, {k: v or "" for k, v in attrs}, len(self.texts), None]
        self.found.append(one)
        if empty or tag in markup.VOID:
            one[3] = len(self.texts)
        else:
            self.open.append(one)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        self._flush()
        if any(o[0] == tag for o in self.open):
            while True:
                one = self.open.pop()
                one[3] = len(self.texts)
                if one[0] == tag:
                    break

    def handle_data(self, data):
        if not (self.open and self.open[-1][0] in markup.RAW):
            self.piece += data

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def done(self, page):
        self.feed(page)
        self.close()
        self._flush()
        for one in self.open:
            one[3] = len(self.texts)
        return [tuple(f) for f in self.found], self.texts


def mine(page):
    elements, texts = markup.parsed(page, None)
    return [(e["name"], e["attrs"], e["first"], e["last"]) for e in elements], texts


def test_all_pages_equal_the_standard_parser(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r["html"]]
    assert len(pages) > 100
    for page in pages:
        assert mine(page) == Tree().done(page)


PARTS = [
    "<a href=/x.pdf>", "<a href='/a b'>", '<a title="1 > 0" href="/q?a=1&amp;b=2">', "<A HREF = /up >", "<a\nhref=\"/n\" href='/last'>", "<a>", "<a/>", "<a href=/e />", "</a>", "</A >", "</a x=1>", "<b>", "</b>", "<p>", "</p>", "<div class=a id=b>", "</div>", "<br>", "<br/>", "<img src=x>",
    "text", " a < b ", "1 > 0", "&amp;", "&nbsp;&eacute;", "&lt;i&gt;", "&#39;", "&#x6f22;", "&unknown;", "&copy", "<!-- <a href=/no> -->", "<!doctype html>", "<?php x ?>", "<script>var a='<a href=/no>';</script>", "<style>p>a{}</style>", "<ul><li>", "</li></ul>", "\n\t", "漢字", "<h1", "<", "</", "<title>T &amp; U</title>", "<a-b>", "<a href>", '<i x="y"z=w>',
]


def test_odd_pages_equal_the_standard_parser():
    rng = random.Random(12)
    for _ in range(3000):
        page = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25))) + " end>"
        assert mine(page) == Tree().done(page), page


def test_anchors_of_raw_pages(spark):
    page = "<a href=/f.pdf>A</a><a title='1 > 0' href=\"/g\">&nbsp;&eacute;t<b>e</b></a><p><a href=/h>open</p>after<a href=?x>  y\n z </a>"
    rows = crawl.extract_links(spark.createDataFrame([(1, "http://a.tw/", page)], "page_id long, url string, html string")).collect()
    assert [(r["place"], r["url"], r["label"]) for r in rows] == [(0, "http://a.tw/f.pdf", "A"), (1, "http://a.tw/g", "ét e"), (2, "http://a.tw/h", "open"), (3, "http://a.tw/?x", "y\n z")]


def test_long_and_deep_pages():
    page = "<p><a href=/x>" * 20_000 + "x" + "<b " + "a='1' " * 20_000 + ">" + "<" * 20_000
    elements, texts = markup.parsed(page, {"a"})
    assert len(elements) == 20_000 and all(e["last"] == len(texts) for e in elements)


@pytest.mark.parametrize("page", ["", None, "<", "no marks"])
def test_pages_without_elements(spark, page):
    rows = markup.with_elements(spark.createDataFrame([(page, "x")], "html string, texts_of string"), ["a"]).collect()
    assert rows[0]["elements"] == [] and rows[0]["texts"] == ([page] if page else [])


def test_schools_of_nested_lists(spark):
    page = """<details><summary>國中 段考</summary><p>x<ul><li class="a noanswer"><a href=http://n.edu.tw>N<b>甲</b></a><ul><li><a href=http://inner>內</a></li></ul></li>
      <li>none</li><li><span><a href="http://m.edu.tw">乙</a></span></li></ul></details><details><summary>高中</summary></details><summary>國小</summary>"""
    rows = crawl.school_list(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    first = [("junior", "N甲", "http://n.edu.tw", False), ("junior", "乙", "http://m.edu.tw", True)]
    # a summary that is in no element takes the first list of the page
    assert [(r["category"], r["name"], r["url"], r["has_answer"]) for r in rows] == [*first, *[("elementary", *f[1:]) for f in first]]
