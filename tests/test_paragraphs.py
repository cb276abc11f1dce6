"""Paragraphs are whole: with inner tags, attributes, unclosed ones, and none lost on the given pages."""

import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from lawloom.functions import text
from lawloom.plans.queries import QUERIES, table

SF = "/root/testdata/sf0.01"
ENDS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())


class Paragraphs(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.found, self.open, self.raw = [], False, False

    def handle_starttag(self, tag, attrs):
        self.raw = tag in ("script", "style")
        if tag in ENDS:
            self.open = tag == "p"
        if tag == "p":
            self.found.append("")
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.raw = False
        if tag in ENDS:
            self.open = False

    def handle_data(self, data):
        if self.open and not self.raw:
            self.found[-1] += data

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def plain(page):
    parser = Paragraphs()
    parser.feed(page.replace("&amp", "&amp;").replace("&amp;;", "&amp;"))
    parser.close()
    return [re.sub(r"\s+", " ", x).strip() for x in parser.found]


def test_paragraphs(spark):
    page = "<pre>no</pre><p>a <b>b</b> c<br>d</p>x<p class='y'>one<P ID=z><i>two</i>\n 3 &amp; 4<div>out</div><p/>five</section>out<p></p><p><script>var t='<p>no</p>';</script>s<!-- <p>no --></p><p>1 < 2<ul><li>out"
    want = ["a b c d", "one", "two 3 &amp; 4", "five", "", "s", "1 < 2"]
    rows = spark.createDataFrame([(page,), (None,), ("",)], "html string").select(text.paragraphs(F.col("html")).alias("p")).collect()
    assert [r.p for r in rows] == [want, [], []]


def test_no_paragraph_of_the_pages_is_lost(spark):
    pages = table(spark, SF, "pages")
    got = {r.page_id: r.p for r in pages.select("page_id", text.paragraphs(F.col("html")).alias("p")).collect()}
    assert got == {r.page_id: plain(r.html) for r in pages.collect()}
    n = sum(1 for p in got.values() for x in p if x)
    assert QUERIES["whole_paragraphs"](spark, SF).count() == n
