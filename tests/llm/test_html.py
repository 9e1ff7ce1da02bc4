import time
from html.parser import HTMLParser

import pytest

from cardloom.llm import html_extract, html_training
from cardloom.llm.html_blocks import cut, vectors

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">alpha</a></li><li><a href="/b">beta</a></li></ul></nav><div class="ad">Buy the thing now.</div>
<article><h1>Title of it</h1><p>First &amp; <b>fo</b>remost,   words\nhere.<p>Second<br>line is here.</p></article>
<footer>&copy; site</footer></body>"""


def test_blocks():
    texts = [b.text for b in cut(PAGE)]
    assert texts == ["T", "alpha", "beta", "Buy the thing now.", "Title of it", "First & foremost, words here.", "Second", "line is here.", "© site"]
    assert cut(None) == [] and cut("") == [] and [b.text for b in cut("a < b <p title='x>y'>c")] == ["a < b", "c"]
    assert [b.text for b in cut("x<!-- open <p>y")] == ["x"]


@pytest.mark.parametrize(
    "tag",
    ['<svg class="i"/>', "<svg/>", "<svg-icon name=x></svg-icon>", "<video-player>", "<template-x>", "<iframe src=x>", "<object>", "<audio>", "<svg>", "</svg>", "<svg>x</svg>", "<select><option>x</select>", '<svg title="a>b">x</svg>'],
)
def test_an_opaque_element_ends_where_it_ends(tag):
    texts = [b.text for b in cut(f"<article><p>A {tag} b</p><p>more</p></article>")]
    assert " ".join(texts) == "A b more"
    assert [b.path[0][0] for b in cut(f"<article>{tag}<p>A</p></article>")] == ["article"]


def test_formulas_stay_and_open_scripts_run_to_the_end():
    assert [b.text for b in cut("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><p>A<math/> b")] == ["So x=2 holds", "A b"]
    assert [b.text for b in cut("<p>A</p><script>var x; <p>no</p>")] == ["A"]
    assert len(cut("<p>a<svg>" * 20000)) == 20000


def test_held_out_pages():
    assert html_training.accuracy(pages=150, seed=1234) > 0.97


@pytest.mark.parametrize("name", ["sidebar", "comments", "newsletter"])
def test_article_without_its_surroundings(name):
    page = PAGE.replace("<footer>", f'<div class="{name}"><p>Something else said.</p></div><footer>')
    assert html_extract.main_texts([page]) == ["Title of it First & foremost, words here. Second line is here."]


def test_pages_of_the_tables(spark):
    """Every page of the small table gives its article element's text."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()
    texts = html_extract.main_texts([r.html for r in rows])
    for r, t in zip(rows, texts, strict=True):
        assert t == " ".join(b.text for b in cut(r.html) if any(x[0] == "article" for x in b.path)), r.page_id


class ArticleReader(HTMLParser):
    """Text of article elements by the standard library's parser."""

    INLINE = {"a", "b", "i", "em", "strong", "span", "code", "small", "u", "sub", "sup", "mark"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def edge(self, tag):
        if tag not in self.INLINE:
            self.parts.append(" ")

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.edge(tag)

    def handle_endtag(self, tag):
        self.edge(tag)
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_pages_of_the_tables_by_another_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()
    for r, t in zip(rows, html_extract.main_texts([r.html for r in rows]), strict=True):
        reader = ArticleReader()
        reader.feed(r.html)
        reader.close()
        assert t == " ".join("".join(reader.parts).split()), r.page_id


def test_deep_pages_take_time_and_memory_in_proportion():
    began = time.monotonic()
    blocks = cut("<div class='x y'><b>" * 50_000 + "<article><p>deep</p>" + "</i></span>" * 50_000 + "<p>end")
    assert [b.text for b in blocks] == ["deep", "end"] and len(blocks[0].path) == 50_002
    assert vectors(blocks).shape[0] == 2
    assert len(cut("<div>x" * 50_000)) == 50_000 and len(cut("<p><a>x" * 50_000)) == 50_000
    assert time.monotonic() - began < 30


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (1, "u", "", 2), (None, "u", PAGE, 3), (4, "u", "<article>" + "<p>Some words of it.</p>" * 3000 + "</article>", 4)], "page_id long, url string, html string, n_chars int")
    rows = html_extract.extract(pages).collect()
    assert [r.text for r in rows[:2]] == ["", ""] and rows[2].text.startswith("Title of it")
    assert all(r.n_chars == len(r.text) for r in rows) and rows[3].n_chars == 3000 * 18 - 1
    assert html_extract.extract(pages.limit(0)).count() == 0
