"""Pages laid out by hand, in ways that the trainer doesn't know by name: articles in opaque, plain and nested containers, in sections, beside and around other parts."""

import time

import numpy as np
import pytest

from cardloom.llm import html_extract
from cardloom.llm.html_blocks import cut, vectors

P = ["Many readers have asked how the old bridge was built and why it has lasted so long.","The stones were cut in the quarry on the hill, and boats brought them down the river in spring.","Nobody knows the name of the builder, but the town still keeps his tools."]
T = "How the bridge was built"
body = f"<h1>{T}</h1>"+"".join(f"<p>{p}</p>" for p in P)
full = " ".join([T,*P])
nav = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>Sport</a></li></ul></nav>"
foot = "<footer>&copy; 2024 The Paper</footer>"
comments = "<div class='comments'><h3>Comments</h3><div class='comment'><span>anna</span><p>I walked over it last year and it was lovely.</p></div></div>"
links = "<div class='top-links'><a href='/x'>Home</a> <a href='/y'>About</a> <a href='/z'>Archive</a></div>"


def page(b):
    return f"<html><head><title>x</title></head><body>{b}</body></html>"


CASES = {
    "opaque": (page(f"<div class='c-7f3a'>{body}</div>"),full),
    "wrap": (page(f"<div id='wrap'>{body}</div>"),full),
    "wrap nav": (page(f"{nav}<div class='c-7f3a'>{body}</div>{foot}"),full),
    "wrap nav2": (page(f"{nav}<div id='wrap'>{body}</div>{foot}"),full),
    "comments": (page(f"<div class='c-7f3a'>{body}</div>{comments}"),full),
    "top": (page(f"{links}<div class='c-7f3a'>{body}</div>"),full),
    "sections": (page(f"<article><section><p>{P[0]}</p></section><aside class='related'><h3>Related</h3><ul><li><a href='/1'>Old mills</a></li></ul></aside><section><p>{P[1]}</p></section></article>"),P[0]+" "+P[1]),
    "sections long": (page(f"<article><h1>{T}</h1><section><p>{P[0]}</p><p>{P[2]}</p></section><aside class='related'><h3>Related</h3><ul><li><a href='/1'>Old mills</a></li></ul></aside><section><p>{P[1]}</p><p>{P[0]}</p></section></article>"),f"{T} {P[0]} {P[2]} {P[1]} {P[0]}"),
    "blog": (page(f"<div id='wrap'><div class='x1'><a href='/'>Home</a> <a href='/about'>About</a> <a href='/feed'>Feed</a></div><div class='x2'><h1>{T}</h1><p class='x7'>By Anna Miller, 3 May</p><p>{P[0]}</p><h2>The stones</h2><p>{P[1]}</p><table><tr><td>Length</td><td>120 metres</td></tr></table></div><div class='x3'><h3>Comments</h3><div><span>tom</span><p>I walked over it last year and it was lovely.</p></div></div><div class='x4'>&copy; 2024 Anna</div></div>"),f"{T} By Anna Miller, 3 May {P[0]} The stones {P[1]} Length 120 metres"),
    "article": (page(f"<article>{body}</article>"),full),
    "article aside": (page(f"{nav}<article><h1>{T}</h1><p>{P[0]}</p><aside class='ad'>Buy now.</aside><p>{P[1]}</p></article>{foot}"),f"{T} {P[0]} {P[1]}"),
    "main list": (page(f"<main><h1>{T}</h1><ul><li>{P[0]}</li><li>{P[1]}</li></ul><figure><img src=x><figcaption>The bridge in May.</figcaption></figure></main>"),f"{T} {P[0]} {P[1]} The bridge in May."),
    "p": (page(f"<p>{P[0]}</p>"),P[0]),
    "plain": (P[0],P[0]),
    "span": (page(f"{nav}<div class=q1><div class=q2><div class=q3>{body}</div></div></div>{foot}"),full),
    "nested": (page(f"<div><div><div>{nav}</div><div><section>{body}</section></div><div>{foot}</div></div></div>"),full),
    "table layout": (page(f"<table><tr><td>{links}</td><td>{body}</td></tr></table>"),full),
    "br": (page(f"<div id=top>{nav}<div id=c2><h1>{T}</h1>{P[0]}<br><br>{P[1]}<br><br>{P[2]}</div></div>"),full),
    "headings": (page(f"{nav}<div class='sc-1a'><h1>{T}</h1><h2>First</h2><p>{P[0]}</p><h2>Second</h2><p>{P[1]}</p><h2>Third</h2><p>{P[2]}</p></div>{foot}"),f"{T} First {P[0]} Second {P[1]} Third {P[2]}"),
    "quote": (page(f"<div class='css-9z'><h1>{T}</h1><p>{P[0]}</p><blockquote><p>{P[1]}</p></blockquote><pre>a = b + c</pre><p>{P[2]}</p></div>{comments}{foot}"),f"{T} {P[0]} {P[1]} a = b + c {P[2]}"),
    "header in": (page(f"<header><a href='/'>The Paper</a></header>{nav}<main class='k2'><section>{body}</section><section><p>{P[0]}</p></section></main><aside><h3>Popular</h3><a href='/1'>Old mills</a></aside>{foot}"),full+" "+P[0]),
    "form": (page(f"<div id='root'>{body}<form><label>Search</label><input name=q><button>Go</button></form></div>"),full),
    "cookie": (page(f"<div class='cookie-banner'><p>We use cookies to give you the best experience.</p><button>OK</button></div><div class='b2'>{body}</div>"),full),
    "german": (page(f"<div id='seite'><h1>Die Brücke</h1><p>Viele Leser haben gefragt, wie die alte Brücke gebaut wurde.</p><p>Die Steine kamen im Frühling mit Booten den Fluss herunter.</p></div><footer>Impressum | Datenschutz</footer>"),"Die Brücke Viele Leser haben gefragt, wie die alte Brücke gebaut wurde. Die Steine kamen im Frühling mit Booten den Fluss herunter."),
    "notitle": ("<div class='a1'><p>"+"</p><p>".join(P)+"</p></div>"," ".join(P)),
    "long": (page(f"{nav}<div class='z'>"+"".join(f"<p>{P[i%3]}</p>" for i in range(40))+f"</div>{foot}")," ".join(P[i%3] for i in range(40))),
}


@pytest.mark.parametrize("name", CASES)
def test_nothing_of_an_article_is_lost(name):
    html, want = CASES[name]
    assert html_extract.main_texts([html]) == [want]


@pytest.mark.parametrize(
    "html",
    ['<a b="' * 200_000, "</x " * 200_000, "<a " * 200_000, "<!" * 200_000, '<a ">"x' * 100_000 + '"', "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<!--" * 100_000, "<" * 500_000 + ">", '<a b="' * 100_000 + ">" + '<a b="' * 100_000],
    ids=lambda h: h[:12],
)
def test_unclosed_pages_take_time_in_proportion(html):
    began = time.monotonic()
    cut(html)
    assert time.monotonic() - began < 2


def test_long_pages_are_read_in_slices():
    blocks = cut("<nav><a>x</a></nav><div class=z>" + "<p>Some words of it, and more.</p><aside><h3>Related</h3><a href=x>y</a></aside>" * 150 + "</div>")
    whole = html_extract.scores([vectors(blocks)])[0]
    for cells in (1, 7, 100, 1000):
        assert np.allclose(html_extract.long_scores(blocks, cells=cells), whole, atol=1e-3)
    assert (whole > 0).any() and (whole < 0).any()


def test_shares_of_the_page():
    a, b, c = cut("<nav><a>xx</a></nav><div><p>1234</p><p>56<a>78</a></p></div>")
    assert (a.node.chars, a.node.linked, b.node.parent.chars, b.node.parent.linked) == (2, 2, 8, 2) and c.node.parent is b.node.parent
