"""HTML extraction on pages of many shapes."""

import random
import re
import time
from html import unescape

import pytest

from tidemark.llm.maintext import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>if (a < b) "</p>";</script></head><body{body}>
<header class="site"><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, for this, that and the other thing.</p></div>
{main}
<aside><p>Popular now, with many words, commas, and so on, and so forth.</p></aside><div class="sidebar"><p>Side text, also long, with commas, to tempt the score.</p></div>
<div id="comments"><h3>Comments</h3><div class="comment"><p>I liked it, very much, indeed, truly, really, honestly.</p></div></div><footer>&copy; us</footer></body></html>"""
TEXT = "<h1>Title &amp; more</h1><p>First   paragraph,\n with <b>bold</b> and a <a href='x'>link</a>.</p><p>Second one.<br>After a break.</p><ul><li>One</li><li>Two</li></ul>"
WANT = "Title & more\nFirst paragraph, with bold and a link.\nSecond one. After a break.\nOne\nTwo"


@pytest.mark.parametrize("body", ["", " class='has-sidebar no-comments'"])
@pytest.mark.parametrize("main", [f"<article>{TEXT}</article>", f"<main><div>{TEXT}</div></main>", f"<div class='content'>{TEXT}</div>", f"<div id='wrap'><div>{TEXT}<div class='share'>Share it</div></div></div>", f"<article>{TEXT}<form><p>Your mail</p><input></form><div class='related-posts'><ul><li><a href=1>Other</a></li><li><a href=2>More</a></li></ul></div></article>", f"<article><header>{TEXT}</header></article>"])
def test_shapes(main, body):
    assert main_text(PAGE.format(main=main, body=body)) == WANT


def test_broken_markup():
    assert main_text("<article><h1>T</h1><p><b>One.<br><p>Two.</p><p>Three & four &lt;five&gt;") == "T\nOne.\nTwo.\nThree & four <five>"
    assert main_text("<p>Cut off in a tag <a href='x") == "Cut off in a tag"
    assert main_text("<p>a < b, and 3 > 2") == "a < b, and 3 > 2"
    assert main_text("<!-- never closed <p>x") == ""
    assert main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert main_text("no markup at all") == "no markup at all"
    assert main_text("<form><p>All of it, the text too, is in a form.</p></form>") == "All of it, the text too, is in a form."
    assert main_text("<script>x</script>") == main_text("") == main_text(None) == ""


def test_depth_and_length():
    assert main_text("<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000) == "deep"
    long = "word, " * 200_000
    assert main_text(f"<article><p>{long}</p></article>") == long.strip()
    assert main_text("<article><p>x</p>" + "<a '" * 20000) == "x"


def test_table(spark):
    rows = [(1, "u", f"<article>{TEXT}</article>", "clash", 0), (None, None, None, "", 1), (1, "u", "", "", 2), (2, "v", "<p>ä 𝒳</p>", "", 3)]
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT)), (None, None, "", 0), (1, "u", "", 0), (2, "v", "ä 𝒳", 3)], key=str)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "A sentence of some length, with a comma, and then another clause that goes on. " * 3


@pytest.mark.parametrize("part", [
    '<section class="side-effects"><p>Headache, and more.</p></section>',
    '<p class="share-prices">Prices fell by 3 percent.</p>',
    '<div class="form-of-government"><p>A republic, federal.</p></div>',
    '<div class="commentary"><p>The notes say more.</p></div>',
    '<div class="search-history"><p>The search took years.</p></div>',
    '<section id="discussion"><h2>Discussion</h2><p>The results, as they are, say more than we hoped.</p></section>',
    '<section class="discussion-section"><p>We think so, all of us.</p></section>',
    '<section id="search"><p>The search went on for years.</p></section>',
    '<div id="form"><p>The form of the leaves varies, as a rule.</p></div>',
    '<section id="copyright"><h2>Law</h2><p>Rights of authors end 70 years after their death, in most countries of the world, and in some of them much later than that, as a rule of thumb that no court has yet overturned or confirmed.</p></section>',
    '<section id="tags"><h2>Tags</h2><p>Tags were sewn on by hand, one by one.</p></section>',
    '<section id="related"><h2>Related work</h2><p>Others have tried, and failed, before us.</p></section>',
    '<div class="side"><p>Its left side is flat.</p></div>',
    '<div class="menu"><p>The menu lists soup, bread and wine.</p></div>',
    '<div class="toc"><p>The contents are given in full.</p></div>',
    '<p class="trending">Prices are trending upwards.</p>',
    '<div class="paywall"><p>What follows is for those who pay, and it is long.</p></div>',
    '<p>Energy is <math><mi>E</mi></math> big.</p>',
    '<p>Energy is <search>E</search> big.</p>',
    '<p><a href="1">One source</a> <a href="2">Another source</a></p>',
    '<ol><li><a href="1">Smith, A. (2001). On things.</a></li><li><a href="2">Jones, B. (2002). On more.</a></li></ol>',
    '<table><tr><td><a href="1">Left</a></td><td><a href="2">Right</a></td></tr></table>',
])
def test_text_of_the_article_stays(part):
    got = main_text(PAGE.format(main=f"<article><h1>Title</h1><p>{LONG}</p>{part}<p>{LONG}</p></article>", body=""))
    inner = re.sub("<[^>]*>", "\n", re.sub("</?(?:math|mi|search)>", "", part).replace("</a> <a", "</a> <b></b><a")).split("\n")
    words = " ".join(x.strip() for x in inner if x.strip())
    assert " ".join(got.split()) == " ".join(f"Title {LONG} {words} {LONG}".split())


@pytest.mark.parametrize("part", ['<div class="share-buttons"><p>Share this, now.</p></div>', '<div class="ad-slot-2"><p>Buy it, now, today.</p></div>', '<ul class="tags"><li><a href="1">One</a></li><li><a href="2">Two</a></li></ul>', '<ul><li><a href="1">Next</a></li><li><a href="2">Home</a></li></ul>', '<div class="user-comments-list"><p>I agree, fully, with all of it.</p></div>', '<div id="sidebarLeft"><p>Some more, to read, here.</p></div>', '<div class="related-posts"><p>Read this, too, and that.</p></div>', '<div style="display:none"><p>Not to be seen, ever.</p></div>', '<div role="alert"><p>Mind this, please, now.</p></div>', '<div class="menu"><a href="1">File</a> <a href="2">Edit</a></div>', '<div id="search"><label>Search this site</label><input></div>', '<p class="copyright">Copyright 2020 by us.</p>', '<div class="toc"><ul><li><a href="#a">A first chapter</a></li><li><a href="#b">A second one.</a></li></ul></div>', '<section class="notices"><p>Mind the gap, please, at all times.</p></section>', '<section class="related-posts"><p>Read this, too, and that.</p></section>', '<button>Go</button>'])
def test_other_things_in_the_article_go(part):
    assert main_text(PAGE.format(main=f"<article><h1>Title</h1><p>{LONG}</p>{part}<p>{LONG}</p></article>", body="")) == f"Title\n{LONG.strip()}\n{LONG.strip()}"


def test_siblings_stay():
    two = main_text(PAGE.format(main=f"<main><article><p>{LONG}</p></article><article><p>Short, but its own.</p></article></main>", body=""))
    assert two == f"{LONG.strip()}\nShort, but its own."
    three = main_text(f"<body><div class='top-nav'><p>Menu.</p></div><div><p>{LONG}</p></div><div><p>{LONG}</p></div><div><p>The end.</p></div></body>")
    assert three == f"{LONG.strip()}\n{LONG.strip()}\nThe end."
    unequal = main_text(f"<body><div><p>{LONG * 4}</p></div><div><p>The end.</p></div><div><p>Copyright 2020 by us.</p></div></body>")
    assert unequal == f"{(LONG * 4).strip()}\nThe end."


def test_broken_pages_take_linear_time():
    began = time.perf_counter()
    assert main_text("<article><p>x</p>" + "</b></div></i>" * 100_000) == "x"
    assert main_text("<div class='a'>" * 100_000 + "<p>deep</p>") == "deep"
    main_text("<ul><li><ul>" + "<div>" * 30_000 + "<li></li>" * 30_000)
    main_text("<b>" * 50_000 + "<p>" * 50_000 + "</b>" * 50_000)
    assert time.perf_counter() - began < 12


@pytest.mark.parametrize("seed", range(3))
def test_against_pages_whose_text_is_known(seed):
    """Pages put together at random from blocks that are text, some with everyday names, and things that are not."""
    r = random.Random(seed)
    names = ["", "", " class='side'", " id='discussion'", " class='menu'", " id='search'", " class='toc'", " id='tags'", " class='trending'", " id='related'", " class='form'", " class='intro'", " id='part-3'"]
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma,", "delta", "&amp;", "é", "omega."]) for _ in range(n))
    junk = ["<nav><ul><li><a href=1>A</a></li><li><a href=2>B</a></li></ul></nav>", "<div class='ad'>Buy, buy, buy.</div>", "<aside><p>Also, see, this.</p></aside>", "<form><p>Mail?</p><input></form>", "<script>var a = '<p>x</p>';</script>", "<style>p{}</style>", "<div class='share-bar'><a href=1>Tweet</a></div>", "<!-- <p>no</p> -->", "<section id='comments'><p>Nice, really, nice, very nice.</p></section>", "<button>Go</button>"]
    for _ in range(150):
        blocks, page = [], []
        for _ in range(r.randint(1, 8)):
            text = words(r.randint(3, 40))
            blocks.append(" ".join(unescape(text).split()))
            at = r.choice(names)
            if at:
                text = f"{text} and this is the end of it."
                blocks[-1] = " ".join(unescape(text).split())
            page.append(r.choice([f"<p{at}>{{}}</p>", f"<section{at}><p>{{}}</p></section>", f"<div{at}><p>{{}}</p></div>"] if at else ["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<div><p>{}</p></div>", "<ul><li>{}</li></ul>", "<p><b>{}</b></p>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", "<div class='side-note-on-history'><p>{}</p></div>"]).format(text))
            if r.random() < 0.4:
                page.append(r.choice(junk))
        tag = r.choice(["article", "main"])
        html = f"<html><head><title>t</title></head><body><header><p>Head, er.</p></header>{r.choice(junk)}<{tag}>{''.join(page)}</{tag}>{r.choice(junk)}<footer><p>&copy; us, all of us.</p></footer></body></html>"
        assert main_text(html) == "\n".join(blocks), html
