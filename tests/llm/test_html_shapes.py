"""Main text of page shapes written by hand, of malformed pages, and of pages made to be slow."""

import random
import time

import pytest

from ledgerlake.llm.html_extract import main_text

P1 = "The first paragraph of the article has quite a few words in it, so that it looks like text."
P2 = "The second paragraph goes on about the same matter and has as many words, or even some more."
P3 = "A third one ends the article with a remark that nobody would have expected at its beginning."
BODY = f"<h1>Title</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>"
TEXT = ["Title", P1, P2, P3]
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li><li><a href=/b>Contact</a></li></ul></nav>"
FOOT = "<footer><p>All rights reserved by the people who made this page.</p></footer>"


def wrapped(attrs, tag="div", inner=BODY):
    return f"<html><body>{NAV}<{tag} {attrs}>{inner}</{tag}>{FOOT}</body></html>"


# Whatever the wrapper is called, the article is there.
WRAPPERS = [
    'class="site no-sidebar"', 'class="post comments-open"', 'class="has-banner"', 'class="article share-enabled"', 'class="legal-guide"',
    'class="with-sidebar content"', 'class="page comments-closed"', 'id="no-comments"', 'class="cookie-recipes"', 'class="menu-of-the-week"',
    'class="promo-article"', 'class="newsletter-issue"', 'class="nav-open"', 'class="is-popup"', 'class="overlay"', 'class="widget"', 'id="tags-explained"',
    'class="sponsored-story"', 'class="related-reading"', 'class="copyright-law"', 'class="social"', 'class="hide-footer"',
]


@pytest.mark.parametrize("attrs", WRAPPERS)
@pytest.mark.parametrize("tag", ["div", "section"])
def test_wrapper_names(attrs, tag):
    assert main_text(wrapped(attrs, tag)).split("\n\n") == TEXT


def test_two_nested_wrappers_with_names():
    page = f'<body class="has-sidebar"><div class="site no-sidebar"><div class="post comments-open">{BODY}</div></div></body>'
    assert main_text(page).split("\n\n") == TEXT


NOISE = [
    '<div class="comments"><p>I liked this a lot, said a reader with very many words indeed.</p></div>', '<div id="comments"><p>First!</p></div>',
    '<section class="comment-list"><p>A reader writes a comment that has many words in it.</p></section>', '<div class="sidebar"><p>Other stories to read.</p></div>',
    '<div class="cookie-notice">We use cookies.</div>', '<div class="related-posts"><p>You may also like this other story.</p></div>', '<aside><p>Aside.</p></aside>',
    '<div style="display:none"><p>Hidden words that nobody sees on the page.</p></div>', '<p style="color:red; visibility: hidden">Also hidden.</p>', "<div hidden>Hidden.</div>",
    '<div aria-hidden="true">Hidden.</div>', '<div role="complementary"><p>Beside it.</p></div>', "<form><p>Your name</p><input></form>", "<script>if (a < b) { x = '<p>no</p>' }</script>",
    "<style>p { color: red }</style>", "<!-- a comment with <p>markup</p> -->", '<div class="share-buttons"><a href=x>Share it</a></div>', "<template><p>No.</p></template>",
    '<div class="advert"><p>Buy this thing now, it is very cheap today and only today.</p></div>', '<ul class="breadcrumb"><li><a href=/>Home</a></li></ul>',
]


@pytest.mark.parametrize("noise", NOISE)
@pytest.mark.parametrize("tag", ["article", "div class=post", "main"])
def test_noise_inside_the_article(noise, tag):
    page = f"<html><body>{NAV}<{tag}><h1>Title</h1><p>{P1}</p>{noise}<p>{P2}</p><p>{P3}</p></{tag.split()[0]}>{FOOT}</body></html>"
    assert main_text(page).split("\n\n") == TEXT


def test_comments_longer_than_the_article():
    comments = "".join(f"<div class='comment'><p>Reader {i} says a lot of things here that are no part of the article at all.</p></div>" for i in range(30))
    for attrs in ("class=comments", "id=comments", "class='comment-list'"):
        page = f"<body><div class=post><h1>Title</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div {attrs}>{comments}</div></body>"
        assert main_text(page).split("\n\n") == TEXT


SHAPES = [
    # a second, shorter section
    (f"<main><section><h2>A</h2><p>{P1}</p><p>{P2}</p></section><section><h2>B</h2><p>Short.</p></section></main>", ["A", P1, P2, "B", "Short."]),
    (f"<body>{NAV}<div id=c><div class=part><p>{P1}</p><p>{P2}</p></div><div class=part><p>Short end.</p></div></div>{FOOT}</body>", [P1, P2, "Short end."]),
    # a paragraph that is one link, in the main element
    (f"<main><p>{P1}</p><p><a href=x>Read the whole report</a></p><p>{P2}</p></main>", [P1, "Read the whole report", P2]),
    (f"<article><header><h1>Title</h1></header><p>{P1}</p></article>", ["Title", P1]),
    (f"<header><h1>Site</h1></header><article><p>{P1}</p></article>", [P1]),
    (f"<article><p>{P1}</p><blockquote><p>{P2}</p></blockquote><table><tr><td>a<td>b</table></article>", [P1, P2, "a", "b"]),
    (f"<article><p>{P1}<br><br>{P2}</article>", [P1, P2]),
    (f"<article><pre>x = 1\n  y = 2</pre><p>{P1}</p></article>", ["x = 1 y = 2", P1]),
    (f"<article><ol><li>one<li>two <b>bold</b></ol><p>{P1}</p></article>", ["one", "two bold", P1]),
    (f"<article><p>{P1}</p><figure><img src=x><figcaption>A caption.</figcaption></figure></article>", [P1, "A caption."]),
    (f"<ARTICLE><P>{P1}</P></ARTICLE>", [P1]),
    (f"<article><p>a &lt;b&gt; &amp;amp; &copy; &#x41;&#66; {P1}</article>", [f"a <b> &amp; © AB {P1}"]),
    # what HTML takes for a comment, and what is never ended
    (f"<article><p>{P1}</p><![foo[x]]><p>{P2}</p></article>", [P1, P2]),
    (f"<article><p>{P1}</p><![ x ><p>{P2}</p></article>", [P1, P2]),
    (f"<article><p>{P1}</p><!foo bar><?php x ?><p>{P2}</p></article>", [P1, P2]),
    (f"<article><p>{P1}</p><![CDATA[x]]><p>{P2}</p></article>", [P1, P2]),
    (f"<article><p>{P1}</p></article><!", [P1]),
    (f"<article><p>{P1}</p></article><!-- never ended <p>{P2}</p>", [P1]),
    (f"<article><p>{P1}</p></article><a href='x", [P1]),
    (f"<article><p>{P1}</p><!--><p>{P2}</p></article>", [P1, P2]),
    (f"<!DOCTYPE html [ <!ENTITY a 'b'> <!ELEMENT c (d)> ]><article><p>{P1}</p></article>", [P1]),
    (f"<!doctype html PUBLIC '-//W3C//DTD' 'x'><article><p>{P1}</p></article>", [P1]),
    (f"<article><p>1 < 2 and 3 > 2. {P1}</p></article>", [f"1 < 2 and 3 > 2. {P1}"]),
    (f"<article><p>{P1}</p></span></b></article></div>", [P1]),
]


@pytest.mark.parametrize("page, blocks", SHAPES)
def test_shapes(page, blocks):
    assert main_text(page).split("\n\n") == blocks


PIECES = [
    "<", ">", "<!", "<![", "<![foo[", "]]>", "<!--", "-->", "--!>", "<!DOCTYPE", "[", "]", "<?", "</", "<p", "<p>", "</p>", "<div class='no-sidebar", "'", '"', "=", "&", "&#", "&#x",
    "&amp", ";", "<script>", "</script", "<style>", "<title>", "<textarea>", "<svg/>", "<a href=x>", "</a>", "<b class=x>", "<br/>", "<table><tr><td>", "</table>", "\x00", "é", "퟿",
    "some words", " ", "\n", "<![ x", "<!ENTITY a 'b'", "<plaintext>", "<noscript>", "<article>", "</article>", "<main hidden>", "<h1>", "<li><li>", "&#0;", "&#x110000;", "<a b='<c>'>", "</ >", "<p/ >",
]


def test_malformed_pages_never_raise():
    r = random.Random(42)
    for _ in range(10_000):
        page = "".join(r.choice(PIECES) for _ in range(r.randint(1, 30)))
        assert isinstance(main_text(page), str)


@pytest.mark.parametrize("page", [
    "<b class=x>" * 50_000 + "</i>" * 50_000, "<div><i class=y><div>" + "<b class=x>" * 50_000 + "</i>" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, "<header>" * 50_000 + "x",
    "<p>a" * 50_000, "<ul>" * 20_000 + "<li>" * 50_000, "<br>" * 100_000, "<!--" * 50_000, "<![" * 50_000, "<!DOCTYPE [" * 20_000, "</" * 50_000,
], ids=range(11))
def test_many_tags_take_seconds(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 20
