"""Pages whose wrappers only look like what is never main text."""

import pytest

from langshift.llm import html_extract

BODY = "<p>" + "main words of the page " * 20 + "</p>"
WANTED = " ".join(BODY[3:-4].split())


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="no-sidebar">{BODY}</body>',
        f'<div class="has-sidebar">{BODY}</div>',
        f'<article class="no-comments">{BODY}</article>',
        f'<div class="overflow-hidden">{BODY}</div>',
        f"<form><h1></h1>{BODY}</form>",
        f'<div class="sidebar"><main>{BODY}</main></div>',
        f'<svg class="x"/>{BODY}',
        f"<object>{BODY}",
        f'<div class="sidebar">{BODY}</div>',
    ],
)
def test_wrapped_text_stays(page):
    assert html_extract.extract(page, html_extract.Weights()) == WANTED


@pytest.mark.parametrize("page", [f'<div class="comments">{BODY}</div>', f"<div hidden>{BODY}</div>", f'<div class="site-nav">{BODY}</div>', f"<form>{BODY}</form>", f"<script>{BODY}"])
def test_other_text_goes(page):
    assert html_extract.extract(page, html_extract.Weights()) == ""


P1, P2 = "First paragraph of the main text with a good many words in it.", "Second paragraph, which goes on for about as long as the first one does."
ARTICLE = f"<h1>The headline of it</h1><p>{P1}</p><p>{P2}</p>"
TEXT = f"The headline of it\n{P1}\n{P2}"
MENU = '<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>'
FOOT = "<footer><p>All about us and our footer</p></footer>"


@pytest.mark.parametrize(
    "page",
    [
        f'<html><body class="has-sidebar">{MENU}<article>{ARTICLE}</article>{FOOT}</body></html>',
        f'<body class="comments-open post-template">{MENU}<article class="post share-enabled">{ARTICLE}</article>{FOOT}',
        f'<body class="nav-menu-left">{MENU}<main class="search">{ARTICLE}</main>{FOOT}',
        f'<body class="overflow-hidden"><div class="hidden md:block flex">{ARTICLE}</div></body>',
        f'<body><div id="page" class="site"><div class="sidebar-left"><p>Side words here</p></div><div class="entry-content">{ARTICLE}</div></div></body>',
        f'<div class="modal-open menu-page-template">{ARTICLE}<div class="share-bar"><p>Share this page now</p></div></div>',
        f'<div id="comments-and-article"><article>{ARTICLE}</article><section id="comments"><p>What a page, says a reader</p></section></div>',
        f'<div class="widget"><div class="widget-area"><article>{ARTICLE}</article></div></div>',
        f'<form id="aspnetForm" action="/x"><div>{ARTICLE}</div><input name="q"></form>',
        f'<article>{ARTICLE}<form><label>Your mail address please</label></form></article>',
        f'<article>{ARTICLE}</article><div class="cookieBanner"><p>We use many cookies here</p></div>',
        f'<article>{ARTICLE}<div aria-hidden="true"><p>Not for reading at all</p></div></article>',
        f"<article><svg><title>icon</title></svg>{ARTICLE}<select><option>One<option>Two</select></article>",
        f'<article data-hidden="x" data-role="nav">{ARTICLE}</article>',
        f"<header><h2>Site name and motto</h2></header><article>{ARTICLE}</article><aside><p>Also read this one</p></aside>",
        f'<table><tr><td><div class="related-posts"><p>Another post here</p></div><td><article>{ARTICLE}</article></table>',
        f'<ul class="breadcrumb"><li>Home<li>News</ul><div role="main"><article>{ARTICLE}</article></div><div class="ad-300x250 adslot"><p>Buy a thing now</p></div>',
        f"<article>{ARTICLE.replace('first', '<b>first</b>').replace('<p>Second', '<p hidden>gone words</p><p>Second')}</article>",
    ],
)
def test_templates(page):
    assert html_extract.extract(page, html_extract.Weights(tags={html_extract.RARE: -0.5})) == TEXT


LONG = [f"Paragraph {n} has words enough to stand for one of an ordinary page, and says so." for n in range(6)]
PARTS = f"<h2>The headline of it</h2>{''.join(f'<p>{p}</p>' for p in LONG)}"
WHOLE = "\n".join(["The headline of it", *LONG])
REMARKS = '<section id="comments"><h3>Comments</h3>' + "".join(f'<article class="comment"><p>Reader {n} writes at length about all this and about a good many other things too.</p></article>' for n in range(20)) + "</section>"
SIDE = '<div class="sidebar"><h3>Other pages</h3><ul><li><a href="/x">Elsewhere on this site</a></li></ul></div>'
COOKIES = '<div class="cookie-notice"><p>We use cookies and ask you to agree to that before you go on.</p></div>'


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="right-sidebar">{PARTS}</div>',
        f'<div class="content-sidebar-wrap">{PARTS}</div>',
        f'<body>{MENU}<div class="content-sidebar">{PARTS}{SIDE}</div>{FOOT}</body>',
        f'<div class="widget-content">{PARTS}</div>',
        f'<div class="widget Blog" id="Blog1">{PARTS}</div>',
        f'<form id="form1" action="/x"><div>{PARTS}</div><input name="q"></form>',
        f'<section class="social">{PARTS}</section>',
        f'<div id="search-page">{PARTS}</div>',
        f'<div class="cookie-article">{PARTS}</div>',
        f'<div class="notice-content">{PARTS}</div>',
        f'<div class="content-sidebar-wrap"><div class="content">{PARTS}</div>{SIDE}</div>{REMARKS}',
        f'<div class="sidebar-wrapper"><div class="widget-area">{PARTS}{REMARKS}</div></div>',
        f"<div id=page>{COOKIES}{MENU}<div class=entry>{PARTS}</div>{SIDE}{REMARKS}</div>",
        f'<div class="newsletter-post">{PARTS}</div><div class="share-buttons"><p>Share it</p></div>',
        f'<form><div class="related-content">{PARTS}</div>{SIDE}</form>',
        f'<div class="promotion-page">{MENU}{PARTS}</div>{COOKIES}',
        f'<table class="menu-table"><tr><td>{PARTS}</td><td>{SIDE}</td></tr></table>',
        f'<div role="search"><input name="q"></div><div class="sponsored-article">{PARTS}</div>',
        f'<main><div class="content-sidebar">{PARTS}</div>{SIDE}</main>{REMARKS}',
        f"<article class='post'>{PARTS}{REMARKS}</article>",
        f"{REMARKS}<article>{PARTS}</article>",
        f'<div class="ad-page">{PARTS}<div class="ad"><p>Buy this and that</p></div></div>',
        f'<div class="toolbar-page"><div class="social-stream">{PARTS}</div></div><div class="popup"><h2>Subscribe</h2><p>Your mail, please</p></div>',
        f'<div class="site-banner"><h3>The site</h3></div><div class="widget">{PARTS}</div>',
        f'<div class="comment-page"><h1>The headline of it</h1>{PARTS.partition("</h2>")[2]}</div>',
        f'<div class="breadcrumb-page">{PARTS}</div><div class="related"><h2>Related</h2><p>{"teaser words " * 9}</p></div>',
        f'<article class="comment">{PARTS}</article>',
    ],
)
def test_no_name_alone_removes_a_page(page):
    assert html_extract.extract(page, html_extract.Weights(words={html_extract.RARE: 1.0}, tags={html_extract.RARE: -0.5})) == WHOLE


@pytest.mark.parametrize(
    "opening",
    ['<p class="lead>', "<p class='lead>", '<p class="lead\n', '<p class="a"id="b">', '<p title="a > b">', '<p data-x="<b>it\'s</b>">', '<p onclick=f(1<2)>', '<p class="x', '<p title=\'say "it"\'>'],
)
def test_a_quote_that_never_closes_ends_with_its_tag(opening):
    page = f'<article>{opening}<b>{P1}</b></p><p><a href="/x">{P2}</a></p></article><div class="ad">Buy this</div>'
    assert html_extract.extract(page, html_extract.Weights(words={html_extract.RARE: 1.0}, tags={html_extract.RARE: -0.1})) == f"{P1}\n{P2}"


def test_short_articles_outside_keep_long_notices_away():
    notice = "".join(f'<p>Line {n} of a long notice on cookies that nobody has ever read to its end.</p>' for n in range(9))
    for tag in ("article", "main"):
        page = f'<{tag}><p>A short piece of news for you.</p></{tag}><div class="cookie-notice"><h2>Cookies</h2>{notice}</div>'
        assert html_extract.extract(page, html_extract.Weights(words={html_extract.RARE: 1.0}, tags={html_extract.RARE: -0.1})) == "A short piece of news for you."


def seconds(page):
    import time

    start = time.perf_counter()
    found = html_extract.extract(page, html_extract.Weights(tags={"p": -0.1, "/p": -0.1}))
    return found, time.perf_counter() - start


@pytest.mark.parametrize("opening", ["<div>", "<b>", '<div class="menu">', '<p class="x>', "<p class='x\"> ", "<dt><table><b>", "<object>", "<li>", "<p><span>", "<form>"])
def test_depth_costs_no_more_than_length(opening):
    seconds(opening * 500 + BODY)
    _, short = seconds(opening * 10_000 + BODY)
    _, long = seconds(opening * 100_000 + BODY)
    assert long < 30 * short + 1.0


def test_a_long_page_is_read_whole():
    page = f"<nav>Menu</nav><article>{'<p>' + 'words of a long page ' * 50 + '</p>'}{('<p>' + P1 + '</p>') * 70_000}<p>the very end</p></article>"
    found, _ = seconds(page)
    assert len(page) > 4_500_000 and found.endswith("the very end") and found.count("\n") == 70_001
