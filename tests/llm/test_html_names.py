"""Pages whose article stands under names, attributes and elements that only look like boilerplate."""

import random

import pytest

from readloom.llm.html_text import main_text

WORDS = "river stone market history widget theory price valley share social engine window water metal paper garden winter".split()
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/about">About us</a></li></ul></nav>'
FOOT = '<footer><p>Copyright, all rights reserved, by the owner of these pages, of course</p></footer>'


def paragraph(draw):
    return " ".join(draw.choice(WORDS) for _ in range(40)).capitalize() + ", and so on."


def page(body, head=""):
    return f"<!doctype html><html><head><title>t</title>{head}</head><body>{MENU}{body}{FOOT}</body></html>"


def paragraphs(n, seed=1):
    draw = random.Random(seed)
    return [paragraph(draw) for _ in range(n)]


def test_self_closed_elements_swallow_nothing():
    a, b, c = paragraphs(3)
    for tag in ('<svg class="i"/>', '<svg viewBox="0 0 > 1"/>', "<iframe src='x'/>", '<canvas id="c" />', "<svg>", '<canvas class="open">'):
        assert main_text(page(f"<article><p>{a}</p><p>{tag}{b}</p><div><p>{c}</p></div></article>")).split("\n")[0] == a
    for tag in ('<svg class="i"/>', "<iframe src='x'/>", '<svg><path d="M0"/></svg>', "<script>if (a < b) {}</script>"):
        assert main_text(page(f"<article><p>{a}</p><p>{tag}{b}</p><p>{c}</p></article>")) == "\n".join((a, b, c))
    assert main_text(page(f"<article><p>{a}</p></article><script>var x = '{b}'")) == a


def test_values_of_attributes_hide_nothing():
    a, b = paragraphs(2)
    for attribute in ('title="the hidden valley"', "data-x='hidden'", 'alt="display: none of it"', 'title="class=sidebar"', 'aria-hidden="false"'):
        assert main_text(page(f"<article><p>{a}</p><p {attribute}>{b}</p></article>")) == f"{a}\n{b}"
    for attribute in ("hidden", 'hidden=""', 'style="color: red; display : none"', "aria-hidden=true", "HIDDEN"):
        assert main_text(page(f"<article><p>{a}</p><p {attribute}>{b}</p></article>")) == a


@pytest.mark.parametrize("name", ["social-history", "share-prices", "widget-theory", "history-of-sharing", "tag-soup", "market_share", "notice-period", "alert-levels", "cookie-recipes", "menu-design", "comment-culture"])
def test_topics_are_no_boilerplate(name):
    a, b, c, d = paragraphs(4)
    text = main_text(page(f'<article><p>{a}</p><section class="{name}"><h2>Title</h2><p>{b}</p><p>{c}</p></section><p id="{name}">{d}</p></article>'))
    assert text == "\n".join((a, "Title", b, c, d))


@pytest.mark.parametrize("name", ["site-footer", "sidebar-left", "comment-list", "share-buttons", "related-posts", "cookie-banner", "newsletter", "widget", "nav-menu", "mc-newsletter", "td-sidebar", "x-social-icons"])
def test_boilerplate_by_name_goes(name):
    a, b = paragraphs(2)
    filler = "Sign up for more, it is free" if name in ("mc-newsletter", "x-social-icons") else paragraphs(1, 7)[0]
    assert main_text(page(f'<div class="content"><p>{a}</p><p>{b}</p><div class="{name}"><p>{filler}</p></div></div>')) == f"{a}\n{b}"


def test_figures_and_formulas_belong_to_the_article():
    a, b = paragraphs(2)
    body = f"<article><p>{a}</p><figure><pre>x = 1</pre><figcaption>Listing one, by hand</figcaption></figure><p>{b} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math></p></article>"
    assert main_text(page(body)).split("\n") == [a, "x = 1", "Listing one, by hand", f"{b} x=2"]


def test_responses_of_readers_go():
    a, b = paragraphs(2)
    comments = "".join(f"<p>{p}</p>" for p in paragraphs(3, 5))
    for name in ("responses", "comments", "reader-responses-list"):
        kept = main_text(page(f'<main><article><p>{a}</p><p>{b}</p></article><div id="{name.split("-list")[0].removeprefix("reader-")}">{comments}</div></main>'))
        assert kept == f"{a}\n{b}"


def test_many_open_elements_take_linear_time():
    import time

    began = time.perf_counter()
    main_text("<svg>" * 20_000 + "<p>" + "x" * 1_000_000)
    main_text(("<canvas class='a'>" + "<p>some words here, and more</p>") * 5_000)
    assert time.perf_counter() - began < 20
