"""The article is whole, however its text is nested."""

import pytest

from lawloom.llm import html_text

LONG = "A sentence of some length, with a comma, and more words than a title has. Then another one, as long as the first."


@pytest.mark.parametrize("outer", ["article", "main", "div", "section"])
def test_what_lies_beside_the_longest_part_stays(outer):
    body = f"<div><p>1 {LONG}</p><p>2 {LONG}</p><p>3 {LONG} {LONG}</p></div>"
    items = "".join(f"<li>{k} {LONG}</li>" for k in range(12))
    quotes = "".join(f"<p>{k} {LONG}</p>" for k in range(12))
    cases = [
        (f"<h1>T</h1><p>lead</p>{body}", ["T", "lead", f"1 {LONG}", f"2 {LONG}", f"3 {LONG} {LONG}"]),
        (f"<h1>T</h1><p>Before.</p><ul>{items}</ul><p>After.</p>", ["T", "Before.", *(f"{k} {LONG}" for k in range(12)), "After."]),
        (f"<p>Before.</p><blockquote>{quotes}</blockquote><p>After, {LONG}</p>", ["Before.", *(f"{k} {LONG}" for k in range(12)), f"After, {LONG}"]),
        (f"<section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2>{body}</section>", ["One", LONG, "Two", f"1 {LONG}", f"2 {LONG}", f"3 {LONG} {LONG}"]),
    ]
    for inner, want in cases:
        page = f"<html><body><nav><ul><li><a href=/>Menu</a></ul></nav><div class=ad>Buy, now.</div><{outer}>{inner}</{outer}><footer>me</footer></body></html>"
        assert html_text.main_text(page).split("\n") == want


def test_selected_text_outside_the_article_stays():
    posts = "".join(f"<article><h2>Title {k}</h2><p>{LONG * n}</p></article>" for k, n in enumerate((9, 1)))
    assert html_text.main_text(f"<body><div><a href=/>All posts</a></div>{posts}</body>").split("\n") == ["Title 0", LONG * 9, "Title 1", LONG]


def test_paths_stay_apart_however_deep_they_are():
    """An article and a list of short lines, each below 60 elements of one kind: two paths, not one."""
    deep = lambda inner, first: f"<{first}>" + "<div>" * 60 + inner + "</div>" * 60 + f"</{first}>"
    page = html_text.scan(deep("<p>One, two, three. A long text, of many words, goes on here.</p>" * 4, "main") + deep("<p>More</p>" * 9, "section"))
    assert len({b.path for b in page.blocks}) == 2
    assert len(html_text.chosen_paths(page.blocks)) == 1
