"""Path scores decide what an article is; broken markup takes time in proportion to its length."""

import random
import time

import pytest

from lawloom.llm import html_text

TEXT = "A sentence of some length, with a comma, and more words than a title has. Then another one, as long as the first."
PLAIN = "<body><div><div>Jump to the end</div><div>Today is a fine day</div></div><div><div><h1>Head</h1>" + f"<p>{TEXT}</p>" * 3 + "</div></div><div><div>All rights kept by us</div></div></body>"


def test_neutral_scores_change_pages_without_telling_names(monkeypatch):
    assert html_text.main_text(PLAIN) == "\n".join(["Head", TEXT, TEXT, TEXT])
    monkeypatch.setattr(html_text, "path_scores", lambda found: {b.path: 1.0 for b in found})
    assert html_text.main_text(PLAIN).split("\n")[:2] == ["Jump to the end", "Today is a fine day"]


@pytest.mark.parametrize("piece", ["<a", "<i x>a", '<a ">', "<div>a", "<li>a<ul>", '<a href="', "<p><b>x", "<td>x", "<!--x", "<a b='>"])
def test_a_long_page_of_broken_markup(piece):
    html_text.main_text(piece * 100)
    took = []
    for n in (30_000, 120_000):
        start = time.process_time()
        html_text.main_text(piece * (n // len(piece)))
        took.append(time.process_time() - start)
    # Four times the page, far from sixteen times the time.
    assert took[1] < 9 * took[0] + 0.2


@pytest.mark.parametrize("page", ['<p data-testid="share">Kept, all of it.</p>', '<p data-id="ad">Kept, all of it.</p>', "<article><header><h1>Kept, all of it.</h1></header></article>", "<p>Kept,  all\n of it.<p hidden>No.</p><p style='display: none'>No.</p><div role=search>No.</div>"])
def test_whole_attribute_names_and_hidden_text(page):
    assert html_text.main_text(f"<body>{page}</body>") == "Kept, all of it."


def slow_select(page):
    """``select`` by its docstring, with whole lists of ancestors."""
    paths = html_text.chosen_paths(page.blocks) if page.blocks else set()

    def around(e):
        return [e] if not e else [e, *around(page.parent[e])]

    content = [b for b in page.blocks if b.path in paths]
    out = []
    for b in page.blocks:
        chain = around(b.element)
        at = next((e for e in chain if any(e in around(c.element) for c in content)), None)
        part = chain[max(0, chain.index(at) - 1)] if at is not None else None
        if b.path in paths:
            out.append(b)
            continue
        own = [b] if part == at else [x for x in page.blocks if part in around(x.element)]
        links = sum(x.linked for x in own) >= html_text.LINKED * sum(len(x.text) for x in own)
        named = any(page.hinted[e] for e in chain[: chain.index(at)])
        near = any(c.element == at or (page.parent[c.element] == at and c.element) for c in content)
        text = page.tag[part] == "h1" if page.tag[at] in ("", "html", "body") else page.tag[part] in html_text.TEXT_TAGS
        if not links and not named and (page.whole[at] or near or text):
            out.append(b)
    return out


def test_selection_as_by_brute_force():
    rng = random.Random(11)
    tags = ["div", "p", "section", "article", "h1", "h2", "ul", "li", "blockquote", 'div class="ad"', "span", "a", "main", "b", "td", "table"]
    seen = set()
    for _ in range(400):
        markup = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags).split()[0]}>", "few words ", TEXT]) for _ in range(rng.randrange(1, 60)))
        page = html_text.scan(markup)
        got = html_text.select(page)
        assert [id(b) for b in got] == [id(b) for b in slow_select(page)], markup
        seen.add(len(got) < len(page.blocks))
    assert seen == {True, False}
