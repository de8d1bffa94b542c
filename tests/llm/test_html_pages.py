"""Pages that are deep, broken or hide what looks like markup."""

import time

import pytest

from hemiciclo.llm import html


@pytest.fixture(scope="module")
def chain():
    return html.default_chain()


SENTENCE = "A sentence of the page that is long enough to be one, and one more."


@pytest.mark.parametrize("inside", ["script", "style", "title"])
def test_an_end_tag_inside_hidden_text_is_none(inside, chain):
    page = f"<html><head><{inside}>var x = '</head><p>leaked words of the head</p>';</{inside}><meta></head><body><article><p>{SENTENCE}</p></article>"
    assert html.main_text(page, chain) == SENTENCE


def test_an_end_tag_inside_a_comment_is_none(chain):
    page = f"<head><!-- </head> <p>leaked</p> --></head><article><p>{SENTENCE}</p></article>"
    assert [b.text for b in html.blocks(page)] == [SENTENCE]


def test_hidden_containers_end_where_they_end():
    page = "<p>one</p><noscript><p>no</p><script>'</noscript>'</script></noscript><p>two</p><video><source><p>three</p><video>four"
    assert [b.text for b in html.blocks(page)] == ["one", "two", "three", "four"]


@pytest.mark.parametrize("page", [
    "".join(f"<div class='n{i} article a{i}'>x" for i in range(50_000)), "<span>" * 50_000 + "x" + "</section></p>" * 50_000,
    "<li><div>" * 25_000 + "x", "<video>" * 50_000, "<svg><g>" * 25_000 + "<text>x", "<p><b>x" * 50_000,
])
def test_deep_pages_take_time_in_proportion(page, chain):
    start = time.perf_counter()
    html.main_text(page, chain)
    assert time.perf_counter() - start < 12


def test_sets_are_shared_down_the_stack(chain):
    page = "".join(f"<div class='n{i} article a{i}'>x" for i in range(5_000))
    frames = [b.frame for b in html.blocks(page, chain.names)]
    assert len({id(f.names) for f in frames}) <= 2 and len({id(f.telling) for f in frames}) == 1


def test_features_of_nested_articles():
    page = "<main><section><article><header>a</header><p class='Body mainText'>b</article></section></main>"
    rows = [set(r) for r in html.page_features(page)[1]]
    assert {"article>header", "tag:main", "in:header", "leaf:header"} <= rows[0] and "article>section" not in rows[0]
    assert {"name:body", "name:main", "name:text", "article>p"} <= rows[1]
