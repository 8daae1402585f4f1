"""Texts that repeat what a pattern is tried on: time must grow with their length, not with its square."""

import time

import pytest

from tessera.llm import html_density, pii


@pytest.fixture(scope="module")
def field():
    return pii.train_field([])


@pytest.mark.parametrize("text", ["a" * 1_000_000 + " dot ", "a." * 500_000 + " dot ", "@" * 500_000, "a at " * 200_000 + " dot ", "a at " + "x." * 500_000 + " dot", "a[at]a" * 160_000 + " dot ", "1." * 50_000, "1a" * 50_000, "a at b.c " * 100_000, "a dot " * 200_000 + "at b.c", "a" * 1_000_000 + " at b.c", " at " + "b." * 400_000])
def test_pii_in_linear_time(text, field):
    began = time.time()
    assert pii.mask(text, pii.spans_of(text, field)[1]) is not None
    assert time.time() - began < 30


@pytest.mark.parametrize("page", ["<a " * 300_000, "<!" * 300_000, '<a ">"' * 100_000 + '"', "<a " * 300_000 + ">", "<!--x" * 100_000, "<a b='>" * 100_001])
def test_html_in_linear_time(page):
    began = time.time()
    html_density.main_text(page)
    assert time.time() - began < 30


def test_spelled_addresses_are_still_found(field):
    for text in ("write to joe (at) example.org now", "write to joe at example dot org now"):
        assert [k for k, _, _ in pii.spans_of(text, field)[1]] == ["email"]


WORDS = "<p>words of the article that are long enough to count as text, and more of them here</p>" * 5


@pytest.mark.parametrize("name", ["related", "search", "legal", "alert", "widget", "discussion"])
def test_an_article_keeps_what_a_class_alone_speaks_against(name):
    text = html_density.main_text(f"<body><nav><a href=x>menu item</a></nav><article>{WORDS}<div class={name}>kept words</div><p class={name}>kept line</p><div class={name}><a href=x>linked away</a></div></article></body>")
    assert "kept words" in text and "kept line" in text and "linked away" not in text


@pytest.mark.parametrize("tag", ["noscript", "object", "fieldset", "label"])
def test_an_article_keeps_elements_that_forms_have_too(tag):
    assert "kept words" in html_density.main_text(f"<body><article>{WORDS}<{tag}>kept words</{tag}></article></body>")
    assert "not kept" not in html_density.main_text(f"<body><article>{WORDS}<form><{tag}>not kept</{tag}></form></article></body>")


def test_an_unclosed_comment_or_tag_ends_the_page():
    assert html_density.main_text(f"<body>{WORDS}<!-- no end <p>not kept</p>").count("\n") == 4
    assert "not kept" not in html_density.main_text(f"<body>{WORDS}<!-- not kept")


COMMENT = "<p>I have read this with care, and there is a great deal to say about it that I have not seen said.</p>" * 4


@pytest.mark.parametrize("wrapped", ["<div>{}</div>", "<section><div>{}</div></section>", "<div><ul>{}</ul></div>"])
def test_a_short_article_beside_long_comments_without_a_name(wrapped):
    comments = wrapped.format("".join(f"<div><b>reader {k}</b>{COMMENT}</div>" for k in range(6)))
    article = "<h1>Headline</h1><p>A short article of some fifty words would do, but this one has fewer, and yet is what the page is there for.</p><p>It has a second line.</p>"
    text = html_density.main_text(f"<body><nav><a href=x>menu</a></nav><div><article>{article}</article></div>{comments}</body>")
    assert text.split("\n")[0] == "Headline" and text.endswith("It has a second line.") and "reader" not in text
    # without any name the densest part is all there is to go by, and an article of links is none
    assert "reader" in html_density.main_text(f"<body><div>{article}</div>{comments}</body>")
    links = "<article>" + "<a href=x>one of many teasers of other pages</a> " * 9 + "</article>"
    assert "reader" in html_density.main_text(f"<body>{links}{comments}</body>")


@pytest.mark.parametrize("page", ["<article>" * 30_000 + WORDS, "<div>" * 30_000 + f"<article>{WORDS}</article>" + "</div>" * 30_000 + f"<div>{COMMENT * 20}</div>", "<article>x</article>" * 30_000])
def test_nested_articles_in_linear_time(page):
    began = time.time()
    html_density.main_text(f"<body>{page}</body>")
    assert time.time() - began < 30
