"""Names of content elements don't make the text in them boilerplate."""

import pytest

from tickloom.llm import html

TEXT = " ".join(["word"] * 60)


@pytest.fixture(scope="module")
def tree(spark):
    return html.train_tree(spark)


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize("name", ["post hentry tag-news", "overflow-hidden", "has-sidebar", "responsive-wrap", "long-form", "with-comments entry"])
def test_content_names(tree, tag, name):
    page = f'<body><div class="site-header"><a>x</a></div><{tag} class="{name}"><p>{TEXT} 1<p>{TEXT} 2<p>{TEXT} 3</{tag}></body>'
    assert html.main_text(page, tree) == " ".join(f"{TEXT} {i}" for i in (1, 2, 3))


@pytest.mark.parametrize("name", ["sidebar", "site-header", "nav-menu", "related-posts", "newsletter-form", "cookie-notice x", "comments", "share-buttons widget"])
def test_boilerplate_names(tree, name):
    page = f'<article><p>{TEXT} 1<div class="{name}"><p>Follow us now for more of it</div><p>{TEXT} 2</article>'
    assert html.main_text(page, tree) == f"{TEXT} 1 {TEXT} 2"


@pytest.mark.parametrize("name", ["sidebar", "notice", "site-footer", "comments"])
def test_long_boilerplate_goes(tree, name):
    long = "".join(f"<p>{' '.join(['word'] * n)} b" for n in (20, 260, 500))
    page = f'<body><article><p>{TEXT} 1<p>{TEXT} 2</article><div id="{name}">{long}</div></body>'
    assert html.main_text(page, tree) == f"{TEXT} 1 {TEXT} 2"


@pytest.mark.parametrize("outer,inner", [("comment-list", "comment-body"), ("comments", "x"), ("thread", "comment"), ("thread", "comment-content user-7"), ("post-comments", "post")])
def test_comments_are_no_articles(tree, outer, inner):
    page = f'<main><p>{TEXT} 1<p>{TEXT} 2</main><div class="{outer}"><article class="{inner}"><p>{TEXT} c</p><div><p>{TEXT} d</div></article></div>'
    assert html.main_text(page, tree) == f"{TEXT} 1 {TEXT} 2"
