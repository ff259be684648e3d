"""Blocks against the standard library's parser, the tree on pages it has not seen, and odd markup."""

import time
from html.parser import HTMLParser

import numpy as np
import pytest

from tickloom.llm import html

TEXT = " ".join(["word"] * 30)


@pytest.fixture(scope="module")
def tree(spark):
    return html.train_tree(spark)


class Texts(HTMLParser):
    """All text but that of raw and left-out elements."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title", "textarea", "svg")
        self.out.append(" " if not self.skip and tag in ("p", "div", "li", "h1", "br") else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title", "textarea", "svg")
        self.out.append(" " if not self.skip and tag in ("p", "div", "li", "h1") else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def all_text(page):
    parser = Texts()
    parser.feed(page)
    parser.close()
    return " ".join("".join(parser.out).split())


PAGES = (
    "<p title=it's>B</p><p>Don't C</p>", "<p title='a > b'>B</p><p data-x=\"c > 'd\">C</p>", "<p class=a\"b>B <i title=>x</i><p>C", "<head><meta charset=utf-8><title>t</title><p>hello you<p>and me",
    "<head><title>t</title></head><body><h1>A</h1>b", "a<p>b<br>c &amp; d &#65; &lt;p&gt; &nbsp; e", "1 < 2 and 3 > 2<p>x <!-- no <p>no --> y<p>z", "<p/>a<br/>b<div/>c</div>d", "<P CLASS=x>A<SCRIPT>if (a<b) '</p>'</SCRIPT>B<style>p > a</style>C",
    "<p>a<textarea><p>no</textarea>b", "<svg viewBox='0 0 1 1'><title>no</title><path d=x /></svg>after",
)


@pytest.mark.parametrize("page", PAGES)
def test_against_the_parser(page):
    assert " ".join(b[0] for b in html.blocks(page)) == all_text(page)


def test_main_text_of_odd_markup(tree):
    for page in ("<p title=it's>{0} 1</p><p>Don't {0} 2</p>", "<head><title>t</title><p>{0} 1<p>{0} 2", "<p>{0} 1<video src=x><p>{0} 2", "<p>{0} 1<select><p>{0} 2", "<p>{0} 1<object><audio><p>{0} 2<canvas>",
                 "<article><p>{0} 1<video src=a><p>{0} 2</article><video>no</video>"):
        text = html.main_text(page.format(TEXT), tree)
        assert TEXT + " 1" in text and TEXT + " 2" in text and "no" not in text.split(), page
    assert html.main_text(f'<p class="x>{TEXT}</p>', tree) == TEXT
    assert html.main_text(f"<article><p>{TEXT}</p><p clas", tree) == TEXT
    assert html.main_text(f"<article><p>{TEXT}<script>var x = '<p>no</p>'", tree) == TEXT


def test_short_paragraphs_stay(tree):
    texts = [f"this is short paragraph number {i} of it" for i in range(8)]
    assert html.main_text("".join(f"<p>{t}</p>" for t in texts), tree) == " ".join(texts)


# written as LABELLED; the tree has not seen them
HELD_OUT = (
    "<nav>{l2} {l1} {l3}</nav><article><h1>+{10}</h1><p>+{75}<p>+{33}<p>+{l4}<p>+{52}<ul><li>+{6}<li>+{11}</ul></article><footer><p>{14}<p>{260}</footer>",
    "<div>{l1}</div><div>{l3}</div><h1>+{8}</h1><p>+{64}<p>+{18}<p>+{95}{l6}<p>+{7}<p>+{41}<div>{l2}</div><div>{l1}</div><p>{5}",
    "<ul><li>{l2}<li>{l2}<li>{l1}</ul><h1>+{5}</h1><p>+{40}<p>+{22}<h2>+{5}</h2><p>+{130}<p>+{27}<h3>{3}</h3><ul><li>{l6}<li>{l8}</ul>",
    "<h1>+{6}</h1><p>+{10}<p>+{9}<p>+{14}<p>+{6}<p>+{12}", "<main><p>+{20}<p>+{2}<p>+{170}<div class=comments><p>{300}<p>{4}</div></main><aside><p>{44}</aside>",
    "<div class=banner><p>{16}</div><p>+{55}<p>+{48}<p>+{10}<p>+{61}<div class=related-posts><p>{l7}<p>{l9}</div>", "<article><p>+{36}<div>{l3}</div><div>{l2}</div><div>{l2}</div><p>+{58}<p>+{3}</article>",
    "<div>{l2}</div><div>{4}</div><div>{l3}</div><p>+{88}<p>+{29}{l2}<p>+{73}<div>{5}{l20}</div><div>{2}{l15}</div>",
)


def test_held_out_error(tree):
    rows = np.array(html.labelled_rows(HELD_OUT))
    wrong = html.classify(tree, rows[:, :-1]) != rows[:, -1]
    assert len(rows) > 60 and wrong.mean() <= 0.05
    used = {html.FEATURES[n[0]] for n in tree if n[0] >= 0}
    assert {"words", "links", "links_before", "links_after", "words_before", "words_after", "boilerplate"} <= used


@pytest.mark.parametrize("piece", ["<div>", "</section>", "<video>", "<p class=", "<a b='c'", "<!--", "<p a=\"", "<", "<div class='comment'><p>x", "&amp;"])
def test_long_pages_in_linear_time(piece):
    begin = time.perf_counter()
    list(html.blocks("<div>" * 20000 + piece * 100000))
    assert time.perf_counter() - begin < 20


def test_long_text_is_whole(tree):
    page = "<article>" + "".join(f"<p>{TEXT} {i}</p>" for i in range(30000)) + "</article>"
    assert html.main_text(page, tree) == " ".join(f"{TEXT} {i}" for i in range(30000))
