"""Operator 4: main text of HTML pages from flat text blocks.

A page is cut at block tags into flat blocks. Each block has its number of words and its link density (share of words in
links), those of the block before and after it, and three marks of its place: in an element that names itself boilerplate, in
an article, a heading. A decision tree, trained with Spark ML on the blocks of the small labelled pages below, says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boilerplate", "article", "heading")

# The labelled pages: {n} stands for n words, {ln} for a link of n words; a block that starts with + is main text.
LABELLED = (
    # an article element: paragraphs of any length, headings, lists, single links between paragraphs
    "<header>{l1}{3}</header><nav><ul><li>{l1}<li>{l2}<li>{l1}</ul></nav><article><h1>+{8}</h1><p>+{60}<p>+{45}{l4}<p>+{1}<p>+{30}<ul><li>+{2}<li>+{1}<li>+{14}</ul><p>+{l6}<p>+{120}</article><aside><h3>{3}</h3><p>{25}<p>{40}</aside><footer><p>{9}<p>{l2}{l2}</footer>",
    "<div class=cookie-notice><p>{18}<button>{1}</button></div><main><h1>+{5}</h1><p>+{3}<p>+{90}<h2>+{4}</h2><p>+{200}<p>+{12}{l4}<p>+{14}{l6}<p>+{7}<p>+{1}</main><div class=comments><h3>{2}</h3><p>{35}<p>{320}<p>{60}</div><footer>{7}</footer>",
    "<article><p>+{1}<p>+{1}<p>+{2}</article><div class=sidebar><p>{150}<p>{260}<p>{12}</div>", "<main><p>+{4}</main>", "<article><h2>+{2}</h2><p>+{15}<p>+{9}<div class=newsletter-form><p>{12}<form>{3}</form></div><p>+{6}</article>",
    "<article><h1>+{12}</h1><p>+{l9}<p>+{50}<p>+{l3}<p>+{20}<blockquote>+{35}</blockquote><p>+{5}{l6}</article><footer><p>{300}<p>{28}</footer>",
    # link lists in an article: related pages, tags, sharing
    "<article><h1>+{6}</h1><p>+{70}<p>+{30}<ul><li>{l5}<li>{l6}<li>{l4}</ul></article>", "<article><p>+{80}<div>{l2}</div><div>{l2}</div><div>{l3}</div><p>+{40}<p>+{4}</article>",
    "<main><div>{l1}</div><div>{l2}</div><div>{l3}</div><h1>+{7}</h1><p>+{110}<p>+{22}<div>{l8}</div><div>{l11}</div></main>",
    # pages without such marks: headings, bylines, text runs, short paragraphs
    "<div>{l1}</div><div>{l2}</div><div>{l1}</div><h1>+{7}</h1><p>+{90}<p>+{50}<p>+{16}<p>+{70}{l5}<h2>+{6}</h2><p>+{75}<p>+{9}<p>+{50}<p>+{11}<div>{l1}</div><div>{l1}</div><p>{6}",
    "<h1>+{5}</h1><p>+{4}<p>+{45}<p>+{12}<p>+{8}<p>+{6}<p>+{10}<p>+{8}", "<p>+{9}<p>+{7}<p>+{12}<p>+{8}<p>+{11}<p>+{6}<p>+{7}<p>+{8}", "<p>+{90}", "<p>+{6}<p>+{5}", "<p>+{14}", "<h1>+{4}</h1><p>+{11}<p>+{5}<p>+{3}<p>+{13}",
    "<ul><li>{l1}<li>{l1}<li>{l2}</ul><div>{3}{l6}</div><h1>+{9}</h1><p>+{35}<p>+{30}{l3}<p>+{25}{l5}<p>+{60}<p>+{20}<h3>{4}</h3><ul><li>{l7}<li>{l9}<li>{l6}</ul>",
    "<div>{l2}</div><div>{6}</div><div>{l1}</div><p>+{110}{l8}<p>+{95}<p>+{18}<p>+{55}<div>{4}{l16}</div><div>{6}{l24}</div><div>{3}{l12}</div>",
    "<div>{l3}</div><p>{3}</p><div>{l4}</div><p>+{65}<p>+{40}<p>+{30}<div>{l1}</div><h3>{5}</h3><div>{l4}</div><div>{l5}</div><p>{4}</p>",
    "<table><tr><td>{l1}<td>{l1}<td>{l2}</table><p>+{240}<p>+{9}<p>+{180}<p>+{5}<table><tr><td>{l2}<td>{2}<td>{l2}</table>",
    "<div>{l1}</div><h2>+{6}</h2><p>+{85}<p>+{75}<h2>+{3}</h2><p>+{20}<p>+{40}<div>{24}{l36}</div><div>{12}{l28}</div><div>{l2}</div><p>{8}",
    # elements that name themselves boilerplate, of any length
    "<div id=header><p>{12}<p>{l1}<p>{9}</div><div class=promo><p>{85}<p>{20}<p>{70}</div><h1>+{10}</h1><p>+{100}<p>+{44}<div id=footer><p>{240}<p>{400}<p>{50}</div>",
    "<form><p>{7}<p>{30}</form><p>+{35}<p>+{13}<p>+{28}<div class=advert><h4>{2}</h4><p>{18}</div><p>+{42}<p>+{9}<section class=comments><p>{270}<p>{8}</section>",
)

# tags as the HTML standard reads them, but that a quote that is never closed ends at the next >
_VALUE = r"""(?:"[^"]*"|'[^']*'|["'][^>]*|[^\s>"'][^\s>]*)"""
_TAG = re.compile(rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:[^a-zA-Z][^>]*)?>|<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*{_VALUE})?)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(rf"""([^\s/>][^\s/>=]*)(?:\s*=\s*({_VALUE}))?""")
_NAMING = {"class", "id", "role", "aria-label"}
#: a whole class, id or role of reader comments; an article in them or with such a name is no main text
_COMMENTS = re.compile(
    r"(?:(?:post|entry|article|user|reader|blog)[-_]?)?(?:comments?|disqus|replies|respond|responses)"
    r"(?:[-_]+(?:body|text|content|author|meta|reply|replies|thread|list|area|item|block|box|section|form|wrap|wrapper|container|inner|[0-9]+))*", re.I)
#: a whole class, id, role or label that says boilerplate; words of it are joined by - or _, or run together
_HINT = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|primary|secondary|left|right|post|entry|article|content|blog)[-_]?)?(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotions?|banner|nav|navbar|navigation|menus?|breadcrumbs?|"
    r"side[-_]?bar|aside|footer|masthead|header|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|subscribe|subscription|newsletter|signup|login|search|share|sharing|social|related|recommend(?:ed|ations?)|comments?|respond|"
    r"responses|disqus|widgets?|toolbar|pagination|pager|tags|copyright|legal|skip|outbrain|taboola|contentinfo|complementary|note[-_]?bar)"
    r"(?:[-_]?(?:box|bar|block|area|list|links?|items?|nav|menu|container|wrapper|wrap|inner|section|content|form|buttons?|widget|posts|articles|banner|notice|consent|policy|popup|modal|header|footer|title|icons?|message|text|top|bottom|left|right|[0-9]+))*", re.I)
_RAW = {"script", "style", "textarea", "title"}  # run to their end tag, or to the page's end without one
_DROPPED = {"noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "audio", "video", "map"}  # left out where they are closed
_SECTIONS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
_BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul button caption".split())
_LEAVES = {"p", "li", "dt", "dd", "option"}  # need no end tag
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


def _closed(page: str, name: str) -> dict[int, int]:
    """End of each closed element ``name`` by its begin; open tags without an end tag of their own are not in it."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I).finditer(page):
        if not m[1]:
            opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


def _names(attributes: str) -> list[str]:
    """The single classes, ids, roles and labels of a tag."""
    return [t for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in _NAMING and m[2] for t in html.unescape(m[2]).strip("\"'").split()]


def blocks(page: str) -> Iterator[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, linked words, boilerplate, article, heading) of the flat blocks of a page, in order.

    Boilerplate is decided by the innermost element that says either: a menu, header, footer, form or an element with such a name (a whole class
    or id), or an article or main element. Reader comments say it for all they hold: a comment may be an article element. A header
    within an article, without such a name, belongs to it. Text before the first body element is text, whether a head is closed or not.
    An element such as a video or a list of options is left out where it is closed; without an end tag only its tag is.
    Text that the page ends within a tag of is cut off. Time is linear in the page.
    """
    stack: list[tuple[str, bool, bool, bool]] = []
    opened: Counter[str] = Counter()
    dropped: dict[str, dict[int, int]] = {}
    bad = good = comments = False
    parts: list[str] = []
    linked: list[str] = []
    in_link, heading = 0, False
    at = 0

    def flush():
        text = " ".join("".join(parts).split())
        n = len(text.split())
        links = min(n, len("".join(linked).split()))
        parts.clear()
        linked.clear()
        return (text, n, links, bad, good, heading) if text else None

    while m := _TAG.search(page, at):
        if m.start() > at:
            piece = html.unescape(page[at:m.start()])
            parts.append(piece)
            if in_link:
                linked.append(piece + " ")
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in _RAW:
            if not closing:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in _DROPPED:
            if not closing and not m[3].endswith("/"):
                if name not in dropped:
                    dropped[name] = _closed(page, name)
                at = max(at, dropped[name].get(m.start(), at))
            continue
        if name == "br":
            parts.append(" ")
        if name in _BLOCKS and (x := flush()):
            yield x
        if name == "a":
            in_link = 0 if closing else 1
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = not closing
        elif name in _BLOCKS:
            heading = False
        if closing:
            while opened[name]:
                last, bad, good, comments = stack.pop()
                opened[last] -= 1
                if last == name:
                    break
        elif name in _BLOCKS and name not in _VOID and name not in _LEAVES:
            stack.append((name, bad, good, comments))
            opened[name] += 1
            named = [] if name in ("main", "html", "body") else _names(m[3])
            comments = comments or any(_COMMENTS.fullmatch(t) for t in named)
            if comments:
                bad = True
            elif name in ("article", "main"):
                bad, good = False, True
            elif any(_HINT.fullmatch(t) for t in named):
                bad = True
            elif name in _SECTIONS and not (name == "header" and good):
                bad = True
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    if x := flush():
        yield x


def features(found: list[tuple]) -> np.ndarray:
    """FEATURES of the blocks of one page."""
    words = np.array([b[1] for b in found], float)
    links = np.array([b[2] / b[1] for b in found])
    before, after = (np.concatenate([[0.0], x[:-1]]) for x in (words, links)), (np.concatenate([x[1:], [0.0]]) for x in (words, links))
    marks = [np.array([b[i] for b in found], float) for i in (3, 4, 5)]
    return np.stack([words, links, *before, *after, *marks], 1)


def labelled_rows(pages: Iterable[str] = LABELLED) -> list[tuple[float, ...]]:
    """FEATURES and label of every block of pages written as LABELLED is."""
    def words(m: re.Match) -> str:
        text = " ".join(["word"] * int(m[2]))
        return f" <a href=x>{text}</a>" if m[1] else text

    rows = []
    for page in pages:
        found = list(blocks(re.sub(r"\{(l?)(\d+)\}", words, page).replace("+ ", "+")))
        rows += [(*map(float, x), float(b[0].startswith("+"))) for x, b in zip(features(found), found)]
    return rows


def train_tree(spark: SparkSession, pages: Iterable[str] = LABELLED, depth: int = 8) -> list[tuple]:
    """A decision tree over FEATURES, as nodes (feature, threshold, left, right, label); feature -1 is a leaf. Node 0 is the root."""
    table = spark.createDataFrame(labelled_rows(pages), ", ".join(f"{c} double" for c in (*FEATURES, "label")))
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=1, seed=5).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table.coalesce(1)))
    nodes: list[tuple] = []

    def add(node) -> int:
        at = len(nodes)
        nodes.append(())
        if node.subtreeDepth() == 0:
            nodes[at] = (-1, 0.0, 0, 0, int(node.prediction()))
        else:
            nodes[at] = (node.split().featureIndex(), float(node.split().threshold()), add(node.leftChild()), add(node.rightChild()), 0)
        return at

    add(model._java_obj.rootNode())
    return nodes


def classify(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    """The label of each row of ``x``."""
    at = np.zeros(len(x), int)
    feature, threshold, left, right, label = (np.array(c) for c in zip(*tree))
    while (inner := feature[at] >= 0).any():
        goes_left = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
        at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
    return label[at]


def main_text(page: str | None, tree: list[tuple]) -> str:
    """Blocks of main text in page order, joined by one space; empty for a null page or one without text."""
    found = list(blocks(page)) if page else []
    if not found:
        return ""
    keep = classify(tree, features(found))
    return " ".join(b[0] for b, k in zip(found, keep) if k)


def extract_main_text(pages: DataFrame, tree: list[tuple] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Null html gives an empty text; very long pages are read whole, in linear time; null ids and repeated rows give rows of their own;
    other columns are left out; an empty table gives no rows.
    """
    nodes = train_tree(pages.sparkSession) if tree is None else tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), nodes) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
