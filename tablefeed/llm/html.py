"""The main text of web pages, from flat blocks of text and a decision tree.

A page is cut at block tags into flat blocks. Each block has a word count and a
link density, and so have its neighbours; besides, it lies inside some kind of
element. A small decision tree, grown here from a labelled table, says whether a
block belongs to the article ("Boilerplate Detection using Shallow Text
Features", Kohlschuetter and others, which this follows in its features).

Names of classes say where a container stands. On an element of text itself, a
paragraph or a heading, they only raise a doubt, which words and links settle; so
they do for all blocks of a page whose elements tell nothing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefeed.llm.common import table

# Elements of HTML by what they mean for text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SILENT_TAGS = frozenset(
    "script style noscript template iframe object svg math textarea head title canvas audio video "
    "button select".split()
)
RAW_TAGS = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
OUTER_TAGS = frozenset("nav header footer aside form menu dialog".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Elements that are a piece of text rather than hold a part of the page.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
#: Words in class, id or role of an element that isn't part of the article.
OUTER_NAMES = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advertisements?|advertising|banner|breadcrumbs?|comments?|cookies?|consent|"
    r"disqus|footer|form|header|hidden|login|masthead|menu|modal|nav|navbar|navigation|newsletter|"
    r"notices?|pagination|popup|promo|promoted|related|replies|reply|respond|share|sharing|sidebar|signup|"
    r"social|sponsor|sponsored|subscribe|tags|toolbar|topbar|widget|contentinfo|complementary|search)(?![a-z])"
)
#: And of one that is: it can hold such words besides.
MAIN_NAMES = re.compile(
    r"(?<![a-z])(?:article|articlebody|content|entry|main|maincontent|post|story|body)(?![a-z])"
)

#: Words that set even an article element apart, as a reader's comment can be one.
ASIDE_NAMES = re.compile(
    r"(?<![a-z])(?:comments?|repl(?:y|ies)|ads?|adverts?|promo|promoted|sponsored|related|sidebar|footer)(?![a-z])"
)

#: Names that tell the state of an element, not its part in the page.
STATE_NAMES = re.compile(
    r"\A(?:has|with|without|no|is)-|-(?:open|closed|enabled|disabled|allowed|layout|fixed|sticky|visible)\Z"
)
#: The head of an article that isn't in the article's element.
HEADLINE_NAMES = re.compile(r"\A(?:article|entry|post|story)-?header\Z")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW_TAGS) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)(?:>|\Z)"""
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(
    r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE
)
HIDDEN = re.compile(
    r"""(?<![\w-])hidden(?![\w-])|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""",
    re.IGNORECASE,
)


class Block(NamedTuple):
    text: str
    words: int
    linked: float  # share of the characters that are in links
    place: int  # one of the below


#: Inside an element that is apart from the article; outside the page's article
#: elements; on a page without such elements, or inside one but with a doubt; inside one.
APART, BESIDE, ANYWHERE, INSIDE = range(4)


class _Open(NamedTuple):
    tag: str
    main: int
    outer: int
    silent: int
    link: int
    doubt: int


CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def names_of(attrs: str) -> list[str]:
    """The names that an element bears; a label is one name."""
    names = []
    for kind, *values in NAMES.findall(attrs):
        value = CAMEL.sub("-", "".join(values)).lower().replace("_", "-").split()
        names += ["-".join(value)] if kind.lower() == "aria-label" else value
    return [n for n in names if not STATE_NAMES.search(n)]


def blocks_of(html: str) -> list[Block]:
    """The blocks that hold any text, in page order, in time linear in the page.

    Open elements are indexed by tag, so an end tag finds its start at once, and
    every element is closed once.
    """
    found: list[tuple[str, float, _Open]] = []
    has_main = False  # an element for the article is there
    stack = [_Open("", 0, 0, 0, 0, 0)]
    opened: dict[str, list[int]] = {}  # where each tag is open
    blocks = [0]  # where blocks are open
    text: list[str] = []
    link: list[str] = []

    def flush() -> None:
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                inside = " ".join(unescape(" ".join(link)).split()) if link else ""
                found.append((whole, len(inside) / len(whole), stack[-1]))
            text.clear()
            link.clear()

    def close(at: int) -> None:
        while len(stack) > at:
            opened[stack.pop().tag].pop()
        while blocks[-1] >= at:
            blocks.pop()

    for token in TOKEN.finditer(html):
        kind = token.lastgroup
        if kind == "text":
            top = stack[-1]
            if not top.silent:
                text.append(token[0])
                if top.link:
                    link.append(token[0])
            continue
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK_TAGS
        if block:
            flush()
        elif tag == "br":
            text.append(" ")
        if token["close"]:
            at = opened.get(tag)
            # a stray end tag inside a block closes nothing around the block
            if at and (block or blocks[-1] < at[-1]):
                close(at[-1])
            continue
        attrs = token["attrs"]
        if tag in VOID_TAGS or attrs.endswith("/") and not block:
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or block and stack[-1].tag == "p":
            # these end what is open of their own kind, and any block ends a paragraph
            ends = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            if blocks[-1] and stack[blocks[-1]].tag in (*ends, "p"):
                close(blocks[-1])
        top = stack[-1]
        names = names_of(attrs) if attrs and block and tag not in ("body", "html") else []
        headline = any(map(HEADLINE_NAMES.search, names))
        aside = any(map(ASIDE_NAMES.search, names)) and not headline
        # the header of an article holds its headline, whether tag or name says so
        apart = [n for n in names if OUTER_NAMES.search(n) and not (top.main and n.endswith("header")) and not headline]
        doubt = tag in TEXT_TAGS and bool(apart)
        named = bool(names) and not apart and any(map(MAIN_NAMES.search, names))
        main = tag in MAIN_TAGS or named
        outer = tag in OUTER_TAGS and not (tag == "header" and top.main) or aside
        outer |= bool(apart) and not doubt and tag not in MAIN_TAGS
        has_main |= main and not (outer or top.outer or headline or tag in TEXT_TAGS)
        opened.setdefault(tag, []).append(len(stack))
        if block:
            blocks.append(len(stack))
        stack.append(
            _Open(
                tag,
                int(top.main or main),
                int(top.outer or outer),
                int(top.silent or tag in SILENT_TAGS or bool(attrs and HIDDEN.search(attrs))),
                int(top.link or tag == "a"),
                int(top.doubt or doubt),
            )
        )
    flush()
    return [
        Block(
            whole,
            len(whole.split()),
            linked,
            APART if at.outer else INSIDE if at.main and not at.doubt else BESIDE if has_main and not at.main else ANYWHERE,
        )
        for whole, linked, at in found
    ]


FEATURES = (
    "place", "words", "linked", "previous words", "previous linked", "next words", "next linked",
)

# A small labelled table: the features above, then whether the block is of the article.
LABELLED: tuple[tuple[tuple[float, ...], int], ...] = tuple(
    (tuple(map(float, line.split()[:-1])), int(line.split()[-1]))
    for line in """
    3  12 0.0    0 0.0  80 0.0  1
    3  80 0.0   12 0.0  60 0.0  1
    3  60 0.0   80 0.0   2 0.0  1
    3   2 0.0   60 0.0  90 0.0  1
    3   1 0.0    0 0.0   9 0.0  1
    3  90 0.0    2 0.0   7 0.0  1
    3  25 0.1   40 0.0  33 0.0  1
    3   4 1.0   60 0.0  50 0.0  1
    3   2 1.0    2 1.0   2 1.0  1
    3  14 0.5   22 0.0  10 0.0  1
    3   5 0.0    3 0.0   0 0.0  1
    3   1 0.0    1 1.0   0 0.0  1
    3   1 1.0   40 0.0   1 1.0  1
    3   9 1.0   50 0.0  30 0.0  1
    3   3 0.9   12 0.9   2 1.0  1
    3  70 0.0    2 1.0   5 1.0  1
    3   1 1.0    0 0.0   0 0.0  1
    3   3 0.0    0 0.0   3 1.0  1
    3   6 0.0    2 1.0  40 0.0  1
    0   7 0.0   90 0.0  12 0.0  0
    0  35 0.0   50 0.0   3 1.0  0
    0   3 1.0   35 0.0   3 1.0  0
    0  60 0.0   25 0.0  40 0.0  0
    0   1 1.0    0 0.0   1 1.0  0
    0   1 1.0    1 1.0   1 1.0  0
    0   9 0.0    1 1.0  12 0.0  0
    0  12 0.1   70 0.0   4 0.0  0
    0   4 0.0   12 0.1   0 0.0  0
    0  80 0.0   60 0.0  50 0.0  0
    0  20 0.0   30 0.0   6 0.0  0
    0   6 0.0    2 1.0  40 0.0  0
    1   9 0.0    1 1.0  12 0.0  0
    1  30 0.0    5 0.0  45 0.0  0
    1  70 0.0   60 0.0   2 1.0  0
    1   2 1.0    2 1.0   2 1.0  0
    1   5 0.4    8 0.0   0 0.0  0
    1  12 0.0   60 0.0   0 0.0  0
    2  55 0.0    8 0.0  70 0.0  1
    2  70 0.1   55 0.0  40 0.0  1
    2  30 0.0   70 0.1  20 0.0  1
    2  30 0.0    4 0.0   0 0.0  1
    2   9 0.0    1 1.0  55 0.0  1
    2   6 0.0    0 0.0  60 0.0  1
    2   2 0.0   60 0.0  35 0.0  1
    2   3 0.0   30 0.0  28 0.0  1
    2  18 0.0   40 0.0   3 1.0  1
    2  12 0.2   33 0.0  44 0.0  1
    2   8 0.0   40 0.0   0 0.0  1
    2  40 0.0    2 0.0   4 1.0  1
    2  25 0.0   12 0.0   3 1.0  1
    2  60 0.0    0 0.0   2 1.0  1
    2  30 0.0    3 1.0   2 1.0  1
    2   2 0.0    0 0.0   0 0.0  1
    2   5 0.0    0 0.0   0 0.0  1
    2   2 1.0    0 0.0   2 1.0  0
    2   2 1.0    2 1.0   3 1.0  0
    2  25 0.9    2 1.0   9 0.8  0
    2  40 0.8   12 0.9   5 1.0  0
    2   4 1.0   60 0.0  40 0.0  0
    2   3 0.0    2 1.0   2 1.0  0
    2   5 0.0    3 1.0   0 0.0  0
    2   3 0.0    0 0.0   3 1.0  0
    """.strip().splitlines()
)


class Split(NamedTuple):
    feature: int
    above: float
    low: "Split | int"
    high: "Split | int"


def _impurity(labels: Sequence[int]) -> float:
    share = sum(labels) / len(labels)
    return 2 * share * (1 - share) * len(labels)


def grown(rows: Sequence[tuple[tuple[float, ...], int]], depth: int = 6) -> Split | int:
    """A decision tree by Gini impurity; ties go to the earlier feature and the lower value."""
    labels = [label for _, label in rows]
    majority = int(2 * sum(labels) > len(labels))
    if not depth or len(set(labels)) < 2:
        return majority
    best = None
    for feature in range(len(rows[0][0])):
        values = sorted({x[feature] for x, _ in rows})
        for low, high in zip(values, values[1:]):
            above = (low + high) / 2
            left = [label for x, label in rows if x[feature] <= above]
            right = [label for x, label in rows if x[feature] > above]
            cost = _impurity(left) + _impurity(right)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, feature, above)
    if best is None or best[0] >= _impurity(labels) - 1e-12:
        return majority
    _, feature, above = best
    return Split(
        feature,
        above,
        grown([r for r in rows if r[0][feature] <= above], depth - 1),
        grown([r for r in rows if r[0][feature] > above], depth - 1),
    )


def decide(tree: Split | int, features: Sequence[float]) -> bool:
    while isinstance(tree, Split):
        tree = tree.high if features[tree.feature] > tree.above else tree.low
    return bool(tree)


TREE = grown(LABELLED)


def features_of(blocks: Sequence[Block]) -> list[tuple[float, ...]]:
    sizes = [(0, 0.0), *((b.words, b.linked) for b in blocks), (0, 0.0)]
    return [(b.place, *sizes[i + 1], *sizes[i], *sizes[i + 2]) for i, b in enumerate(blocks)]


def main_text(html: str | None, tree: Split | int = TREE) -> str:
    """The article of a page, a line for each block; null and empty pages have none.

    Markup that is not closed, not opened or not markup at all is read as far as
    it goes: every page gives a text, and a page of any length or depth is read whole.
    """
    blocks = blocks_of(html) if html else []
    return "\n".join(b.text for b, x in zip(blocks, features_of(blocks)) if decide(tree, x))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html), repeated rows included."""
    text = F.pandas_udf(lambda htmls: htmls.map(main_text, na_action=None), "string")
    return pages.select(
        F.col("page_id").cast("long"), "url", text("html").alias("text")
    ).withColumn("n_chars", F.length("text").cast("long"))


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return extracted(table(spark, folder, "pages", "page_id", "url", "html"))
