"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with its path of block elements from
the root. Text length and punctuation are summed per path and divided by the number
of blocks on it; both ratios are fused into one score, which article and main elements
raise. Blocks whose score is above a threshold, smoothed along the page and not, name
the content elements: the article around them, else the main element, else the nearest
container. A parent is taken where it joins content elements or adds headings only. All
blocks in content elements are the main text, but for those of article elements without
a chosen block (cards) and those inside elements that announce something else (menus,
footers, adverts, forms, comments).

Words of class, id and role only announce. An element that holds most of the page's
score is no other element if it has the page's first-level heading or if no such
heading, article or main element and nothing like an article stands outside; a form is none if it holds most of the score and something
like an article. So names of a page's wrappers do not drop the page.

Pages are independent rows: no shuffle. A null or empty page gives the empty text, and
so does one without content. Repeated pages are answered each.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kit

# Fixed values of HTML: elements whose inside is no text, elements inside a line,
# elements that an opening tag of the same group ends, elements that end a paragraph.
RAW = "script|style|textarea|title|iframe|noscript|template|svg|select|object|canvas|xmp"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr br img".split()
)
# The head ends where its first flow content begins, closed or not; its own elements have no text.
EMPTY = frozenset("head area base br col embed hr img input link meta param source track wbr".split())
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
STOPS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol "
    "p pre section table ul".split()
)
# Elements and words of class, id or role that announce something other than the article.
OTHER_TAGS = frozenset("nav footer aside button menu dialog".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary "
    "contentinfo cookie cookies discussion disqus footer menu modal nav navbar navigation newsletter notice popup promo "
    "promotion related respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
# Names that tell what a page has or lacks, not what the element is.
PRESENCE = re.compile(r"(?:no|not|has|have|with|without)[-_]", re.I)
CONTENT_TAGS = frozenset(("article", "main"))
CONTAINERS = frozenset("html body div section td th center form fieldset".split()) | CONTENT_TAGS
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[.,;:!?…、。！，？]")

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>]*/>|.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
SMOOTHING = np.array([1.0, 2.0, 4.0, 2.0, 1.0]) / 10
THRESHOLD = 0.5
# Factor of the score inside elements made for the article.
BONUS = 1.5
# Text of this length is like an article even in a language without these marks.
LONG = 100


def _announces_other(tag: str, attributes: str, inside_content: bool) -> str:
    """How an element announces something other: by its kind, as a form, by a word, or not ("")."""
    if tag in OTHER_TAGS:
        return "kind"
    if tag == "header" and not inside_content:
        return "word"
    for m in NAMES.finditer(attributes) if tag not in ("html", "body") else ():
        names = [x for x in "".join(m.groups("")).lower().split() if not PRESENCE.match(x)]
        if not OTHER_WORDS.isdisjoint(WORD.findall(" ".join(names))):
            return "word"
    return "form" if tag == "form" else ""


def blocks(page: str) -> list[tuple[str, tuple[str, ...], tuple[int, ...], tuple[tuple[int, str], ...], int]]:
    """Text, path, element numbers, announcing elements, characters in links; in page order.

    Blocks inside an element that is other by its kind are left out.
    """
    found, words, stack, at, number, links, link_chars = [], [], [], 0, 0, 0, 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join("".join(words).split())
        other = tuple(x[1:] for x in stack if x[2])
        if text and all(how != "kind" for _, how in other):
            found.append((text, tuple(x[0] for x in stack), tuple(x[1] for x in stack), other, link_chars))
        words.clear()
        link_chars = 0

    def close(names: tuple[str, ...], stops: tuple[str, ...] = ()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stops:
                return

    def add(raw: str) -> None:
        nonlocal link_chars
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            words.append(text)
            if links:
                link_chars += len(text)

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag in INLINE:
            if tag == "br":
                words.append(" ")
            elif tag == "a":
                links = 0 if m[2] else 1
            continue
        flush()
        if m[2]:
            close((tag,))
            continue
        if tag in ENDS_PARAGRAPH:
            close(("p",), ("table", "article", "main", "section"))
        if tag in ENDS:
            close(ENDS[tag], STOPS.get(tag, ()))
        if tag not in EMPTY and not (m[4] or "").endswith("/"):
            inside = any(x[0] in CONTENT_TAGS for x in stack)
            number += 1
            stack.append((tag, number, _announces_other(tag, m[4] or "", inside)))
    add(page[at:])
    flush()
    return found


def path_ratios(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Text outside of links and marks of each block's path, per block on it."""
    length, marks, nodes, linked = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for text, path, _, _, links in found:
        length[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        nodes[path] += 1
        linked[path] += links
    text_ratio = np.array([(length[b[1]] - min(linked[b[1]], length[b[1]])) / nodes[b[1]] for b in found])
    return text_ratio, np.array([marks[b[1]] / nodes[b[1]] for b in found])


def fused(text_ratio: np.ndarray, mark_ratio: np.ndarray) -> np.ndarray:
    return text_ratio * np.log2(2 + mark_ratio)


def smooth(x: np.ndarray) -> np.ndarray:
    return np.convolve(np.pad(x, len(SMOOTHING) // 2, mode="edge"), SMOOTHING, mode="valid")


def without_other(found: list) -> list:
    """The blocks that stay when announcing elements are judged by what they hold, the inner ones first."""
    if not any(b[3] for b in found):
        return found
    text_ratio, mark_ratio = path_ratios(found)
    score = fused(text_ratio, mark_ratio)
    like = (score >= THRESHOLD * score.std()) & (text_ratio > 0) & ((mark_ratio >= 1) | (text_ratio >= LONG))
    # What each announcing element holds that no inner one has: blocks, score, like an article, a first heading, made for content.
    held = defaultdict(lambda: [[], 0.0, False, False, False])
    how, outer = {}, {}
    for i, b in enumerate(found):
        for depth, (n, kind) in enumerate(b[3]):
            how[n], outer[n] = kind, b[3][depth - 1][0] if depth else 0
        own = held[b[3][-1][0] if b[3] else 0]
        own[0].append(i)
        own[1:] = own[1] + score[i], own[2] or bool(like[i]), own[3] or "h1" in b[1], own[4] or not CONTENT_TAGS.isdisjoint(b[1])
    for n in sorted(how, reverse=True):
        inside, outside, article_outside, up = held[n], held[0][1], any(held[0][2:]), outer[n]
        while up:
            outside, article_outside, up = outside + held[up][1], article_outside or any(held[up][2:]), outer[up]
        most = inside[1] > outside and inside[2]
        if most and (how[n] == "form" or inside[3] or not article_outside):
            to = held[outer[n]]
            to[0].extend(inside[0])
            to[1:] = to[1] + inside[1], *(a or b for a, b in zip(to[2:], inside[2:]))
    return [found[i] for i in sorted(held[0][0])]


def _content_element(block: tuple) -> int:
    """Number of the innermost article, else the innermost main, else the nearest container; 0 is the page."""
    _, path, numbers, _, _ = block
    for tags in (("article",), ("main",), CONTAINERS):
        for tag, n in zip(reversed(path), reversed(numbers)):
            if tag in tags:
                return n
    return 0


def _grown(roots: set[int], found: list) -> set[int]:
    """Content elements with parents in place of those they join, or of one beside which only headings stand."""
    parent, total, heads = {}, defaultdict(int), defaultdict(int)
    for _, path, numbers, _, _ in found:
        heading = not HEADINGS.isdisjoint(path)
        for depth, n in enumerate(numbers):
            parent[n] = numbers[depth - 1] if depth else 0
            total[n] += 1
            heads[n] += heading
    while True:
        above = {n: 0 for n in roots}
        for n in roots:
            up = parent.get(n, 0)
            while up and up not in roots:
                up = parent[up]
            above[n] = up
        roots = {n for n in roots if not above[n]}
        joined = defaultdict(list)
        for n in roots:
            up = parent.get(n, 0)
            while up:
                joined[up].append(n)
                up = parent[up]
        # The deepest parent first: elements are numbered as they open.
        for up in sorted(joined, reverse=True):
            own = sum(total[n] for n in joined[up])
            added = total[up] - own
            headings = heads[up] - sum(heads[n] for n in joined[up])
            if len(joined[up]) > 1 and added <= own or added and added == headings:
                roots = (roots - set(joined[up])) | {up}
                break
        else:
            return roots


def main_text(page: str | None) -> str:
    found = without_other(blocks(page or ""))
    if not found:
        return ""
    text_ratio, mark_ratio = path_ratios(found)
    bonus = np.array([1.0 if CONTENT_TAGS.isdisjoint(b[1]) else BONUS for b in found])
    own = fused(text_ratio, mark_ratio) * bonus
    score = fused(smooth(text_ratio), smooth(mark_ratio)) * bonus
    high = own >= THRESHOLD * own.std()
    both = high & (score >= THRESHOLD * score.std())
    seeds = np.flatnonzero(both if both.any() else high)
    roots = {_content_element(found[i]) for i in seeds}
    if 0 not in roots:
        roots = _grown(roots, found)
    seeded = {n for i in seeds for n in found[i][2]}
    texts = []
    for text, path, numbers, _, _ in found:
        cards = any(tag == "article" and n not in seeded for tag, n in zip(path, numbers))
        if not cards and (0 in roots or not roots.isdisjoint(numbers)):
            texts.append(text)
    return "\n\n".join(texts)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    schema = T.StructType([
        T.StructField("page_id", pages.schema[id_column].dataType), T.StructField("url", pages.schema[url_column].dataType),
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()),
            ], names=schema.names)

    return kit.map_arrow(pages.select(
        pages[id_column].alias("page_id"), pages[url_column].alias("url"), pages[html_column].alias("html"),
    ), run, schema)
