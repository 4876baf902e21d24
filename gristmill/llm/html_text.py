"""Main text of web pages by consensus host paths.

Every page's containers are scored; the path of generalised tags and classes
to its best container is the page's vote. Spark counts the votes of each host,
and all pages of the host are extracted again at the winning path.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import store

#: Elements whose whole content is never main text.
DROPPED = frozenset((
    "aside", "audio", "button", "canvas", "dialog", "footer", "form", "head", "iframe", "input", "menu", "nav",
    "noscript", "object", "option", "script", "select", "style", "svg", "template", "textarea", "title", "video",
))
#: Words of classes, ids and roles that mark other content than the article; see ``_mark_other``.
OTHER = frozenset((
    "ad", "ads", "adbox", "advert", "advertisement", "advertising", "adverts", "alert", "aside", "banner", "breadcrumb",
    "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog",
    "disclaimer", "disqus", "footer", "gdpr", "header", "hidden", "legal", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion",
    "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget",
))
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
))
CONTAINERS = frozenset(("article", "body", "center", "div", "html", "main", "section", "table", "tbody", "td", "tr"))
#: An open element of these ends where one of the others begins.
ENDS_AT = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",)}
#: Parts of a page that are articles by their tag.
ARTICLES = frozenset(("article", "main"))
#: First parts of class names that say what surrounds an element, not what it is.
QUALIFIERS = frozenset(("has", "have", "no", "not", "with", "without"))
#: Words of classes that mark what readers wrote; it is left out however long it is.
READERS = frozenset(("comment", "comments", "disqus", "replies", "reply", "respond"))
TEXTUAL = frozenset(("blockquote", "dd", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "pre", "td"))
#: The best container is sought downwards while one child keeps this share.
SHARE = 0.7
#: A block of this many characters is text whatever holds it.
LONG = 80
#: Attributes up to this length are matched at once; longer ones by the page's table of quotes.
NEAR = 4096

_OPENS = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_ATTRIBUTES = re.compile(r"""[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+>""")
_SPECIAL = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW_ENDS = {tag: re.compile("</" + tag, re.I) for tag in RAW}
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)

#: How an element is marked as other content: not, by a part of a name, by a whole name, by readers' words, by its tag.
PLAIN, DOUBTFUL, NAMED, READER, TAGGED = range(5)


@dataclass(slots=True)
class Element:
    parent: int
    tag: str
    #: The tag with its generalised classes; empty for inline elements, which are no part of a path.
    step: str
    #: Hash of the path's steps.
    key: int
    mark: int
    #: The nearest block element, itself included.
    holder: int
    other: bool = False
    score: float = 0.0


@dataclass
class Page:
    """Elements in page order and (element, text, characters in links) blocks."""

    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def path_key(above: int, step: str) -> int:
    return xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), above)


def path_of(page: Page, at: int) -> str:
    steps = []
    while at > 0:
        if page.elements[at].step:
            steps.append(page.elements[at].step)
        at = page.elements[at].parent
    return "/".join(reversed(steps))


def _describe(tag: str, attributes: str, in_article: bool) -> tuple[str, int]:
    """The generalised step of a path, and how the element is marked."""
    if not attributes.strip():
        return tag, PLAIN
    values = {a.lower(): unescape(b or c or d) for a, b, c, d in _ATTRIBUTE.findall(attributes)}
    names = values.get("class", "").split()
    mark = PLAIN
    for name in (*names, *values.get("id", "").split(), *values.get("role", "").split()):
        words = _WORD.findall(_CAMEL.sub(" ", name).lower())
        found = OTHER.intersection(words) - ({"header", "masthead"} if in_article else set())
        if found and words[0] not in QUALIFIERS:
            mark = max(mark, READER if found & READERS else NAMED if len(words) == 1 else DOUBTFUL)
    if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", ""):
        mark = max(mark, NAMED)
    steps = sorted({_DIGITS.sub("#", n.lower()).replace("/", ":") for n in names})
    return ".".join([tag, *steps]), mark


class _TagEnds:
    """Where tags end, in time that is linear in the page however its quotes are left open."""

    def __init__(self, html: str):
        self.html, self.last, self.ends = html, html.rfind(">"), None

    def after(self, at: int) -> int:
        """The place after the tag whose attributes start at ``at``; -1 if nothing closes it.
        A quote that is never closed doesn't hide the end."""
        if at > self.last:
            return -1
        found = _ATTRIBUTES.match(self.html, at, at + NEAR)
        if found:
            return found.end()
        if self.ends is None:
            self.places = [m.start() for m in _SPECIAL.finditer(self.html)]
            self.ends = [0] * len(self.places)
            later: dict[str, int] = {}
            for k in range(len(self.places) - 1, -1, -1):  # the end seen from each sign outside quotes
                sign = self.html[self.places[k]]
                if sign == ">":
                    self.ends[k] = self.places[k] + 1
                else:
                    close = later.get(sign)
                    self.ends[k] = self.ends[close + 1] if close is not None and close + 1 < len(self.ends) else 0
                    later[sign] = k
        k = bisect_left(self.places, at)
        return self.ends[k] or self.html.find(">", at) + 1


def parse(html: str) -> Page:
    """Blocks of a page; tolerant of tags that are missing, stray or unclosed. Time and memory are
    linear in the page, however deep its elements lie."""
    page, texts, linked, links = Page(), [], 0, 0
    elements = page.elements
    elements.append(Element(-1, "", "", 0, PLAIN, 0))
    stack, open_now, tag_ends = [0], Counter(), _TagEnds(html)

    def end_block() -> None:
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                page.blocks.append((stack[-1], text, min(linked, len(text))))
            texts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text) if "&" in text else text
            texts.append(text)
            if links:
                linked += len(text)

    def close(tags: tuple[str, ...], within: frozenset[str] = frozenset()) -> None:
        """Pop to the nearest open element of these tags, unless ``within`` is met first."""
        nonlocal links
        if not any(open_now[t] for t in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = elements[stack[depth]].tag
            if tag in tags:
                if any(elements[e].tag in BLOCKS for e in stack[depth:]):
                    end_block()
                for e in stack[depth:]:
                    open_now[elements[e].tag] -= 1
                    links -= elements[e].tag == "a"
                del stack[depth:]
                return
            if tag in within:
                return

    at = said = 0
    while True:
        found = _OPENS.search(html, at)
        if not found or found.start() > tag_ends.last and not found[1]:
            break
        comment, declared, closing, tag = found.groups()
        if comment:
            end = html.find("-->", found.end()) + 3
            end = len(html) if end < 3 else end
        elif declared:
            end = html.find(">", found.end()) + 1
        else:
            end = html.find(">", found.end()) + 1 if closing else tag_ends.after(found.end())
        say(html[said:found.start()])
        at = said = end
        if not tag:
            continue  # comment, doctype or processing instruction
        tag = tag.lower()
        if closing:
            if tag == "br":
                texts.append(" ")
            elif tag == "p" and not open_now["p"]:
                end_block()
            else:
                close((tag,), CONTAINERS - {tag} if tag not in BLOCKS else frozenset())
            continue
        attributes = html[found.end():end - 1]
        if tag in VOID:
            if tag == "hr":
                end_block()
            elif tag != "wbr":
                texts.append(" ")
            continue
        if tag in BLOCKS:
            close(("p",), CONTAINERS)
            end_block()
        if tag in ENDS_AT:
            close(ENDS_AT[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        if tag in RAW:
            end = _RAW_ENDS[tag].search(html, at)
            at = said = end and html.find(">", end.end()) + 1 or len(html)
            continue
        in_article = bool(open_now["article"] or open_now["main"])
        step, mark = _describe(tag, attributes, in_article)
        if tag in ("html", "body", "article", "main"):
            mark = PLAIN
        if tag in DROPPED or tag == "header" and not in_article:
            mark = TAGGED
        if attributes.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        above, number = elements[stack[-1]], len(elements)
        if tag in BLOCKS:
            elements.append(Element(stack[-1], tag, step, path_key(above.key, step), mark, number))
        else:
            elements.append(Element(stack[-1], tag, "", above.key, mark, above.holder))
        stack.append(number)
        open_now[tag] += 1
        links += tag == "a"
    say(html[said:])
    end_block()
    _mark_other(page)
    return page


def _mark_other(page: Page) -> None:
    """Decide which elements hold other content than the article.

    Tags and readers' words always do. A name is not believed of an element
    that holds nearly all of the page's text, or most of it if only a part of
    the name says so or an article or first heading lies inside.
    """
    elements = page.elements
    gone = [False] * len(elements)
    for i, e in enumerate(elements):  # parents come first
        gone[i] = e.mark == TAGGED or i > 0 and gone[e.parent]
    held, heads = [0] * len(elements), [e.tag in ARTICLES or e.tag == "h1" for e in elements]
    for at, text, linked in page.blocks:
        held[at] += 0 if gone[at] else len(text) - linked
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i].parent] += held[i]
        heads[elements[i].parent] |= heads[i]
    for i, e in enumerate(elements):
        share = held[i] / held[0] if held[0] else 0
        believed = e.mark >= READER or e.mark != PLAIN and not (share >= 0.9 or share >= 0.5 and (e.mark == DOUBTFUL or heads[i]))
        e.other = believed or i > 0 and elements[e.parent].other


def _is_text(page: Page, block: tuple[int, str, int]) -> bool:
    """Whether a block that a container leaves behind would be missed."""
    at, text, linked = block
    holder = page.elements[page.elements[at].holder]
    return not page.elements[at].other and linked * 2 < len(text) and (holder.tag in TEXTUAL or len(text) >= LONG) and not _RIGHTS.match(text)


def best_container(page: Page) -> int:
    """The element that the page votes for; 0, the whole page, if none stands out.

    A block's worth is its length outside links, counted for all elements
    around it. From the top, the child container that keeps most of its
    parent's worth is better if it leads to an article or main element, which
    is the best, or if it leaves no text behind.
    """
    elements = page.elements
    for at, text, linked in page.blocks:
        if not elements[at].other:
            elements[at].score += len(text) - linked - min(len(text), 20) * 0.5
    article, around, missed = [0.0] * len(elements), [0] * len(elements), [0] * len(elements)
    for block in page.blocks:
        missed[block[0]] += _is_text(page, block)
    for i in range(len(elements) - 1, 0, -1):
        e = elements[i]
        elements[e.parent].score += e.score
        article[i] = e.score if e.tag in ARTICLES and not e.other else article[i]
        article[e.parent] = max(article[e.parent], article[i])
        missed[e.parent] += missed[i]
    children: dict[int, list[int]] = {}
    for i, e in enumerate(elements):
        if i:
            around[i] = e.parent if not e.parent or elements[e.parent].tag in CONTAINERS else around[e.parent]
            if e.tag in CONTAINERS and not e.other:
                children.setdefault(around[i], []).append(i)
    best = 0
    while elements[best].tag not in ARTICLES:
        below = max(children.get(best, []), key=lambda i: elements[i].score, default=0)
        if not below or elements[below].score <= 0 or elements[below].score < SHARE * elements[best].score:
            break
        if article[below] < SHARE * elements[best].score and missed[best] > missed[below]:
            break
        best = below
    return best


def text_at(page: Page, path: str | None) -> str:
    """The blocks under the elements at ``path``, or under the page's own best
    container where the path is not on the page or holds less than half of it."""
    own = best_container(page)
    key = 0
    for step in path.split("/") if path else ():
        key = path_key(key, step)
    inside = _under(page, {i for i, e in enumerate(page.elements) if e.key == key and e.tag in CONTAINERS and not e.other}) if path else []
    mine = _under(page, {own})
    chosen = inside if sum(map(len, inside)) * 2 >= sum(map(len, mine)) else mine
    return "\n".join(chosen)


def _under(page: Page, roots: set[int]) -> list[str]:
    within = [False] * len(page.elements)
    for i, e in enumerate(page.elements):  # parents come first
        within[i] = i in roots or e.parent >= 0 and within[e.parent]
    return [text for at, text, _ in page.blocks if within[at] and not page.elements[at].other]


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, score): each page's best container."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, scores = [], []
            for html in batch.column("html"):
                page = parse(html.as_py() or "")
                best = best_container(page)
                paths.append(path_of(page, best))
                scores.append(page.elements[best].score)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string()), pa.array(scores, pa.float64())],
                                             names=["host", "path", "score"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string, score double")


def winners(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes, then most text, then the first by name."""
    counted = votes(pages).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
    # min_by of negated counts breaks ties towards the first path
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), -F.round("score"), F.col("path"))).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null or empty html gives an empty text. A null or relative url has the
    empty host and votes with its like. Repeated rows vote and are extracted
    as often as they occur; an empty table gives no row. Other columns are
    not read.
    """
    store.bound_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    known = pages.select("page_id", "url", host.alias("host"), "html")
    # written first, so that its true size decides whether it is broadcast or the pages are shuffled
    chosen = store.stash(winners(known), "host-paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_at(parse(html or ""), path) for html, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return known.join(chosen, "host", "left").select("page_id", "url", "html", "path").mapInArrow(run, f"{kinds}, text string, n_chars long")
