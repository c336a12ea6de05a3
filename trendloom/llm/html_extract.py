"""Main text of web pages by two passes of block rules.

A page becomes blocks: runs of text between block-level tags, each with its characters, the share of them inside links,
the share of stop words among its words, and the zone it stands in. Blocks of zones that are no article by markup (nav,
footer, forms, elements marked as adverts, comments, notices ...) go. The first pass decides the others from
link density, length and stop-word density: good, bad, or ambiguous ("near" for blocks with some evidence, "short" for those
without). The second gives ambiguous blocks the label of the nearest decided neighbours. Where the page names its
article, only blocks in it count, and its plain blocks are good unless they are made of links.

Elements that are never closed end where their parent ends. A marked element that holds the article, or most of the
page's prose, is a wrapper and no zone, whatever its class says; so is a menu or footer that somebody forgot to close.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import without

#: Blocks below SHORT characters are ambiguous, those above LONG with enough stop words are good.
SHORT, LONG = 70, 200
#: Shares of stop words from which a block is ambiguous ("near") or, if long, good.
STOP_LOW, STOP_HIGH = 0.08, 0.16
#: Shares of link characters above which a block is bad, outside and inside of an article.
LINKS, LINKS_INSIDE = 0.33, 0.5
#: A heading looks for a good block within so many characters after it.
HEADING_REACH = 200
#: A marked element with more than this share of the page's prose is a wrapper.
WRAPPER = 0.6
#: Second articles of a page count from this share of the largest one's characters.
PART = 0.5

#: Frequent short words by language. Fixed values.
STOP_WORDS = {
    "en": "the of and to a in is it that for was on are with as be at by this from or an have not but they which you had were his her their has will would there been if more when who so no",
    "de": "der die das und in den von zu mit ist des im für auf ein eine dem nicht sich auch als es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war",
    "fr": "le la les de des du et en un une que qui dans est pour pas au aux sur par plus ce se il elle ne avec son sont ou mais comme nous leur été cette ces ont être",
    "es": "el la los las de del y en un una que es por con para no se su al lo como más pero sus le ya este entre cuando todo esta ser son dos también fue había era muy",
}
STOPS = frozenset(w for words in STOP_WORDS.values() for w in words.split())

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul select button textarea noscript template iframe video audio canvas object svg".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text never belongs to an article; the second group may turn out to be wrappers.
NEVER = frozenset("title nav footer aside dialog menu select button textarea noscript template iframe video audio canvas object svg".split())
MAYBE = frozenset(("form", "header", "fieldset"))
RAW = frozenset(("script", "style", "title", "textarea", "noscript", "iframe", "template"))
#: Elements that the next one of their kind closes, up to an enclosing element of the second set.
ENDED_BY_NEXT = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
LEAVES = frozenset("p li dt dd td th tr option span a b i em strong small label h1 h2 h3 h4 h5 h6 font u s time".split())

#: Words of class, id and role that mark what is not the article. Fixed values.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner billboard outbrain taboola
    cookie cookies consent gdpr notice notices notification notifications newsletter subscribe subscription signup signin login register paywall popup modal
    sidebar sidebars rail nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager skip
    comment comments disqus respond reply replies discussion related recommended recommendations share sharing social tagcloud
    footer masthead topbar toolbar copyright disclaimer complementary contentinfo dialog form""".split()
)
WHOLE_MARKS = frozenset("widget widgets toc alert overlay tags search side right navigation topmenu".split())
COMMENTS = frozenset(("comment", "comments", "disqus", "respond", "reply", "replies", "discussion"))
HEADER_MARKS = frozenset(("header", "siteheader", "pageheader", "topheader", "banner"))
ARTICLE_MARKS = frozenset(("articlebody", "articlecontent", "articletext", "entrycontent", "postcontent", "postbody", "storybody", "storytext", "blogpost"))
MAIN_MARKS = frozenset(("main", "maincontent", "content", "primary"))
#: Classes that begin so describe a state or a layout, not what the element is.
STATES = frozenset("has no with without is show hide hidden js open not".split())
COMMENT_HEADING = re.compile(r"\W*(\d+\s+)?((reader|user|leser)\W*)?(comments?|kommentare?|commentaires?|comentarios?|responses|replies|leave a (reply|comment)|add a comment)\W*(\(?\d+\)?)?\W*", re.I)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]{0,65536}\"|'[^']{0,65536}')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NEXT_LINK = re.compile(r"<(/?)a[\s>/]", re.I)
WORD = re.compile(r"\w+")
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Element:
    name: str
    parent: int
    begin: int  # its blocks are those from begin to end
    end: int = -1
    zone: str = ""  # never, mark (perhaps a wrapper), comment, heading (only headings count) or nothing
    holds: str = ""  # article, main or nothing
    closed: bool = False  # by an end tag of its own


@dataclass
class Block:
    element: int
    name: str
    text: str
    links: int  # characters of links, without white space, as in chars
    chars: int
    stops: float = 0.0
    label: str = ""  # good, bad, near or short


def _marks(name: str, attributes: str) -> tuple[str, str]:
    """(zone, holds) of an element by its name and attributes."""
    zone = "never" if name in NEVER else "mark" if name in MAYBE else ""
    holds = "article" if name == "article" else "main" if name == "main" else ""
    if "=" not in attributes and "hidden" not in attributes:
        return zone, holds
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if (key == "hidden" and value.lower() != "until-found") or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            zone = "never"
        elif key in ("class", "id", "role"):
            for one in value.split():
                words = [w for w in SPLIT.split(CAMEL.sub(" ", one).lower()) if w]
                if not words or words[0] in STATES:
                    continue
                whole = "".join(words)
                if COMMENTS.intersection(words):
                    zone = zone or "comment"
                elif MARKS.intersection(words) or whole in HEADER_MARKS or whole in WHOLE_MARKS:
                    zone = zone or "mark"
                elif whole in ARTICLE_MARKS or (key == "role" and whole == "article"):
                    holds = holds or "article"
                elif whole in MAIN_MARKS:
                    holds = holds or "main"
        elif key == "itemprop" and value.lower() == "articlebody":
            holds = "article"
    if name in ("html", "body"):
        return "", ""
    if name in ("article", "main") and zone == "mark":  # <article class="post related-x"> is still an article
        zone = ""
    return zone, holds


def parsed(page: str) -> tuple[list[Element], list[Block]]:
    """The page's elements (as far as zones need them) and its blocks in order, in one pass over the tags."""
    elements, blocks = [Element("", -1, 0)], []
    stack, opened = [0], {}
    pieces, linked, kind, mute = [], False, "", 0  # mute: the depth of a hidden inline element, whose text is left out

    def flush() -> None:
        nonlocal pieces
        text = " ".join("".join(p for p, _ in pieces).split())
        if text:
            inside = sum(len("".join(p.split())) for p, is_link in pieces if is_link)
            blocks.append(Block(stack[-1], kind, text, inside, len(text) - text.count(" ")))
        pieces = []

    def close(upto: int) -> None:
        nonlocal mute
        while len(stack) > upto:
            e = elements[stack.pop()]
            e.end = len(blocks)
            opened[e.name] -= 1
        mute = mute if len(stack) > mute else 0

    def put(text: str) -> None:
        if text and not mute:
            pieces.append((entities.unescape(text) if "&" in text else text, linked))

    position, size, link_ends = 0, len(page), True
    while position < size:
        m = TAG.search(page, position)
        if m is None:
            put(page[position:])
            break
        put(page[position : m.start()])
        position = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "br":
            pieces.append((" ", False))
            continue
        if name == "a":
            linked = False
            if not closing and "href" in attributes.lower():
                linked = True
                after = NEXT_LINK.search(page, position)
                link_ends = after is not None and after[1] == "/"
        block = name in BLOCKS
        if block:
            flush()
            if linked and not link_ends:
                linked = False
            kind = "" if closing else name
        if closing:
            if opened.get(name):
                k = len(stack) - 1
                while elements[stack[k]].name != name and not (name in LEAVES and elements[stack[k]].name not in LEAVES):
                    k -= 1
                if elements[stack[k]].name == name:
                    elements[stack[k]].closed = True
                    close(k)
            continue
        if name in RAW:
            end = re.compile(f"</{name}\\b[^>]*>?", re.I).search(page, position)
            position = end.end() if end else size
            continue
        if name in VOID:
            continue
        if name in ENDED_BY_NEXT:
            k = len(stack) - 1
            while elements[stack[k]].name in LEAVES and elements[stack[k]].name not in ENDED_BY_NEXT[name]:
                k -= 1
            if elements[stack[k]].name in ENDED_BY_NEXT[name]:
                close(k)
        elif block and opened.get("p"):  # a block ends a paragraph that is left open
            k = len(stack) - 1
            while elements[stack[k]].name in LEAVES and elements[stack[k]].name != "p":
                k -= 1
            if elements[stack[k]].name == "p":
                close(k)
        zone, holds = _marks(name, attributes)
        if not block and zone != "never":
            continue  # inline elements belong to their block, whatever their class
        if not block:
            mute = mute or len(stack)
        if zone in ("", "mark") and name == "header" and any(elements[s].holds == "article" for s in stack):
            zone, holds = "heading", ""
        elements.append(Element(name, stack[-1], len(blocks), zone=zone, holds=holds))
        stack.append(len(elements) - 1)
        opened[name] = opened.get(name, 0) + 1
    flush()
    close(1)
    elements[0].end = len(blocks)
    return elements, blocks


def zones(elements: list[Element], blocks: list[Block]) -> tuple[list[str], list[int], list[bool]]:
    """For each block: its zone, the article it stands in (0: none) and whether it stands in the main part."""
    prose = np.cumsum([0, *[b.chars if len(b.text) >= SHORT and b.links <= LINKS * b.chars else 0 for b in blocks]])
    share = lambda e: (prose[e.end] - prose[e.begin]) / max(1, prose[-1])
    articles = [e for e in elements if e.holds == "article" and e.zone == ""]

    def wraps(e: Element) -> bool:
        if e.zone == "comment" or (e.zone == "never" and e.closed):
            return False
        held = bool(articles) and all(e.begin <= a.begin and a.end <= e.end for a in (articles[0], articles[-1]))
        return share(e) > WRAPPER or (held and (share(e) > WRAPPER / 2 or not prose[-1]))

    zone, article, main = [""] * len(elements), [0] * len(elements), [False] * len(elements)
    for k, e in enumerate(elements):
        if k == 0:
            continue
        p = e.parent
        own = e.zone if e.zone and not (e.zone != "heading" and wraps(e)) else ""
        zone[k] = zone[p] if zone[p] and zone[p] != "heading" else own or zone[p]
        article[k], main[k] = article[p], main[p] or e.holds == "main"
        if e.holds == "article" and not zone[k]:
            if not article[p]:
                article[k] = k
            elif e.name == "article" and elements[article[p]].name == "article" and share(e) <= WRAPPER * share(elements[article[p]]):
                zone[k] = "comment"  # an article inside an article is a reader's
    at = [b.element for b in blocks]
    return [zone[k] for k in at], [article[k] for k in at], [main[k] for k in at]


def _first_pass(b: Block, inside: bool) -> str:
    heading = b.name in HEADINGS
    if b.links > (LINKS_INSIDE if inside else LINKS) * b.chars:
        return "bad"
    if not inside and len(b.text) < LONG and ("©" in b.text or "all rights reserved" in b.text.lower()):
        return "bad"
    words = WORD.findall(b.text.lower())
    b.stops = sum(w in STOPS for w in words) / len(words) if words else 0.0
    if inside:
        return "good" if heading or len(b.text) >= SHORT or b.stops >= STOP_LOW else "short"
    if heading or len(b.text) < SHORT:
        return "bad" if b.links else "short"
    if b.stops >= STOP_HIGH:
        return "good" if len(b.text) > LONG else "near"
    return "near" if b.stops >= STOP_LOW else "bad"


def _second_pass(blocks: list[Block], inside: bool) -> None:
    """Ambiguous blocks take the label of the nearest decided neighbours; inside an article its edges count as good, elsewhere as bad.

    A short block follows the nearer one of two that differ, in blocks; at equal distance a heading is good if a good block
    follows within HEADING_REACH characters, other blocks are bad. A block with some evidence is good beside any good one.
    """
    edge, n = "good" if inside else "bad", len(blocks)
    decided = [b.label if b.label in ("good", "bad") else "" for b in blocks]

    def nearest(order) -> list[tuple[str, int, int]]:
        """(label, blocks to it, characters between) of the next decided block in that order."""
        out, label, away, between = [("", 0, 0)] * n, edge, 0, 0
        for k in order:
            away += 1
            out[k] = (label, away, between)
            between += len(blocks[k].text)
            if decided[k]:
                label, away, between = decided[k], 0, 0
        return out

    for b, (up, above, _), (down, below, between) in zip(blocks, nearest(range(n)), nearest(range(n - 1, -1, -1)), strict=True):
        if b.label == "near":
            b.label = "good" if "good" in (up, down) else "bad"
        elif b.label == "short":
            if b.name in HEADINGS and above == below:
                b.label = "good" if down == "good" and between <= HEADING_REACH else "bad"
            else:
                b.label = up if up == down or above < below else down if below < above else "bad"


def main_text(page: str | None) -> str:
    """The blocks of the page's article, joined by line ends; empty where it has none."""
    if not page:
        return ""
    elements, blocks = parsed(page)
    zone, article, main = zones(elements, blocks)
    open_, after_heading = [], 0
    for k, b in enumerate(blocks):
        if b.name in HEADINGS:
            level = int(b.name[1])
            if after_heading and level <= after_heading:
                after_heading = 0
            if level > 1 and COMMENT_HEADING.fullmatch(b.text):
                after_heading = level
        open_.append(not after_heading and (zone[k] == "" or (zone[k] == "heading" and b.name in HEADINGS)))
    if any(a and o for a, o in zip(article, open_, strict=True)):
        size: dict[int, int] = {}
        for k, b in enumerate(blocks):
            if article[k] and open_[k]:
                size[article[k]] = size.get(article[k], 0) + b.chars - b.links
        least = PART * max(size.values())
        parts = [[b for k, b in enumerate(blocks) if article[k] == a and open_[k]] for a in size if size[a] >= least]
        inside = True
    else:
        only = any(m and o for m, o in zip(main, open_, strict=True))
        parts, inside = [[b for k, b in enumerate(blocks) if open_[k] and (main[k] or not only)]], False
    for part in parts:
        for b in part:
            b.label = _first_pass(b, inside)
        _second_pass(part, inside)
    return "\n".join(b.text for part in parts for b in part if b.label == "good")


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages with the main text of each page in place of its html, and the text's code points.

    Whole pages are read; null counts as an empty page, and a page without an article gives an empty text. Repeated rows
    give repeated results, an empty table an empty one. Columns that are named like results are replaced. A task holds one
    batch of pages (spark.sql.execution.arrow.maxBytesPerBatch) and the blocks of one page at a time.
    """
    others = without(pages.columns, html, text, n_chars)
    typed = pages.select(*[F.col(f"`{c}`") for c in others]).withColumn(text, F.lit("")).withColumn(n_chars, F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page.as_py()) for page in batch.column(batch.num_columns - 1)]
            made = [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*others, text, n_chars])

    return pages.select(*[F.col(f"`{c}`") for c in [*others, html]]).mapInArrow(run, typed.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
