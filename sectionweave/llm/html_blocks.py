"""Main text of web pages from flat text blocks and a decision tree.

Markup is read once into a flat list of text blocks. A block is described by its words and link density,
those of its neighbours, and by what it stands in; a decision tree, grown on the blocks of a few labelled
pages, says which blocks are main text.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import record_batch, sliced

MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|data-main)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Elements whose content is no text of the page.
OPAQUE = frozenset("script style noscript template textarea title svg iframe select option button head".split())
#: Of these, the ones whose content is not markup either.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements that end a block where they begin and end.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead "
    "tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are kept on the stack; what is left open inside one ends with it.
HOLDERS = BLOCKS - frozenset(("hr", "html")) | OPAQUE
#: Elements that end where the next block begins.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Elements that end where one like them begins.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
BOILERPLATE = frozenset("nav footer aside form dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar status".split())
#: Parts of class and id names.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay comment comments disqus reply replies respond sidebar aside menu menus nav navbar navigation navi "
    "breadcrumb breadcrumbs footer foot masthead topbar share sharing social related recommended recommendations newsletter subscribe subscription "
    "signup login widget widgets pagination pager toolbar skip form search legal copyright disclaimer".split())
#: Parts that say nothing of their own in a name inside an article.
PLAIN = frozenset("area bar block body bottom box button buttons container content group icon icons inner item items left link links list main page panel "
                  "post right row section site slot text title top unit wrap wrapper".split())
#: What a section of an article may be about as well. Inside an article a name of these counts only if it says nothing else, and an id not at all.
TOPICS = frozenset("alert copyright disclaimer form legal notice notices notification promotion recommendations recommended related search social subscription".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Labelled blocks that a leaf of the tree has at least: one block alone is no evidence.
LEAST_IN_LEAF = 4
UNCLOSED = re.compile(r"<!--|<!\[CDATA\[")
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "in_main", "has_main", "in_boilerplate")

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])

#: Labelled pages: data-main says whether the blocks inside are main text.
LABELLED = tuple(f"<html><body>{page}</body></html>" for page in (
    # Menus, one-word paragraphs and long adverts around an article.
    """<header data-main=0><div>The Daily Example brings you all the news of the whole wide world every single day of the week</div></header>
    <nav data-main=0><ul><li><a href=#>Home</a><li><a href=#>World news and much more of it</a></ul></nav>
    <div class=ad data-main=0>Buy this wonderful thing today and get another wonderful thing for nothing at all from our partners</div>
    <article data-main=1><h1>Title</h1><p>One.</p><p>A much longer paragraph of plain text that tells a story about people and places with many words in it</p>
    <p><a href=#>A paragraph that is a link only</a></p><p>See <a href=#>the other page</a> for the rest of this</p>
    <div class=ad data-main=0>Short advert</div><p>Two words</p><form data-main=0>Your name and a message that you want to send to the people who wrote this</form></article>
    <aside data-main=0><p>Other stories you may like are told here in a few plain words without links to them</p><a href=#>More</a></aside>
    <footer data-main=0>Copyright of the Daily Example and all who work for it, all rights reserved for ever and a day in all lands</footer>""",
    # An article with notices and comments inside, and words outside.
    """<div data-main=0>Welcome</div><div class=cookie-notice data-main=0>We use cookies to make this page better for you and for all of our many partners</div>
    <main data-main=1><p>Short.</p><p>The text goes on for a while and says what it has to say in a number of words that is not small</p>
    <ul><li>An item</li><li><a href=#>An item that is a link</a></li></ul><p>Then</p><p>it ends.</p>
    <section class=comments data-main=0><p>I liked this article very much and I want to tell you so in a comment with many words</p><p>Me too</p></section></main>
    <div data-main=0>Some words of no account that stand after the main part of the page, and there are quite many of them here too</div>
    <div data-main=0><a href=#>Top</a></div>""",
    """<article data-main=1><p>Lone</p></article><div data-main=0>Other words that stand outside of the article and are as many as in a paragraph of plain text would be</div>
    <div class=sidebar data-main=0>Side</div><div class=related data-main=0>Read this too because it is like what you have just read to the very end of it</div>""",
    """<div data-main=0>Words before the article that are no part of it although there are a good many of them as you can see</div>
    <article data-main=1><p><a href=#>Only a link here</a></p></article><footer data-main=0>Foot</footer>""",
    """<div data-main=0>A long block of plain words stands in front of the article here, and it is as long as any paragraph of an article
    may well be, since it goes on and on about nothing much at all until at last it comes to its end after forty words or so of idle talk</div>
    <article data-main=1><p>The article itself.</p></article>
    <div data-main=0>Another long block of plain words stands behind the article, and it is as long as any paragraph of an article may well be,
    since it goes on and on about nothing much at all until at last it comes to its end after forty words or so of idle talk</div>
    <div data-main=0>And one more remark</div>
    <div data-main=0>The last long block of plain words stands at the very end, and it is as long as any paragraph of an article may well be,
    since it goes on and on about nothing much at all until at last it comes to its end after forty words or so of idle talk</div>""",
    # Pages without an article: plain paragraphs against lists of links and short remarks.
    """<div data-main=0><a href=#>Home</a> <a href=#>News</a> <a href=#>Sport</a> <a href=#>Weather</a></div>
    <div data-main=1><p>This page has no article element, yet its paragraphs are long and hold hardly any links, so they are what the page is about</p>
    <p>Another long paragraph follows the first one, and it also holds a great many words and none of them is a link to elsewhere</p>
    <p>Then there is one between them.</p>
    <p>And a last long paragraph comes with as many words as the others so that it is plain that this is the text of the page</p></div>
    <div data-main=0><a href=#>About us</a> <a href=#>Contact</a></div><div data-main=0>All rights reserved</div>
    <footer data-main=0><p>A footer with very many words in it that says who owns what on this page and who may use it and who may not</p></footer>""",
    """<nav data-main=0><ul><li><a href=#>Start</a><li>Here you are</ul></nav><div data-main=1><p>A long paragraph comes right after the menu and it holds as many
    plain words as a paragraph of a page that is worth its reading would hold, which is to say a good many of them in all</p></div>
    <aside data-main=0><p>Short side note</p><p>A long side note comes after the paragraph and it holds as many plain words as the paragraph did,
    yet it is not what the page is about and nobody would miss it at all</p></aside>""",
    """<ul><li data-main=0><a href=#>One</a></li><li data-main=0><a href=#>Two</a></li><li data-main=0>Three</li></ul>
    <div data-main=0>Search</div><div data-main=1>A single long block of plain text on a page that has nothing else to offer to those who come to it and read</div>
    <div data-main=0>Imprint</div><div class=banner data-main=0>A banner that says many things in many words so that it would pass for a paragraph if it were not named</div>""",
))


def _words(n: int, inside: str = "{}") -> str:
    return " ".join(inside.format("word") for _ in range(n))


def _plain_page(paragraphs: tuple[int, ...], links: tuple[int, int], remarks: tuple[int, int]) -> str:
    """A page without an article: lists of links and remarks around paragraphs of these many words."""
    lists = [_words(n, "<a href=#>{}</a>") for n in links]
    text = "".join(f"<p>{_words(n)}</p>" for n in paragraphs)
    return (f"<div data-main=0>{lists[0]}</div><div data-main=0>{_words(remarks[0])}</div><div data-main=1>{text}</div>"
            f"<div data-main=0>{_words(remarks[1])}</div><div data-main=0>{lists[1]}</div>")


#: Pages without an article whose paragraphs have all lengths, and articles with words of all lengths outside.
LABELLED += tuple(_plain_page(*sizes) for sizes in (
    ((30, 45, 80, 60), (4, 30), (2, 3)), ((25, 12, 38, 90), (40, 12), (3, 2)), ((50, 14, 55, 33), (25, 60), (1, 4)), ((120, 70, 28, 41), (9, 35), (4, 1)),
    ((40, 26, 75), (10, 0), (2, 0)), ((65, 31), (0, 0), (0, 0)), ((48,), (28, 0), (3, 0)), ((36, 58), (0, 45), (0, 2)), ((85,), (0, 0), (0, 0))))
LABELLED += tuple(f"<div data-main=0>{_words(a)}</div><article data-main=1><p>{_words(b)}</p><p>{_words(c)}</p></article><div data-main=0>{_words(d)}</div>"
                  for a, b, c, d in ((35, 3, 40, 60), (80, 25, 1, 28), (45, 70, 12, 33), (55, 8, 30, 90)))


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    in_main: bool = False
    in_boilerplate: bool = False
    label: str | None = None
    text: str = ""
    density: float = 0.0
    words: int = 0

    def closed(self) -> bool:
        """Whether there is any text; white space of all kinds becomes single spaces."""
        words = unescape_all(self.parts).split()
        self.text, self.words = " ".join(words), len(words)
        self.density = min(1.0, len(unescape_all(self.linked).split()) / self.words) if words else 0.0
        return bool(words)


def unescape_all(parts: list[str]) -> str:
    return "".join(unescape(p) if "&" in p else p for p in parts)


@dataclass
class Holder:
    name: str
    in_main: bool
    in_boilerplate: bool
    opaque: bool
    label: str | None


def _named(name: str, main: bool, inside: bool, classes: str, ids: str) -> bool:
    """Whether class or id name boilerplate. Inside an article a word that can be a topic does so only if the whole name does."""
    names = [{p.lower() for p in NAME_PARTS.findall(n)} for n in f"{classes} {ids}".split()]
    if main or name in ("body", "html"):
        return any(parts & {"comment", "comments", "reply", "replies"} for parts in names)
    if not inside:
        return any(parts & NAMES for parts in names)
    if name in HEADINGS:
        names = names[:len(classes.split())]  # the id of a heading is the target of a link
    topic = [{p.lower() for p in NAME_PARTS.findall(n)} for n in ids.split()]
    return any(parts & (NAMES - TOPICS) or (parts & TOPICS and parts <= NAMES | PLAIN and parts not in topic) for parts in names)


def _entered(name: str, attributes: str, outer: Holder) -> Holder:
    found = {n.lower(): (v or "").strip("\"'") for n, v in ATTRIBUTE.findall(attributes)} if attributes else {}
    role = found.get("role", "").lower()
    # A comment is often an article of its own; other names on the main element itself tell of its surroundings.
    main = name in ("article", "main") or role in ("main", "article")
    named = _named(name, main, outer.in_main, found.get("class", ""), found.get("id", ""))
    boilerplate = name in BOILERPLATE or (name == "header" and not outer.in_main) or named or role in ROLES
    hidden = "hidden" in found or found.get("aria-hidden") == "true"
    return Holder(name, outer.in_main or main, outer.in_boilerplate or boilerplate, outer.opaque or hidden or name in OPAQUE, found.get("data-main", outer.label))


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in order. Elements that are left open end with what holds them; stray ends are ignored."""
    out: list[Block] = []
    stack = [Holder("", False, False, False, None)]
    opened: Counter = Counter()  # the names on the stack
    block, links, at, last = Block(), 0, 0, html.rfind(">")

    def add(text: str) -> None:
        if text and not stack[-1].opaque:
            if not block.parts or not block.text:
                block.in_main, block.in_boilerplate, block.label, block.text = stack[-1].in_main, stack[-1].in_boilerplate, stack[-1].label, "open" if text.strip() else ""
            block.parts.append(text)
            if links:
                block.linked.append(text)

    def end_block() -> None:
        nonlocal block
        if block.parts:
            if block.closed():
                out.append(block)
            block = Block()

    def leave() -> str:
        opened[stack[-1].name] -= 1
        return stack.pop().name

    while at < len(html):
        if at > last:  # no tag ends from here on: what looks like one is text, and what a comment hides goes to the end
            cut = UNCLOSED.search(html, at)
            add(html[at:cut.start()] if cut else html[at:])
            if cut and cut[0] != "<!--":
                add(html[cut.end():].replace("&", "&amp;"))
            break
        tag = MARKUP.search(html, at)
        if tag is None:
            add(html[at:])
            break
        add(html[at:tag.start()])
        at = tag.end()
        name = tag["name"]
        if name is None:
            if tag[0].startswith("<![CDATA["):
                add(tag[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        if name in BLOCKS:
            end_block()
            links = 0
            if not tag["close"]:
                while stack[-1].name in LEAVES or stack[-1].name in SIBLINGS.get(name, ()):
                    leave()
        elif name == "br":
            add(" ")
        elif name == "a":
            links = 0 if tag["close"] else 1
            block.linked.append(" ")  # the words of two links are two
        if name in VOID or tag["attributes"].endswith("/") and name in ("svg", "path"):
            continue
        if tag["close"]:
            if opened[name] > 0:
                while leave() != name:
                    pass
        elif name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
        elif name in HOLDERS:
            if name in ("body", "article", "main"):  # whatever was left open before the page's content
                while stack[-1].name == "head":
                    leave()
            stack.append(_entered(name, tag["attributes"], stack[-1]))
            opened[name] += 1
    end_block()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; beyond the ends of the page there are no words."""
    has_main = any(b.in_main for b in blocks)
    sizes = [(0, 0.0), *((b.words, b.density) for b in blocks), (0, 0.0)]
    return np.array([(*sizes[i + 1], *sizes[i], *sizes[i + 2], b.in_main, has_main, b.in_boilerplate) for i, b in enumerate(blocks)], float).reshape(-1, len(FEATURES))


def grow(rows: np.ndarray, labels: np.ndarray) -> tuple | float:
    """A binary tree by Gini impurity: (feature, threshold, at most, above), or the share of main text in a leaf of LEAST_IN_LEAF blocks or more.

    Of equal splits the one on the feature that stands last in FEATURES wins, as what a block stands in tells more than its size.
    """
    share = float(labels.mean())
    impurity = lambda y: len(y) * 2 * y.mean() * (1 - y.mean()) if len(y) else 0.0
    best = (impurity(labels) - 1e-9, None, None)
    for f in reversed(range(rows.shape[1])):
        values = np.unique(rows[:, f])
        for threshold in (values[:-1] + values[1:]) / 2:
            left = rows[:, f] <= threshold
            if min(left.sum(), (~left).sum()) < LEAST_IN_LEAF:
                continue
            now = impurity(labels[left]) + impurity(labels[~left])
            if now < best[0] - 1e-9:
                best = (now, f, float(threshold))
    if best[1] is None:
        return share
    left = rows[:, best[1]] <= best[2]
    return best[1], best[2], grow(rows[left], labels[left]), grow(rows[~left], labels[~left])


@cache
def tree() -> tuple | float:
    """The tree of the labelled pages; small, so each worker grows it for itself."""
    pages = [blocks_of(page) for page in LABELLED]
    return grow(np.concatenate([features(p) for p in pages]), np.array([float(b.label == "1") for p in pages for b in p]))


def is_main(row: list[float]) -> bool:
    node = tree()
    while isinstance(node, tuple):
        feature, threshold, low, high = node
        node = low if row[feature] <= threshold else high
    return node > 0.5


def main_text(html: str) -> str:
    """The main blocks of a page, joined by line breaks in the order of the page."""
    blocks = blocks_of(html)
    return "\n".join(b.text for b, row in zip(blocks, features(blocks).tolist(), strict=True) if is_main(row))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 2, 16 << 20):
        yield record_batch(PAGE, [batch.column(0).to_pylist(), batch.column(1).to_pylist(), [main_text(h or "") for h in batch.column(2).to_pylist()]])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of every row; empty where there is none or the html is null. Other columns are not read."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extract, PAGE)


def page_texts(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
