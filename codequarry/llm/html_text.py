"""Main text of web pages from flat text blocks and a decision tree.

A page is cut at block-level tags into flat blocks. Each block is described by its words and link
density, those of the block before and after and of the nearest text on either side, what element
it stands in (heading, paragraph or other), whether an article or main element is around it, and
by the regions around it: how many menu, footer and sidebar elements; forms and page headers with
their share of the page's words; what class, id and role names announce, as the share of an
element's names that do, with the words, the share of the page's text and the link density of what
they enclose. A decision tree grown on the blocks of LABELLED, a small table of labelled pages in
which names and densities agree or disagree, decides from all of these; no name decides alone.
Names around an article that holds forty words, or half the page's text, don't count.

Defined results: null and empty pages give an empty text, empty tables no rows; pages cut off in
the middle give what is there, without a half tag at their end; very long pages are read whole;
repeated rows give repeated results; other columns are left out, whatever their names. Ties of
splits go to the feature named first and the lowest cut. Character references are decoded once;
white space inside a block becomes one blank.
"""

from __future__ import annotations

import html as html_lib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

# Elements whose content is no text of the page, those that end a block, those
# that are followed as containers, and names that announce what an element holds.
SILENT = "script style noscript template svg math iframe object title textarea select button canvas audio video head"
BLOCK = "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
CONTAINER = "article aside blockquote body dd details dialog div dl dt fieldset figure footer form header li main menu nav ol section table td th tr ul"
PARAGRAPH = "p blockquote pre li dd dt td th figcaption caption summary"
OUTSIDE = "nav aside footer menu dialog"
INSIDE = "article main"
#: Names of what may be text of its own, of what is mostly links, and of the top of a page or article.
TEXT_NAMES = "ad ads adv advert adverts advertisement advertising aside banner complementary consent contentinfo cookie cookies dialog disclaimer footer gdpr login masthead modal newsletter notice notices outbrain overlay paywall popup promo promoted promotion sidebar signin signup sponsor sponsored subscribe subscription taboola widget widgets"
LINK_NAMES = "breadcrumb breadcrumbs menu nav navbar navigation pager pagination recommended related search share sharing social tags toolbar"
TOP_NAMES = "head header top"
COMMENT_NAMES = "comment comments commentlist disqus replies reply respond responses"
CONTENT_NAMES = "article content entry post story text"
#: Parts of compound names that say nothing.
PLAIN_NAMES = "area bar block box container inner item items left link links list main outer page panel right row section site wrap wrapper"
#: Elements that end an open one of their kind inside the same parent.
ENDED_BY = {"li": "ul ol menu", "dd": "dl", "dt": "dl", "td": "table tr", "th": "table tr", "tr": "table"}

#: Pages whose main blocks begin with a star; {n} stands for n words.
LABELLED = """
<nav><ul><li><a>{1}</a><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul></nav><div class=ad>{6}</div><article><h1>*{8}</h1><p>*{60}<p>*{45}<p>*{3}<p>*{80}</article><footer>{12}</footer>
<nav><a>{1}</a><a>{2}</a></nav><div class=advert>{18}</div><article><h1>*{3}</h1><p>*{12}</article><footer>{4}<a>{1}</a></footer>
<header><a>{2}</a><p>{5}</p></header><main><h1>*{6}</h1><p>*{30}<h2>*{2}</h2><p>*{50}<ul><li>*{6}<li>*{9}<li>*{2}</ul><p>*{25}</main><aside><h3>{2}</h3><p>{40}<p>{22}</aside><footer><p>{30}<p>{8}</footer>
<div id=header><a>{3}</a></div><div class=menu><a>{1}</a> <a>{1}</a> <a>{1}</a></div><div><h1>*{7}</h1><p>*{70}<p>*{40}<p>*{55}<p>*{4}</div><div class=footer>{15}</div>
<div><a>{1}</a> | <a>{1}</a> | <a>{2}</a></div><div><a>{3}</a> <a>{2}</a></div><h1>*{5}</h1><div>*{65}</div><div>*{45}</div><div>*{30}</div><div>{3}</div><div><a>{2}</a> <a>{2}</a></div>
<p><a>{2}</a><p><a>{3}</a><p><a>{1}</a><p><a>{2}</a><h2>*{6}</h2><p>*{35}<p>*{28} <a>{4}</a><p>*{48}<p>*{6}<p><a>{2}</a><p><a>{2}</a><p><a>{3}</a><p>{2}
<form><div><h1>*{5}</h1><p>*{60}<p>*{75}<p>*{50}</div></form><form><p>{3}<p>{2}<p>{5}</form>
<form><p>{6}<p>{2}</form><article><p>*{40}<p>*{20}<form><p>{4}</p></form><p>*{33}</article>
<header><h1>*{6}</h1><p>*{42}<p>*{38}</header><p>*{66}<p>*{51}<div class=comments><h3>{2}</h3><p>{30}<p>{45}<p>{5}</div>
<header><p>{4}</header><header><a>{1}</a> <a>{1}</a></header><div>*{80}</div><div>*{20}</div><footer><p>{3}</footer>
<article><header><h1>*{9}</h1><p>*{4}</header><p>*{55}<blockquote>*{15}</blockquote><p>*{48}<p class=ad>{3}<p>*{39}<p class=comment>{20}<p>*{31}<div id=comments><p>{28}<p>{12}<p>{33}</div></article>
<article><h1>*{4}</h1><p>*{44} <a>{5}</a><p>*<a>{6}</a><p>*{52}<ul><li><a>{4}</a><li><a>{5}</a><li><a>{3}</a><li><a>{6}</a></ul></article><div class=related><h3>{2}</h3><a>{7}</a><a>{8}</a></div>
<article><h2>*{3}</h2><p>*<a>{8}</a><p>*{24}<p>*{3} <a>{2}</a><p>*{61}<div class=share><a>{1}</a> <a>{1}</a></div></article>
<article><p>*{7}<p>*{2}<p>*{12}<p>*{1}<p>*{9}</article><nav><a>{1}</a> <a>{2}</a></nav>
<div class=cookie-banner>{26} <a>{2}</a></div><article><h1>*{7}</h1><p>*{58}<div class=newsletter><h4>{5}</h4><p>{17}</div><p>*{47}</article><div class=sidebar><p>{35}<p>{20}<ul><li><a>{3}</a><li><a>{2}</a></ul></div>
<nav><ul><li><a>{1}</a><li><a>{1}</a></ul></nav><div class=ad>{4}</div><article><h1>*{2}</h1><p>*{2}</article><footer>{11}</footer>
<nav><a>{1}</a></nav><article><h1>*{1}</h1><p>*{5}<p>*{1}</article><footer>{9} <a>{1}</a></footer>
<article><h1>*{3}</h1><p>*{4}</article><footer>{10}</footer>
<div class=ad>{7}</div><article><p>*{1}</article><footer>{3}</footer>
<nav><a>{2}</a></nav><article><h1>*{14}</h1></article><footer>{8}</footer>
<article><h1>*{2}</h1><p>*{1}<p>*{2}<p>*{3}<p>*{1}<p>*{4}<p>*{2}</article>
<article><h3>*{1}</h3><p>*{90}<p>*{1}<h3>*{2}</h3><p>*{70}<p>*{2}</article><div class=tags><a>{1}</a></div>
<main><div>*{4}</div><div>*{60}</div><div>*{2}</div><div>*{35}</div><div>*{1}</div></main>
<article><div>*{1}</div><div>*{3}</div><div>*{5}</div><div>*{2}</div></article><div>{1}</div><div>{3}</div><div>{2}</div>
<p>*{50}<p>*{40}<p>*{2}
<h1>*{3}</h1><p>*{70}<p>*{85}<p>*{4}
<p>*{66}<p>*{2}
<p>*{24}<p>*{95}<p>*{1}<div><a>{1}</a></div>
<article><h1>*{3}</h1><p>*{9} <a>{4}</a><p>*{3}<p>*{14} <a>{5}</a><p>*{2}<p>*{6} <a>{3}</a></article><footer>{6}</footer>
<article><p>*{4} <a>{2}</a><p>*{11} <a>{6}</a><p>*{7}</article><ul><li><a>{2}</a><li><a>{3}</a></ul>
<h1>*{4}</h1><p>*{33}<p>*{45}<p>*{3}<div class=footer>{3}</div>
<nav><a>{1}</a></nav><h1>*{1}</h1><p>*{50}<p>*{40}<p>*{2}<footer>{1}</footer>
<h2>*{8}</h2><p>*{17}<p>*{3}<p>*{29}<p>*{1}<p>*{24}<p>*{5}<div>{2} <a>{2}</a></div>
<p>{2}<p>{3}<p>{1}<p>{2}<ul><li><a>{1}</a><li><a>{2}</a></ul>
<div>{1}</div><p>{2}<h3>{1}</h3><p>{3}<h3>{2}</h3><p>{1}
<p>{1} <a>{1}</a><h2>{2}</h2><p><a>{2}</a><h2>{1}</h2><p><a>{3}</a><p><a>{2}</a>
<table><tr><td><a>{1}</a><td><a>{1}</a></tr></table><table><tr><td>*{90}<tr><td>*{64}</table><table><tr><td>{2}<td>{1}</table>
<h1>*{4}</h1><p>*{22}<p>*{19}<h2>*{2}</h2><p>*{26}<p>*{8}<p>*{31}
<div>{2}</div><div>{4}</div><div><a>{2}</a></div><div>{3}</div><div>{1} <a>{3}</a></div><div>{2}</div>
<p><a>{3}</a><p>{2}<p>{1} <a>{1}</a><p>{3}<p><a>{4}</a>
<ul><li><a>{2}</a> {1}<li><a>{3}</a><li><a>{1}</a> {2}</ul><h3>{2}</h3><ul><li><a>{5}</a><li><a>{4}</a></ul><div>{9} <a>{3}</a></div>
<aside><p>{50}<p>{60}<p>{45}</aside><nav><p>{20}<p>{30}<p>{25}</nav><footer><p>{60}<p>{40}<p>{70}</footer>
<div class=notice><p>{34}<p>{52}</div><div class=popup>{44}</div><p>*{41}<p>*{37}<div class=pagination><a>{1}</a> <a>{1}</a></div>
<article class='post tag-news tags'><h1>*{5}</h1><p>*{30}<p>*{22}<p>*{6}</article><div class=tags><a>{1}</a> <a>{2}</a></div>
<div class=search><article><h1>*{4}</h1><p>*{25}<p>*{48}</article></div><div class=search>{2} <a>{1}</a></div>
<article><p>*{21}<p class='market share'>*{14}<p>*{33}<p class=share><a>{1}</a> <a>{2}</a></article>
<article><p>*{40}<p class='stock search'>*{6}<p>*{18}<p class='topic related'>*{24}<p>*{28}<p class=related><a>{7}</a></article>
<article><h1>*{3}</h1><p>*{26}<ul><li>*<a>{2}</a><li>*<a>{3}</a></ul><p>*{35}<p>*{17}</article>
<article><p>*{19}<ul><li>*<a>{5}</a><li>*<a>{2}</a><li>*<a>{1}</a></ul><p>*{12}<div class=menu><a>{1}</a> <a>{2}</a></div></article>
<h1>*{4}</h1><p>*{36}<ul><li>*<a>{3}</a><li>*<a>{2}</a></ul><p>*{41}<p>*{30}<ul><li><a>{2}</a><li><a>{1}</a></ul>
<form><p>{20}</p></form>
<form><p>{45}<p>{12}</form><article><p>*{30}<p>*{25}</article><form><p>{70}</form>
<form><p>{60}</p></form><p>*{52}<p>*{44}
<div class=menu><h1>*{5}</h1><p>*{62}<p>*{44}<p>*{51}</div><div class=footer>{9}</div>
<div class=widget><h1>*{6}</h1><p>*{58}<p>*{47}<p>*{4}<p>*{66}</div><div class=ad>{12}</div>
<nav><a>{1}</a> <a>{1}</a></nav><div id=sidebar><h1>*{3}</h1><p>*{80}<p>*{39}<p>*{72}</div><footer>{7}</footer>
<div class=promo><p>{26}</div><div class=advert>{40}</div><article><h1>*{4}</h1><p>*{22}<p>*{9}</article>
<div class=banner>{90}</div><article><h1>*{3}</h1><p>*{34}</article><div>{30}</div><div>{25}</div>
<div>{12}</div><article><h1>*{3}</h1><p>*{34}<p>*{60}</article><div>{22}</div><div><p>{31}</div>
<div>{20}</div><article><h1>*{2}</h1><p>*{8}</article><div>{9}</div>
<div><a>{2}</a></div><div>{5}</div><article><p>*{70}<p>*{7}<div>*{40}</div><div>*{6}</div></article><div>{14}</div><div>{2}</div>
<article><p>*{50}<div class=notice>{30}</div><p>*{44}<div class=ad>{9}</div><p>*{12}<div class=sidebar><p>{18}</div></article>
<article><h1>*{7}</h1><div class=ad>{5}</div><p>*{5}<p class=promo>{12}<p>*{9}</article>
<article><h1>*{7}</h1><p class=ad>*{35}<p class=ad>*{44}<p class=ad>*{28}<p class=ad>*{52}</article>
<article><h1>*{7}</h1><div class=widget><p>*{35}<p>*{44}<p>*{28}</div></article><div class=comment-form>{6}</div>
<div class=commentlist><article><p>{30}<p>{20}</article><article><p>{50}</article></div><article><p>*{45}<p>*{60}</article>
<article><p>*{80}<div class=replies><p>{60}<p>{90}<p>{44}</div></article>
<div><a>{1}</a></div><div><a>{2}</a> <a>{1}</a></div><p>*{66}<p>*{73}<p>*{41}<div><a>{2}</a> <a>{1}</a></div>
<div><a>{2}</a> <a>{2}</a></div><div>*{56}</div><div>*{91}</div><div>*{14}</div><div>*{63}</div><div><a>{1}</a></div><div>{6}</div>
<section><h1>*{8}</h1><h2>*{14}</h2><p>*{48}<p>*{33}<figure><figcaption>*{7}</figcaption></figure><p>*{4}<p>*{57}</section><div><h3>{2}</h3><a>{6}</a></div><div>{11}</div>
<h1>*{5}</h1><h3>*{9}</h3><div>*{70}</div><figure><figcaption>*{12}</figcaption></figure><div>*{61}</div><div>*{10}</div><div>*{43}</div><div>{7} <a>{3}</a></div>
<div><a>{1}</a> <a>{1}</a> <a>{1}</a></div><h1>*{9}</h1><p>*{12}<p>*{40}<figcaption>*{5}</figcaption><p>*{36}<p>*{29}<ul><li><a>{6}</a><li><a>{4}</a></ul>
<ul><li><a>{1}</a><li><a>{1}</a></ul><h1>*{7}</h1><p>*{54}<p>*{48}<p>*{3}<div class=sponsored><p>{31}</div><div>{4}</div>
<main><h1>*{4}</h1><p>*{11}<p>*{16}<aside><p>{36}<p>{24}</aside><p>*{19}<p>*{30}</main><footer><p>{21}</footer>
<article><p>*{14}<aside>{40}</aside><p>*{60}<aside><h4>{2}</h4><p>{70}</aside><p>*{25}<footer>{30}</footer></article>
<article><p>*{44}<div class=navigation>{30}</div><p>*{24}<div class=search><p>{22}</div><p>*{18}<div class=related><p>{26}<p>{14}</div></article>
<h1>*{5}</h1><p>*{33}<div class=toolbar><p>{18}</div><p>*{21}<aside>{44}</aside><p>*{38}<div class=newsletter>{27}</div>
<form><div><h1>*{6}</h1><div>*{66}</div><div>*{49}</div></div></form><div class=consent>{24}</div><div class=notice><p>{9}<p>{13}</div>
<article><h1>*{4}</h1><p>*{32}<p>*{28}<div class=ad><p>{15}</div><p>*{20}</article>
<article><h1>*{6}</h1><p>*{35}<p class=sponsored>{28}<p>*{30}<p>*{21}</article>
<article><h1>*{3}</h1><p>*{12}<p>*{9}<div class=menu><p>{40}</div><p>*{88}</article>
<article><h1>*{4}</h1><p>*{60}<p>*{58}<div class=promotion><p>{70}</div><p>*{8}</article>
<article><h1>*{4}</h1><p>*{28}<p>*{34}<p class=notice>{66}<p>*{22}</article>
<article><h1>*{5}</h1><p>*{10}<p>*{11}<div class=search><p>{7}</div><p>*{95}</article>
<article><h1>*{2}</h1><p>*{58}<p class=social>{3}<p>*{62}<div class=tags><p>{4}</div><p>*{9}</article>
<article><p>*{210}<p>*{190}<p class=advert>{14}<p>*{310}<div class=cookies><p>{75}</div><p>*{5}</article>
<article><p>*{18}<div class=pager>{3}</div><p>*{24}<p class=overlay>{10}<p>*{3}<p>*{2}</article>
<aside><article><h3>{4}</h3><p>{18}</article></aside><article><h1>*{4}</h1><p>*{38}</article>
<div class=related><article><h3>{4}</h3><p>{8}</article><article><h3>{5}</h3><p>{9}</article></div><article><h1>*{4}</h1><p>*{70}<p>*{64}</article>
"""
FEATURES = (
    *("structure", "comments", "text_named", "link_named", "named_part", "named_links", "top", "form", "form_words", "form_part"),
    *("inside", "inside_part", "heading", "paragraph", "words", "links", "words_before", "links_before", "words_after", "links_after", "text_before", "text_after"),
)
#: Sizes at which the labelled pages are learned, so that no exact number of words counts.
SIZES = (1.0, 0.7, 1.5)
#: An article with so many words outside links counts whatever the names around it.
ARTICLE_WORDS = 40

_names = lambda s: "|".join(s.split())
_attributes = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_raw = "|".join(rf"<{n}\b{_attributes}>.*?(?:</{n}\s*>|\Z)" for n in "title script style noscript template noframes".split())
#: A head ends before the first text or element that can't stand in it, whether or not it has an end tag.
_head = rf"<head\b{_attributes}>(?:\s++|<!--.*?(?:-->|\Z)|{_raw}|<(?:base|basefont|bgsound|link|meta)\b{_attributes}>|</(?!head\b)[a-zA-Z][^>]*+>|<[!?][^>]*+>)*+(?:</head\s*>)?"
_part = re.compile(
    rf"<!--.*?(?:-->|\Z)|{_head}|<(?:svg|math)\b{_attributes}(?<=/)>|<({_names(SILENT)})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z][^>]*+(?:>|\Z)|</?\Z",
    re.S | re.I,
)
_attr = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_block, _container = frozenset(BLOCK.split()), frozenset(CONTAINER.split())
_outside, _inside = frozenset(OUTSIDE.split()), frozenset(INSIDE.split())
_paragraph, _heading = frozenset(PARAGRAPH.split()), frozenset("h1 h2 h3 h4 h5 h6".split())
_text_names, _link_names, _top_names = frozenset(TEXT_NAMES.split()), frozenset(LINK_NAMES.split()), frozenset(TOP_NAMES.split())
_comment_names = frozenset(COMMENT_NAMES.split())
_content_names, _plain_names = frozenset(CONTENT_NAMES.split()), frozenset(PLAIN_NAMES.split())
_ended_by = {k: frozenset(v.split()) for k, v in ENDED_BY.items()}
_hidden = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])|[-_]+")


class Said(NamedTuple):
    """Shares of an element's names that announce text, links, a top, and whether it holds comments or is hidden."""

    text: float = 0.0
    links: float = 0.0
    top: float = 0.0
    comments: int = 0
    hidden: int = 0


def announces(name: str, attributes: str) -> Said:
    """A compound name is judged by its last telling part, and not at all if a part names the
    content (but for comments)."""
    if not attributes or name in ("html", "body"):
        return Said()
    if _hidden.search(attributes):
        return Said(hidden=1)
    counts, names, comments = [0, 0, 0], 0, 0
    for m in _attr.finditer(attributes):
        for whole in (m[1] or m[2] or m[3] or "").split():
            parts = [x.lower() for x in _camel.split(whole) if x]
            names += 1
            comments |= not _comment_names.isdisjoint(parts)
            telling = [x for x in parts if x not in _plain_names]
            if telling and _content_names.isdisjoint(parts):
                for k, known in enumerate((_text_names, _link_names, _top_names)):
                    counts[k] += telling[-1] in known
    return Said(*(n / max(names, 1) for n in counts), int(comments))


class Region:
    """An element that says something of what it holds."""

    __slots__ = ("above", "name", "said", "words", "linked", "holds_title")

    def __init__(self, above: int, name: str, said: Said) -> None:
        self.above, self.name, self.said = above, name, said
        self.words = self.linked = self.holds_title = 0


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    region: int
    element: str


def regions_and_blocks(page: str) -> tuple[list[Region], list[Block]]:
    """Every block that holds a word, and the regions; region 0 is the page."""
    regions, out = [Region(-1, "", Said())], []
    stack: list[tuple[str, int]] = []  # open containers, and the region around each
    parts: list[str] = []
    at = linked = in_link = region = own = 0
    element = ""

    def end() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                k = min(linked, len(words))
                out.append(Block(" ".join(words), len(words), k, own or region, element))
                regions[own or region].words += len(words)
                regions[own or region].linked += k
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html_lib.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked += len(text.split())

    def opened(name: str, attributes: str) -> int:
        """The region of an element: its own if it says something, else the one around."""
        said = announces(name, attributes)
        if name in ("h1", "main"):
            regions[region].holds_title = 1
        if name not in _outside and name not in _inside and name not in ("form", "header") and not any(said):
            return region
        regions.append(Region(region, name, said))
        return len(regions) - 1

    def leave(name: str) -> None:
        nonlocal region
        while True:
            top, region = stack.pop()
            if top == name:
                return

    for m in _part.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[1] or m[0][:4].lower() in ("<svg", "<mat"):
                parts.append(" ")
            continue
        name = name.lower()
        if name == "a":
            in_link = 0 if m[2] else 1
        elif name == "br":
            parts.append(" ")
        elif name in _block:
            end()
            in_link = own = 0
            element = "" if m[2] else name
            if name not in _container:
                own = 0 if m[2] else opened(name, m[4])
            elif m[2]:
                if any(x[0] == name for x in stack):
                    leave(name)
            elif not m[4].endswith("/"):
                if name in _ended_by:
                    for x in reversed(stack):
                        if x[0] in _ended_by[name]:
                            break
                        if x[0] == name:
                            leave(name)
                            break
                stack.append((name, region))
                region = opened(name, m[4])
    add(page[at:])
    end()
    for r in reversed(regions[1:]):
        above = regions[r.above]
        above.words += r.words
        above.linked += r.linked
        above.holds_title |= r.holds_title
    return regions, out


def blocks(page: str) -> list[Block]:
    return regions_and_blocks(page)[1]


def described(regions: list[Region]) -> list[tuple[float, ...]]:
    """What is around the blocks of each region: the first features, to inside_part."""
    free = [r.words - r.linked for r in regions]
    in_articles = sum(n for r, n in zip(regions, free, strict=True) if r.name in _inside and not _within(regions, r.above))
    whole, articles = max(free[0], 1), in_articles / max(free[0], 1)
    # structure, comments, shares of names, the outermost named region, top, the form, the article
    seen: list[tuple[int, int, float, float, int, float, int, int]] = [(0, 0, 0.0, 0.0, 0, 0.0, 0, 0)]
    out = []
    for i, r in enumerate(regions):
        if i:
            structure, comments, text, links, named, top, form, article = seen[r.above]
            structure += (r.name in _outside) + r.said.hidden
            comments += r.said.comments and not r.holds_title
            counts = r.name in _inside and (free[i] >= ARTICLE_WORDS or 2 * free[i] >= whole)
            if counts:
                text, links, named, top, form = 0.0, 0.0, 0, 0.0, 0
            elif r.said.text or r.said.links:
                text, links, named = max(text, r.said.text), max(links, r.said.links), named or i
            if r.name in _inside:
                article = i
            elif r.name == "form":
                form = form or i
            # the header of an article is its own
            if not counts and not article:
                top = max(top, r.said.top, float(r.name == "header"))
            seen.append((structure, comments, text, links, named, top, form, article))
        structure, comments, text, links, named, top, form, article = seen[i]
        around = max(free[article], 1)
        held = (free[named] / around, regions[named].linked / max(regions[named].words, 1)) if named else (0.0, 0.0)
        out.append((structure, comments, text, links, *held, top, int(form > 0), free[form] if form else 0, free[form] / around if form else 0.0, int(article > 0), free[article] / whole if article else -articles))
    return out


def _within(regions: list[Region], i: int) -> bool:
    while i > 0:
        if regions[i].name in _inside:
            return True
        i = regions[i].above
    return False


def features(regions: list[Region], found: list[Block]) -> list[tuple[float, ...]]:
    around = described(regions)
    article = [0] * len(regions)
    for i, r in enumerate(regions[1:], 1):
        article[i] = i if r.name in _inside else article[r.above]
    near = [(0, 0.0), *((b.words, b.linked / b.words) for b in found), (0, 0.0)]

    def text_on_one_side(order) -> list[int]:
        """Words of the longer of the two nearest blocks of text, in the same article, before each
        block in an order."""
        out, last, where = [0] * len(found), (0, 0), -1
        for i in order:
            b = found[i]
            if article[b.region] != where:
                last, where = (0, 0), article[b.region]
            out[i] = max(last)
            if 2 * b.linked < b.words and not any(around[b.region][:2]):
                last = last[1], b.words
        return out

    before, after = text_on_one_side(range(len(found))), text_on_one_side(range(len(found) - 1, -1, -1))
    return [(*around[b.region], float(b.element in _heading), float(b.element in _paragraph), *near[i + 1], *near[i], *near[i + 2], before[i], after[i]) for i, b in enumerate(found)]


# -- the tree --------------------------------------------------------------------------------


def labelled_blocks(pages: str = LABELLED, sizes: tuple[float, ...] = SIZES) -> list[tuple[tuple[float, ...], int]]:
    """Features and label of every block of the labelled pages, read with blocks of each size."""
    out = []
    for size in sizes:
        for page in pages.strip().splitlines():
            page = re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * max(int(int(m[1]) * size), 1)), page)
            regions, found = regions_and_blocks(page.replace("*<a>", "<a>*"))
            out += list(zip(features(regions, found), (int(b.text.startswith("*")) for b in found), strict=True))
    return out


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int = 14):
    """A binary tree by Gini impurity: (feature, cut, low, high), or a label."""
    ones = sum(y for _, y in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            left = [y for x, y in rows if x[f] <= cut]
            n, a, b = len(rows), sum(left), ones - sum(left)
            gini = 2 * a * (len(left) - a) / len(left) + 2 * b * (n - len(left) - b) / (n - len(left))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, cut)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[0][f] <= cut], depth - 1), grow([r for r in rows if r[0][f] > cut], depth - 1)


def is_main(tree, x: tuple[float, ...]) -> bool:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if x[f] <= cut else high
    return bool(tree)


def main_text(page: str | None, tree) -> str:
    regions, found = regions_and_blocks(page or "")
    return "\n".join(b.text for b, x in zip(found, features(regions, found), strict=True) if is_main(tree, x))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tree = grow(labelled_blocks())

    def run(batch: pa.RecordBatch) -> pa.Table:
        texts = [main_text(page.as_py(), tree) for page in batch.column(2)]
        return pa.table({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(pages.select("page_id", "url", html_col), run, f"page_id {kind}, url string, text string, n_chars long")
