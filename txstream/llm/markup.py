"""The text blocks of an HTML page, each with its place: in the article, in marked boilerplate, or elsewhere.

A scanner for markup as it is found, well formed or not: comments, raw-text elements, unquoted and odd attributes,
elements that nobody closes. Block elements end a block; line breaks are white space; other elements are transparent.
"""

from __future__ import annotations

import re
from html import unescape

FREE, ARTICLE, BOILERPLATE = 0, 1, 2

_TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_MARKED = re.compile(r"class|id\s*=|role|hidden|itemprop", re.I)
_NAMES = re.compile(r"[^a-z0-9]+")

#: Elements of HTML by what they mean to a reader of the article.
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_RAW = set("iframe noembed noframes noscript script style textarea title xmp".split())
_ASIDE = set("aside button canvas datalist dialog footer form head menu nav object select svg template".split())
#: Elements that hold several blocks: a region of the page each.
_BOXES = set("article aside blockquote body details dialog div dl fieldset footer form header main menu nav ol section table td th ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_WORDS = set(
    "ad ads adsense advert advertisement advertisements adverts advertising alert banner breadcrumb breadcrumbs comment comments commentlist"
    " consent cookie cookies copyright discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices"
    " notification overlay pager pagination popup promo promoted promotion replies respond responses search share sharing sidebar signup skip"
    " social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)


def _role(name: str, attributes: str, within: int) -> int:
    """The place that an element gives to what it holds."""
    if name in ("article", "main"):
        return ARTICLE if within != BOILERPLATE else within
    if name in _ASIDE or name == "header" and within != ARTICLE:
        return BOILERPLATE
    if attributes and name not in ("body", "html") and _MARKED.search(attributes):
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), (a or b or c).lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in _ROLES:
                return BOILERPLATE
            if key == "role" and value in ("main", "article") or key == "itemprop" and value == "articlebody":
                return ARTICLE if within != BOILERPLATE else within
            if key in ("class", "id") and _WORDS.intersection(_NAMES.split(value)):
                return BOILERPLATE
    return within


def blocks(html: str) -> list[tuple[int, str]]:
    """(place, text) of each block that has text: references decoded, white space made single spaces, trimmed."""
    return [(place, text) for place, text, _ in placed(html)]


def placed(html: str) -> list[tuple[int, str, int]]:
    """The blocks with the number of the region, the innermost open box, that each stands in."""
    out: list[tuple[int, str, int]] = []
    boxes: list[tuple[str, int]] = [("", 0)]
    boxed: dict[str, int] = {}
    n_boxes = 0
    held: list[str] = []
    open_: list[list] = []  # elements that change the place: name, place before, open elements of that name within
    place, at, end = FREE, 0, len(html)

    def flush() -> None:
        text = "".join(held)
        text = " ".join((unescape(text) if "&" in text else text).split())
        held.clear()
        if text:
            out.append((place, text, boxes[-1][1]))

    named: dict[str, int] = {}  # open_'s names, and how often

    def push(name: str) -> None:
        open_.append([name, place, 0])
        named[name] = named.get(name, 0) + 1

    def pop(k: int) -> int:
        """Close the elements from the k-th on; the place before them."""
        before = open_[k][1]
        for gone, _, _ in open_[k:]:
            named[gone] -= 1
            if not named[gone]:
                del named[gone]
        del open_[k:]
        return before

    while at < end:
        tag = _TAG.search(html, at)
        if tag is None:
            held.append(html[at:])
            break
        if tag.start() > at:
            held.append(html[at : tag.start()])
        at = tag.end()
        closing, name, attributes = tag.group(1), tag.group(2), tag.group(3)
        if name:
            name = name.lower()
            if name == "br":
                held.append(" ")
                continue
            if name in _RAW and not attributes.endswith("/"):
                close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = close.start() if close else end
                continue
            if name in _VOID:
                if name == "hr":
                    flush()
                continue
            if name in _BLOCKS:
                flush()
                if open_ and open_[-1][0] == "p" or open_ and open_[-1][0] == name == "li":  # these close themselves
                    place = pop(len(open_) - 1)
            if name == "body" and open_ and open_[-1][0] == "head":
                place = pop(len(open_) - 1)
            if name in _BOXES:
                n_boxes += 1
                boxes.append((name, n_boxes))
                boxed[name] = boxed.get(name, 0) + 1
            new = _role(name, attributes, place)
            if new != place:
                flush()
                push(name)
                place = new
            elif name in named:  # its end must not end an element of that name further out
                if open_[-1][0] == name:
                    open_[-1][2] += 1
                else:
                    push(name)
        elif closing:
            name = closing.lower()
            if name in _BLOCKS:
                flush()
            while boxed.get(name):
                gone = boxes.pop()[0]
                boxed[gone] -= 1
                if gone == name:
                    break
            for k in range(len(open_) - 1, -1, -1) if name in named else ():
                if open_[k][0] == name:
                    if k == len(open_) - 1 and open_[k][2]:
                        open_[k][2] -= 1
                    else:
                        flush()
                        place = pop(k)
                    break
    flush()
    return out
