"""Flat text blocks of a web page, with what a classifier may know of each: one pass over the tags, linear in the page.

A block is the text between two block-level tags, inline tags removed, character references decoded, white space
made single and trimmed. One line break inside a block is white space, two in a row end it. Comments, and what stands in elements that hold no
readable text, belong to no block. Unclosed and stray tags are taken as browsers do in the plain cases: a closing tag closes what is
open inside its element, paragraphs and items end where the next begins, and a page may end anywhere.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Element names and words of class and id; fixed values of HTML and of common practice.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
UNREAD = frozenset("script style title textarea noscript iframe template svg math object canvas audio video select datalist noembed noframes xmp".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEM = frozenset("li dt dd td th option".split())
ENDS_ALIKE = {"li": "li", "dt": "dt dd", "dd": "dt dd", "td": "td th", "th": "td th", "tr": "tr td th", "option": "option"}
ASIDE_TAGS = frozenset("nav aside footer menu dialog".split())
#: These may stand around an article as well as in one.
ASIDE_WITHIN = frozenset("header form fieldset label button search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
COMMENT_WORDS = frozenset("respond replies reply disqus discussion".split())
COMMENT_START, ASIDE_STARTS = "comment", ("advert", "adsby", "banner", "breadcrumb", "cookie", "foot", "masthead", "navig", "newsletter", "promo", "recommend", "related", "sidebar", "social", "sponsor", "subscri", "trending")
ASIDE_WORDS = frozenset(
    "nav navbar navi menu submenu topmenu crumbs side rail header topbar ad ads adv adsense consent gdpr ccpa privacy notice notices notification alert popup modal overlay lightbox paywall signup signin login register share sharing sharebar follow suggested popular widget widgets pagination pager paging toolbar copyright legal disclaimer search skip survey form outbrain taboola".split()
)
MAIN_WORDS = frozenset("article post entry story content main body text maincontent articlebody postcontent entrycontent storybody".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    aside: bool
    #: Within an article or main element that is not itself beside the matter.
    inside: bool
    named: bool
    heading: bool
    item: bool
    outside: bool = False


def _marks(tag: str, attributes: str) -> tuple[int, int, int]:
    """Whether an element is beside the matter for certain, by its name only, and whether it names the matter."""
    hard = int(tag in ASIDE_TAGS)
    soft = int(tag in ASIDE_WITHIN)
    main = 0
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            words = {w.lower() for w in _PARTS.findall(value)} if name in ("class", "id") else ()
            value = value.lower()
            if name == "role":
                hard |= value in ASIDE_ROLES
                main |= value == "main"
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
                hard = 1
            elif name in ("class", "id"):
                hard |= any(w in COMMENT_WORDS or w.startswith(COMMENT_START) for w in words)
                soft |= any(w in ASIDE_WORDS or w.startswith(ASIDE_STARTS) for w in words)
                main |= 2 * (any(w in MAIN_WORDS for w in words))
    return hard, soft, main & 1 if hard or soft else main


_FORM_END = re.compile(r"</form\b", re.I)


def _holds_most(page: str, at: int) -> bool:
    """Whether the form that begins here is a wrapper of the page."""
    end = _FORM_END.search(page, at)
    return 2 * ((end.start() if end else len(page)) - at) > len(page)


def blocks(page: str) -> list[Block]:
    found: list[Block] = []
    # Open block elements: name, what they add to the counts below, and the soft count to return to.
    stack: list[tuple[str, int, int, int, int, int]] = []
    open_tags: Counter = Counter()
    hard = soft = inside = named = 0
    link = False
    parts: list[tuple[str, bool]] = []
    breaks = 0

    def flush():
        nonlocal breaks
        breaks = 0
        if not parts:
            return
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            words = text.count(" ") + 1
            linked = len(" ".join(t for t, of_link in parts if of_link).split())
            top = [s[0] for s in stack[-3:]]
            found.append(Block(text, words, min(linked, words), hard + soft > 0, inside > 0, named > 0, any(t in HEADING for t in top), any(t in ITEM for t in top)))
        parts.clear()

    def pop():
        nonlocal hard, soft, inside, named, link
        tag, of_hard, soft_before, of_inside, of_named, of_link = stack.pop()
        open_tags[tag] -= 1
        hard, soft, inside, named, link = hard - of_hard, soft_before, inside - of_inside, named - of_named, bool(of_link)

    at = 0
    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            text = html.unescape(text)
            parts.append((text, link))
            if breaks and not text.isspace():
                breaks = 0
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                link = False
            elif tag in BLOCK:
                flush()
                if open_tags[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            continue
        if tag in UNREAD:
            if not m.group(3).endswith("/") or tag not in ("svg", "math"):
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
            if tag not in ("script", "style", "noscript", "svg", "math", "template"):
                flush()
            continue
        if tag == "a":
            link = True
        elif tag == "br":
            breaks += 1
            parts.append((" ", link))
            if breaks > 1:
                flush()
        elif tag == "hr":
            flush()
        elif tag in BLOCK:
            flush()
            while stack and stack[-1][0] == "p":
                pop()
            alike = ENDS_ALIKE.get(tag, "").split()
            while stack and stack[-1][0] in alike:
                pop()
            of_hard, of_soft, main = (0, 0, 0) if tag in ("html", "body") else _marks(tag, m.group(3))
            if (tag == "header" and inside) or (tag == "form" and _holds_most(page, at)):
                of_soft = 0
            central = tag in ("article", "main") or main & 1
            of_inside = int(central and not of_hard and not hard)
            stack.append((tag, of_hard, soft, of_inside, main >> 1, link))
            open_tags[tag] += 1
            # A wrapper may be named for what it wraps beside the article; the article itself starts afresh.
            soft = 0 if of_inside else soft + of_soft
            hard, inside, named = hard + of_hard, inside + of_inside, named + (main >> 1)
    flush()
    # Where most of what is not set aside stands in elements named for the matter, these stand for an article.
    central = sum(b.words for b in found if b.named and not b.aside) * 2 >= sum(b.words for b in found if not b.aside)
    if any(b.inside for b in found):
        for b in found:
            b.outside = not b.inside
    elif central and any(b.named for b in found):
        for b in found:
            b.outside = not b.named
    return found
