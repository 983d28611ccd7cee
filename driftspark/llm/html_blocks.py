"""Leaf blocks of a page: runs of text between block-level tags, with what stands above and around them."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup svg math time tt u var wbr".split()
)
# Elements whose content is no markup, and no text of the page.
RAW = frozenset("script style textarea title".split())
# Drawings and formulas: all tags in them are inline, up to a tag of BODY.
FOREIGN = frozenset(("svg", "math"))
BODY = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
# What may stand in a head; any other tag, and text that stands in the head itself, ends it.
HEAD = frozenset("html head title base basefont bgsound link meta style script noscript template noframes".split())
# Content that is not shown, or only in place of the element; hinted as hidden if the element has an end.
UNSHOWN = frozenset("template iframe select canvas audio video".split())
# They stand in a paragraph without ending it.
EMBEDDED = (*sorted(UNSHOWN), "noscript", "object", "svg", "math")
# An opening tag of the first kind ends an open element of the second.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>?", re.DOTALL
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# Words in class, id and role of an element, and what they hint at.
HINTS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup dialog alertdialog paywall",
    "comment": "comment comments commentlist reply replies respond disqus discussion reactions",
    "side": "sidebar aside complementary related recommended widget widgets rail trending popular teaser share social",
    "foot": "footer foot copyright contentinfo colophon legal",
    "head": "header masthead logo topbar hero branding search",
    "main": "content article post entry story main body text articlebody",
}
HINT_OF = {word: hint for hint, words in HINTS.items() for word in words.split()}
SPLIT = re.compile(r"[^a-z]+")


class Block:
    __slots__ = ("text", "tags", "hints", "linked", "label")

    def __init__(self, text: str, tags: tuple[str, ...], hints: frozenset[str], linked: int, label: int):
        self.text, self.tags, self.hints, self.linked, self.label = text, tags, hints, linked, label


def blocks(page: str | None) -> list[Block]:
    """All leaf blocks with text, in page order; character references decoded, white space made single spaces.

    ``label`` is the value of the nearest ``data-main`` above a block (labelled pages have it), else 0.
    """
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], int]] = [("#", frozenset(), 0)]
    text: list[str] = []
    linked = links = foreign = 0
    in_head = False
    lower = ""
    ends: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                out.append(Block(words, tuple(s[0] for s in stack[1:]), stack[-1][1], linked, stack[-1][2]))
            text.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links, foreign, in_head
        for name, _, _ in stack[depth:]:
            links -= name == "a"
            foreign -= name in FOREIGN
            in_head &= name != "head"
        del stack[depth:]

    def end_head() -> None:
        nonlocal in_head
        pop_to(next((i for i, s in enumerate(stack) if s[0] == "head"), len(stack)))
        in_head = False

    at, end = 0, len(page)
    while at < end:
        match = TAG.search(page, at)
        piece = page[at : match.start() if match else end]
        if in_head and stack[-1][0] == "head" and piece.strip():
            end_head()
        if piece and not in_head:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if links:
                linked += len(piece)
        if not match:
            break
        at = match.end()
        if match.group(2) is None:
            continue
        tag = match.group(2).lower()
        inline = tag in INLINE or (foreign and tag not in BODY)
        if match.group(1):
            if not inline:
                flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
                if tag in INLINE and tag not in FOREIGN and stack[depth][0] not in INLINE:
                    break
            continue
        closed = match.group(3).endswith("/")
        if in_head and tag not in HEAD:
            end_head()
        if tag in RAW:
            if not closed:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                # Without an end, a script or style goes to the end of the page; of the others only the tag is left out.
                at = close.end() if close else end if tag in ("script", "style") else at
            if not inline:
                flush()
            continue
        if foreign and tag in BODY:
            pop_to(next(i for i, s in enumerate(stack) if s[0] in FOREIGN))
        if tag == "br":
            text.append(" ")
        if not inline:
            flush()
            if tag in CLOSES:
                _close(stack, CLOSES[tag], ("ul", "ol", "dl", "table", "select"), pop_to)
            elif tag not in EMBEDDED:
                _close(stack, ("p",), ("body", "div", "article", "section", "td", "table", "button", *EMBEDDED), pop_to)
        if tag in VOID or closed:
            continue
        hints, label = stack[-1][1], stack[-1][2]
        if match.group(3):
            more = []
            for name, *values in ATTRIBUTE.findall(match.group(3)):
                name, value = name.lower(), "".join(values).lower()
                if name in ("class", "id", "role", "itemprop"):
                    more += [HINT_OF[w] for w in SPLIT.split(value) if w in HINT_OF]
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                    more.append("hidden")
                elif name == "data-main":
                    label = int(value or 1)
            if more:
                hints = hints.union(more)
        if tag in UNSHOWN:
            if tag not in ends:
                lower = lower or page.lower()
                ends[tag] = lower.rfind(f"</{tag}")
            if ends[tag] >= match.end():
                hints = hints.union(("hidden",))
        stack.append((tag, hints, label))
        in_head |= tag == "head"
        links += tag == "a"
        foreign += tag in FOREIGN
    flush()
    return out


def _close(stack: list, tags: tuple[str, ...], walls: tuple[str, ...], pop_to) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth][0] in tags:
            pop_to(depth)
            return
        if stack[depth][0] in walls:
            return
