"""Pages as trees of blocks.

A small tolerant reader: block elements and form controls become nodes, the text between two block borders a leaf.
Inline elements only matter for the share of text in links.  Scripts, styles and the like are skipped as raw text.
Reading is linear in the page, however malformed it is.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTROLS = frozenset("button datalist label meter object optgroup option output progress select svg canvas audio video map".split())
RAW = frozenset("script style noscript template iframe title textarea noframes noembed xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes these if they are open within the given border.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th caption".split()), frozenset(["table"])), "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])), "tfoot": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
}

#: Comments, declarations, end tags, start tags, and a tag cut off by the page's end.
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[a-zA-Z/!?][^>]*+\Z", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|data-main|href)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


@dataclass
class Page:
    """Nodes in page order, the root first; a leaf has ``text``, an element none.  ``mark`` is what the nearest ``data-main``
    around a node says."""

    tag: list[str] = field(default_factory=lambda: ["#page"])
    parent: list[int] = field(default_factory=lambda: [-1])
    names: list[str] = field(default_factory=lambda: [""])
    text: list[str | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])  # characters in links
    inputs: list[int] = field(default_factory=lambda: [0])  # form controls right in a node
    fixed: list[bool] = field(default_factory=lambda: [False])  # inside a form control: never main text
    mark: list[bool] = field(default_factory=lambda: [False])

    def add(self, tag: str, parent: int, names: str, text: str | None, linked: int, fixed: bool, mark: bool) -> int:
        for column, value in zip((self.tag, self.parent, self.names, self.text, self.linked, self.inputs, self.fixed, self.mark), (tag, parent, names, text, linked, 0, fixed, mark)):
            column.append(value)
        return len(self.tag) - 1


def read_page(source: str) -> Page:
    page = Page()
    stack = [0]  # open nodes
    buffer: list[str] = []  # text since the last block border
    links: list[str] = []
    link_at = 0  # depth of the node in which a link is open
    open_tags: Counter[str] = Counter()  # so that a tag that closes nothing need not look through the stack

    def border() -> None:
        nonlocal links
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                top = stack[-1]
                linked = len(" ".join("".join(links).split())) if links else 0
                page.add("#text", top, "", text, min(linked, len(text)), page.fixed[top], page.mark[top])
            buffer.clear()
            links = []

    def close(depth: int) -> None:
        """Close what is open from this place of the stack on."""
        nonlocal link_at
        border()
        open_tags.subtract(page.tag[i] for i in stack[depth:])
        del stack[depth:]
        if link_at > len(stack):
            link_at = 0

    def put(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        buffer.append(text)
        if link_at:
            links.append(text)

    at, end = 0, len(source)
    while at < end:
        m = _TAG.search(source, at)
        if m is None:
            put(source[at:])
            break
        if m.start() > at:
            put(source[at : m.start()])
        at = m.end()
        closing, opening = m.group(1), m.group(2)
        if closing:
            tag = closing.lower()
            if tag == "a":
                link_at = 0
            elif tag in BLOCKS or tag in CONTROLS:
                border()
                if tag == "p":  # closes a paragraph only where one is open just here
                    if page.tag[stack[-1]] == "p":
                        close(len(stack) - 1)
                else:
                    wanted = _HEADINGS if tag in _HEADINGS else (tag,)
                    for i in range(len(stack) - 1, 0, -1) if any(open_tags[t] for t in wanted) else ():
                        if page.tag[stack[i]] in wanted:
                            close(i)
                            break
        elif opening:
            tag = opening.lower()
            if tag in RAW:
                if tag == "textarea":
                    page.inputs[stack[-1]] += 1
                m = _RAW_END[tag].search(source, at)
                at = m.end() if m else end
            elif tag == "br":
                put("\n")
            elif tag == "a":
                link_at = len(stack) if any(n.lower() == "href" for n, *_ in _ATTRIBUTE.findall(m.group(3))) else 0
            elif tag == "input":
                page.inputs[stack[-1]] += 1
            elif tag in BLOCKS or tag in CONTROLS:
                border()
                if page.tag[stack[-1]] == "p" and tag in BLOCKS or page.tag[stack[-1]] in _HEADINGS and tag in _HEADINGS:
                    close(len(stack) - 1)
                if tag in _CLOSES:
                    closed, until = _CLOSES[tag]
                    lowest = len(stack)
                    for i in range(len(stack) - 1, 0, -1) if any(open_tags[t] for t in closed) else ():
                        name = page.tag[stack[i]]
                        if name in until:
                            break
                        if name in closed:
                            lowest = i
                    if lowest < len(stack):
                        close(lowest)
                if tag != "hr":
                    top, names, mark = stack[-1], [], page.mark[stack[-1]]
                    if m.group(3):
                        for name, *values in _ATTRIBUTE.findall(m.group(3)):
                            name = name.lower()
                            if name == "data-main":
                                mark = "".join(values) == "1"
                            elif name == "hidden":
                                names.append("#hidden")
                            elif name != "href":
                                names += values
                    control = tag in CONTROLS
                    if control:
                        page.inputs[top] += 1
                    open_tags[tag] += 1
                    stack.append(page.add(tag, top, " ".join(filter(None, names)), None, 0, control or page.fixed[top], mark))
    border()
    return page
