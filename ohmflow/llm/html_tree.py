"""Trees of block elements and their texts, read from HTML.

Nodes are the block elements and, as leaves, the runs of text between block edges; inline markup is white space or nothing and is only
counted. End tags may be missing: a block ends an open paragraph, a list item, cell, row or term ends the one before it, and an end tag ends
what is still open inside its element. Heads, scripts, styles and other elements whose content is no text of the page are left out.
"""

from __future__ import annotations

import html
import re

#: Elements of HTML by what the parser does with them.
RAW = {"script", "style", "title", "textarea", "template", "noscript", "iframe", "svg", "math", "object", "canvas", "noembed", "noframes", "xmp"}
BLOCKS = {
    "html", "head", "body", "address", "article", "aside", "blockquote", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "label", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Which open elements a start tag ends, up to the element that holds them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
SPACED = {"br", "img", "input", "wbr", "td", "th"}
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SAID = {"class", "id", "role", "aria-label", "itemprop", "data-keep"}


class Node:
    """A block element, or a leaf with a text (tag is empty)."""

    __slots__ = ("chars", "children", "depth", "link_chars", "links", "parent", "tag", "tags", "text", "tokens")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset = frozenset(), text: str = "", link_chars: int = 0):
        self.tag, self.parent, self.tokens, self.text = tag, parent, tokens, text
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.chars, self.link_chars, self.links, self.tags = len(text), link_chars, 0, 0
        if parent:
            parent.children.append(self)


def _tokens(attributes: str) -> frozenset:
    found = {"hidden"} if "hidden" in attributes or "display:none" in attributes.replace(" ", "") else set()
    for name, *values in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        if name.lower() in _SAID:
            said = "".join(values)
            found |= {f"keep={said}"} if name.lower() == "data-keep" else {w.lower() for w in _WORD.findall(said)}
    return frozenset(found)


def parse(page: str) -> Node:
    """The root of a page's tree."""
    root = Node("html", None)
    here, parts, linked, in_link, at = root, [], 0, False, 0

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            Node("", here, text=text, link_chars=min(linked, len(text)))
        parts, linked = [], 0

    def add(piece: str):
        nonlocal linked, here
        if here.tag == "head" and not piece.isspace():
            here = here.parent
        parts.append(html.unescape(piece) if "&" in piece else piece)
        if in_link:
            linked += len(parts[-1].strip())

    for found in iter(lambda: _MARKUP.search(page, at), None):
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.groups()
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag not in BLOCKS:
            here.tags += 1
            if tag == "a":
                in_link = not closing
                here.links += not closing
            if tag in SPACED:
                parts.append(" ")
        elif closing:
            node = here
            while node and node.tag != tag:
                node = node.parent
            flush()
            if node and node.parent:
                here, in_link = node.parent, False
        else:
            flush()
            if here.tag in ("p", "head"):
                here = here.parent
            if tag in ENDS:
                ended, within = ENDS[tag]
                node = here
                while node.parent and node.tag not in within:
                    if node.tag in ended:
                        here = node.parent
                    node = node.parent
            if tag not in ("html", "hr"):
                here = Node(tag, here, _tokens(attributes))
                in_link = False
    if at < len(page):
        add(page[at:])
    flush()
    return root


def in_order(root: Node) -> list[Node]:
    """Nodes with a text inside, parents before children, in page order; the sizes of texts are added up on the way."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(nodes):
        if node.parent:
            up = node.parent
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.links += node.links
            up.tags += node.tags + bool(node.tag)
    return [n for n in nodes if n.chars]
