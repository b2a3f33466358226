"""Raw HTML as a tree of block elements and text blocks, read in one pass without recursion."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|</?[a-zA-Z](?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.DOTALL,
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never shown as text: up to the first end tag, or, for those that nest, to their own.
_RAW = frozenset("script style title noscript iframe textarea".split())
_NESTING = frozenset("template svg math object canvas video audio select datalist".split())
_HIDDEN = _RAW | _NESTING
_EDGE = {tag: re.compile(rf"<(/?){tag}(?=[\s/>]|\Z)([^<>]*)", re.IGNORECASE | re.ASCII) for tag in _HIDDEN}
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul label".split()
)
#: What an opening tag closes when it is the innermost open block.
_CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"},
}
_P_STAYS = frozenset({"button", "label", "option", "html", "body", "head"})


@dataclass
class Node:
    """A block element (text None) or a text block."""

    tag: str
    parent: int
    attributes: dict[str, str] = field(default_factory=dict)
    text: str | None = None
    links: int = 0


def _hidden_end(tag: str, html: str, at: int) -> int:
    """Where the end tag of a hidden element begins that was opened before ``at``; the end of the page if there is none."""
    depth = 1
    for m in _EDGE[tag].finditer(html, at):
        if m.group(1):
            depth -= 1
        elif tag in _NESTING and not m.group(2).endswith("/"):
            depth += 1
        if not depth:
            return m.start()
    return len(html)


def parse(html: str | None) -> list[Node]:
    """Nodes in page order, each after its parent; the first is the root.

    Text is decoded, its white space made single spaces; a text block ends where a
    block element begins or ends. Unclosed and stray tags, and a tag cut off at the
    end of the page, are tolerated.
    """
    nodes = [Node("#root", -1)]
    stack, opened = [0], [0]  # open blocks, and links open in each
    inside = Counter({"#root": 1})  # open blocks by tag
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                nodes.append(Node("#text", stack[-1], text=text, links=min(linked, len(text))))
            parts.clear()
            linked = 0

    def leave() -> str:
        tag = nodes[stack.pop()].tag
        opened.pop()
        inside[tag] -= 1
        return tag

    if not html:
        return nodes
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        token, at = m.group(), m.end()
        if token[0] != "<" or token == "<":
            text = unescape(token)
            parts.append(text)
            if opened[-1]:
                linked += len(text.strip())
            continue
        name = _NAME.match(token)
        if not name:
            continue
        tag, closing = name.group(1).lower(), token[1] == "/"
        if token[-1] != ">":  # cut off
            break
        if tag in _HIDDEN:
            if not closing and not token.endswith("/>"):
                at = _hidden_end(tag, html, at)
            continue
        if tag in _BLOCK:
            if closing:
                if inside[tag]:
                    flush()
                    while leave() != tag:
                        pass
                continue
            flush()
            shut = _CLOSES.get(tag) or (() if tag in _P_STAYS else ("p",))
            while len(stack) > 1 and nodes[stack[-1]].tag in shut:
                leave()
            attributes = {}
            if len(token) > len(name.group()) + 1:
                for key, value in _ATTRIBUTE.findall(token, name.end()):
                    attributes[key.lower()] = unescape(value[1:-1] if value[:1] in "\"'" else value)
            nodes.append(Node(tag, stack[-1], attributes))
            stack.append(len(nodes) - 1)
            opened.append(opened[-1])
            inside[tag] += 1
        elif tag == "a":
            opened[-1] = max(0, opened[-1] + (-1 if closing else 1))
        elif tag == "br" or tag in _VOID:
            parts.append(" " if tag == "br" else "")
    flush()
    return nodes
