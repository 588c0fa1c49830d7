"""HTML as flat arrays of nodes in document order: elements and runs of text, many pages at a time.

A forgiving reader for pages as they are found: tags that need no end tag end where the next block begins, end tags
without a start are ignored, comments, scripts, styles and hidden elements leave no text.
"""

from __future__ import annotations

import html
import re

TEXT = "#text"
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())  # their content is not markup
UNSEEN = frozenset("script style title xmp iframe noembed noframes noscript template svg canvas object head".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table caption tbody td textarea tfoot th"
    " thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body button caption html legend optgroup option select tbody td textarea tfoot th thead tr".split())
# What a start tag ends, and where the search for it stops.
ENDS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"),
    "td": ("td th", "table"), "th": ("td th", "table"), "tr": ("tr td th caption", "table"), "tbody": ("tbody thead tfoot tr td th caption", "table"),
    "thead": ("tbody thead tfoot tr td th caption", "table"), "tfoot": ("tbody thead tfoot tr td th caption", "table"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
SCOPE = frozenset("table td th caption button template html".split())
IN_TABLE = frozenset("table caption tbody thead tfoot tr td th".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']*+(?:"[^"]*"|'[^']*'))*+[^>"']*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
NAMING = frozenset("class id role itemprop".split())


class Nodes:
    """Nodes of some pages: lists of equal length, and where each page's nodes begin."""

    def __init__(self):
        self.parent: list[int] = []  # index, -1 for the first node of a page
        self.end: list[int] = []  # index after the last node of the subtree
        self.depth: list[int] = []
        self.tag: list[str] = []
        self.names: list[tuple[str, ...]] = []  # words of class, id, role and itemprop
        self.text: list[str] = []  # of text nodes
        self.block: list[int] = []  # text nodes of one number stand in one line
        self.pages: list[int] = [0]


def _names(attrs: str) -> tuple[tuple[str, ...], bool]:
    """Words of the naming attributes, and whether the element is hidden."""
    out, hidden = [], False
    for key, value in _ATTR.findall(attrs):
        key = key.lower()
        if key in NAMING:
            out += [w.lower() for w in _PART.findall(value)]
        elif key == "hidden" or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
    return tuple(dict.fromkeys(out)), hidden


def read(nodes: Nodes, source: str) -> None:
    """Append the nodes of one page; its first node stands for the whole page."""
    parent, end, depth, tag, names, texts, blocks = nodes.parent, nodes.end, nodes.depth, nodes.tag, nodes.names, nodes.text, nodes.block
    stack: list[int] = []
    opened: dict[str, int] = {}  # open elements by tag, so that a search for a tag that is not open costs nothing
    unseen = block = 0  # open unseen elements; number of the line
    space = False

    def push(name: str, words=()):
        parent.append(stack[-1] if stack else -1)
        depth.append(len(stack))
        tag.append(name)
        names.append(words)
        texts.append("")
        blocks.append(block)
        end.append(0)
        stack.append(len(tag) - 1)
        opened[name] = opened.get(name, 0) + 1

    def pop(to: int):
        nonlocal unseen, block, space
        while len(stack) > to:
            at = stack.pop()
            end[at] = len(tag)
            opened[tag[at]] -= 1
            unseen -= tag[at] in UNSEEN or names[at] == ("hidden",)
            if tag[at] in BLOCK:
                block += 1
                space = False

    def find(wanted, stop) -> int:
        if not any(opened.get(name) for name in wanted):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            if tag[stack[k]] in wanted:
                return k
            if tag[stack[k]] in stop:
                return 0
        return 0

    def write(piece: str):
        nonlocal space
        if unseen or not piece:
            return
        piece = html.unescape(piece)
        if piece.isspace():
            space = True
            return
        parent.append(stack[-1])
        depth.append(len(stack))
        tag.append(TEXT)
        names.append(())
        texts.append(" " + piece if space else piece)
        blocks.append(block)
        end.append(len(tag))
        space = False

    push("#page")
    at, size = 0, len(source)
    seen_head = False
    while at < size:
        found = _TOKEN.search(source, at)
        if found is None:
            write(source[at:])
            break
        if found.start() > at:
            if len(stack) > 1 and tag[stack[-1]] == "head" and not source[at : found.start()].isspace():
                pop(len(stack) - 1)
            write(source[at : found.start()])
        at = found.end()
        close, name, attrs = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if close:
            if name in ("html", "body"):
                continue
            if name == "br":
                space = True
                continue
            stop = frozenset() if name in IN_TABLE else SCOPE if name in BLOCK else BLOCK
            to = find((name,), stop)
            if to:
                pop(to)
            continue
        if name in ("html", "body", "head"):
            if name == "body" and (to := find(("head",), ())):
                pop(to)
            if opened.get(name) or (name == "head" and seen_head):
                continue
            seen_head |= name == "head"
        elif name not in IN_HEAD and (to := find(("head",), ())):
            pop(to)
        if name in ENDS_P and (to := find(("p",), SCOPE)):
            pop(to)
        if name in ENDS:
            while to := find(*ENDS[name]):
                pop(to)
        if name in BLOCK:
            block += 1
            space = False
        words, hidden = _names(attrs) if attrs else ((), False)
        if name in VOID:
            if name == "br":
                space = True
            elif name in ("img", "input", "hr"):
                push(name, words)
                end[stack.pop()] = len(tag)
                opened[name] -= 1
            continue
        if attrs.endswith("/") and name in ("svg", "path"):
            continue
        push(name, ("hidden",) if hidden else words)
        unseen += hidden or name in UNSEEN
        if name in RAW:
            over = re.compile(rf"</{name}\b", re.I).search(source, at)
            if over is None:
                at = size
            else:
                write(source[at : over.start()])
                at = over.start()
    pop(0)
    nodes.pages.append(len(tag))


def lines(texts: list[str], blocks: list[int]) -> str:
    """The text of kept nodes: those of a line put together, white space as one space, lines that are not empty joined by a line feed."""
    out, now, last = [], [], None
    for text, block in zip(texts, blocks, strict=True):
        if block != last:
            out.append("".join(now))
            now, last = [], block
        now.append(text)
    out.append("".join(now))
    return "\n".join(x for x in (" ".join(line.split()) for line in out) if x)
