"""HTML tree construction on the standard library only.

A single regular expression tokenises the page; a small set of the HTML5 tree
rules is applied on top of it: void and raw-text elements, implied end tags
(``p``, ``li``, ``dt``/``dd``, table parts, ``option``), re-opening of
formatting elements that were left open across a block, and foster parenting
of content put straight into a table.  The functions here know nothing about
Spark; operators call them inside Arrow batches.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*>?"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
UNSEEN = frozenset("head script style template noscript title svg select textarea iframe object embed audio video math".split())
_CLOSES_P = BLOCKS - frozenset("body html li td th tr tbody thead tfoot caption option optgroup legend dd dt".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: For an implied end tag: what the new tag closes, and where the search for it stops.
_IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu table td th body".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th body".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th body".split())),
    "option": (frozenset(["option"]), frozenset("select datalist body".split())),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset("table tbody thead tfoot body".split())),
    "td": (frozenset(["td", "th"]), frozenset("tr table body".split())),
    "th": (frozenset(["td", "th"]), frozenset("tr table body".split())),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset("table body".split())),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset("table body".split())),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset("table body".split())),
}
_SCOPE = frozenset("table td th caption body html button template".split())
#: Deeper elements stay siblings of the last one that fits, as in browsers, so that no page can exhaust the stack.
MAX_DEPTH = 400
_CLOSES_LOST = frozenset(["td", "th", "caption", "table"])
_TABLE_PARENTS = frozenset("table tbody thead tfoot tr".split())
_TABLE_CHILDREN = frozenset("caption colgroup col tbody thead tfoot tr td th script style template".split())
_TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
_HEAD_TAGS = frozenset("base link meta title style script template noscript".split())


class Node:
    """An element. ``children`` holds elements and strings (entities decoded)."""

    __slots__ = ("_attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: "dict[str, str] | str", parent: "Node | None"):
        self.tag, self._attrs, self.parent = tag, attrs, parent
        self.children: list = []

    @property
    def attrs(self) -> dict[str, str]:
        """Attributes by lower-case name; the source is only taken apart when they are asked for."""
        if type(self._attrs) is str:
            self._attrs = _attributes(self._attrs)
        return self._attrs

    def has(self, name: str) -> bool:
        """Whether there is an attribute of the (lower-case) name; the source is only taken apart where the name occurs in it."""
        raw = self._attrs
        return bool(raw) and name in (raw.lower() if type(raw) is str else raw) and name in self.attrs

    @property
    def hidden(self) -> bool:
        return self.has("hidden")

    def iter(self) -> Iterator["Node"]:
        """This element and its descendants, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if type(c) is Node)

    def elements(self) -> list["Node"]:
        return [c for c in self.children if type(c) is Node]

    def find(self, tag: str) -> "Node | None":
        return next((n for n in self.iter() if n.tag == tag), None)

    def text(self) -> str:
        """textContent, in document order."""
        out: list[str] = []
        stack: list = [self]
        while stack:
            node = stack.pop()
            if type(node) is str:
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(out)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def ancestors(self) -> Iterator["Node"]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw == "/":
        return {}
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(raw):
        value = double or single or bare
        if name.lower() not in out:
            out[name.lower()] = _html.unescape(value) if "&" in value else value
    return out


def parse(source: str | None) -> Node:
    """The document element of a page. Null and empty sources give an empty html > head, body."""
    root = Node("html", {}, None)
    head = Node("head", {}, root)
    body = Node("body", {}, root)
    root.children = [head, body]
    if not source:
        return root
    stack = [root, body]
    in_body = in_head = False
    lost: list[Node] = []  # formatting elements to open again
    pos, n = 0, len(source)
    search = _TOKEN.search

    def add_text(text: str) -> None:
        nonlocal in_body, in_head
        if "&" in text:
            text = _html.unescape(text)
        if not in_body:
            if not text.strip():
                return
            in_body = True
            in_head = False
        where = stack[-1]
        if where.tag in _TABLE_PARENTS and text.strip():
            where = foster(text)
            return
        if lost and text.strip():
            reopen()
            where = stack[-1]
        kids = where.children
        if kids and type(kids[-1]) is str:
            kids[-1] += text
        else:
            kids.append(text)

    def foster(child: "Node | str") -> Node:
        """Puts content that stands straight in a table before that table."""
        table = next((x for x in reversed(stack) if x.tag == "table"), None)
        if table is None or table.parent is None:
            stack[-1].children.append(child)
            return stack[-1]
        where = table.parent
        kids = where.children
        at = next(i for i in range(len(kids) - 1, -1, -1) if kids[i] is table)
        kids.insert(at, child)
        if type(child) is Node:
            child.parent = where
        return where

    def reopen() -> None:
        for old in lost:
            node = Node(old.tag, old._attrs, stack[-1])
            stack[-1].children.append(node)
            stack.append(node)
        lost.clear()

    def pop_to(index: int) -> None:
        """Closes the open elements from ``index`` on; open formatting elements among them are kept for later."""
        for x in stack[index + 1 :]:
            if x.tag in FORMATTING:
                lost.append(x)
        del stack[index:]

    def close_p() -> None:
        for i in range(len(stack) - 1, 0, -1):
            t = stack[i].tag
            if t == "p":
                pop_to(i)
                return
            if t in _SCOPE:
                return

    while pos < n:
        m = search(source, pos)
        if m is None:
            rest = source[pos:]
            add_text(rest)
            break
        s = m.start()
        if s > pos:
            add_text(source[pos:s])
        pos = m.end()
        end_tag, tag, raw = m.groups()
        if tag is not None:
            tag = tag.lower()
            if tag in ("html", "body"):
                node = root if tag == "html" else body
                for k, v in _attributes(raw).items():
                    node.attrs.setdefault(k, v)
                if tag == "body":
                    in_body, in_head = True, False
                continue
            if tag == "head":
                in_head = not in_body
                continue
            if not in_body:
                if tag in _HEAD_TAGS:
                    node = Node(tag, raw, head)
                    head.children.append(node)
                    if tag in RAW or tag in ("template", "noscript"):
                        end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, pos)
                        inner = source[pos : end.start() if end else n]
                        if inner:
                            node.children.append(_html.unescape(inner) if tag == "title" else inner)
                        pos = end.end() if end else n
                    continue
                in_body, in_head = True, False
            if tag in _TABLE_PARTS and not any(x.tag == "table" for x in stack):
                continue  # parts of a table outside one are no elements
            if tag in _CLOSES_P:
                close_p()
                if tag in _HEADINGS and stack[-1].tag in _HEADINGS:
                    pop_to(len(stack) - 1)
            elif tag in _IMPLIED:
                closes, stops = _IMPLIED[tag]
                if tag in ("li", "dt", "dd"):
                    for i in range(len(stack) - 1, 1, -1):
                        t = stack[i].tag
                        if t in closes:
                            pop_to(i)
                            break
                        if t in stops:
                            break
                    close_p()
                else:
                    low = None
                    for i in range(len(stack) - 1, 1, -1):
                        t = stack[i].tag
                        if t in closes:
                            low = i
                        elif t in stops:
                            break
                    if low is not None:
                        pop_to(low)
                        if tag in ("td", "th", "tr"):
                            lost.clear()
            elif tag == "a":
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "a":
                        pop_to(i)
                        break
                    if stack[i].tag in _SCOPE:
                        break
                lost[:] = [x for x in lost if x.tag != "a"]
            if tag == "tr" and stack[-1].tag == "table":
                row_group = Node("tbody", {}, stack[-1])
                stack[-1].children.append(row_group)
                stack.append(row_group)
            if lost and tag not in BLOCKS and tag not in ("script", "style", "template"):
                reopen()
            node = Node(tag, raw, stack[-1])
            if stack[-1].tag in _TABLE_PARENTS and tag not in _TABLE_CHILDREN:
                foster(node)
            else:
                stack[-1].children.append(node)
            if tag in VOID or len(stack) > MAX_DEPTH:
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, pos)
                inner = source[pos : end.start() if end else n]
                if inner:
                    node.children.append(_html.unescape(inner) if tag in ("title", "textarea") else inner)
                pos = end.end() if end else n
                continue
            stack.append(node)
            if tag == "pre" and source[pos : pos + 1] == "\n":
                pos += 1
            continue
        tag = end_tag
        if tag is None:  # comment, doctype, processing instruction
            continue
        tag = tag.lower()
        if tag == stack[-1].tag and len(stack) > 2:  # closes what was opened last, as most end tags do
            stack.pop()
            if lost:
                if tag in _CLOSES_LOST:
                    lost.clear()
                elif tag in FORMATTING:
                    for i in range(len(lost) - 1, -1, -1):
                        if lost[i].tag == tag:
                            del lost[i]
                            break
            continue
        if tag in ("html", "body", "head"):
            if tag == "head":
                in_head = False
            continue
        if tag == "br":
            stack[-1].children.append(Node("br", {}, stack[-1]))
            continue
        if tag == "p" and not any(x.tag == "p" for x in stack):
            continue
        if tag in FORMATTING:
            for i in range(len(stack) - 1, 1, -1):
                x = stack[i]
                if x.tag == tag:
                    later = [y for y in stack[i + 1 :] if y.tag not in FORMATTING]
                    if not later:
                        pop_to(i)
                    else:  # closed across a block: the block stays open, the formatting ends here
                        del stack[i]
                    break
                if x.tag in _SCOPE:
                    break
            else:
                pass
            for i in range(len(lost) - 1, -1, -1):
                if lost[i].tag == tag:
                    del lost[i]
                    break
            continue
        if tag in _HEADINGS:
            for i in range(len(stack) - 1, 1, -1):
                if stack[i].tag in _HEADINGS:
                    pop_to(i)
                    break
                if stack[i].tag in _SCOPE:
                    break
            continue
        for i in range(len(stack) - 1, 1, -1):
            t = stack[i].tag
            if t == tag:
                pop_to(i)
                if tag in _CLOSES_LOST:
                    lost.clear()
                break
            if t in ("td", "th", "body") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                break
    return root


def body_of(root: Node) -> Node:
    return root.children[1]


_SPACES = re.compile(r"[\s ]+")


def squeeze(text: str) -> str:
    """Runs of white space, no-break spaces included, become one space; ends are trimmed."""
    return " ".join(text.split())


class Line:
    """A leaf block of a page: its text and what the page says about its place."""

    __slots__ = ("code", "index", "link", "node", "pre", "text")

    def __init__(self, node: Node, text: str, link: int, pre: bool, code: list[tuple[int, int]], index: int):
        self.node, self.text, self.link, self.pre, self.code, self.index = node, text, link, pre, code, index

    def outside_code(self) -> str:
        """The text without its code spans; a pre is all code."""
        if self.pre:
            return ""
        if not self.code:
            return self.text
        out, at = [], 0
        for a, b in self.code:
            out.append(self.text[at:a])
            at = b
        out.append(self.text[at:])
        return "￼".join(out)


def lines_of(body: Node, every: bool = True) -> list[Line]:
    """The visible lines of a page, in order, one for each run of inline content.

    A run of inline content ends at a block-level element's start or end.  Within a
    line, white space is squeezed, except that ``pre`` keeps its line breaks.  ``link``
    counts characters inside ``a``; ``code`` lists spans of the text that stand in
    inline code.  With ``every`` false only elements without block-level descendants
    give lines.
    """
    out: list[Line] = []
    parts: list[tuple[str, bool, bool]] = []  # text, in a link, in code

    def flush(owner: Node, pre: bool) -> None:
        if not parts:
            return
        if pre:
            text = "".join(p[0] for p in parts).strip("\n")
            text = "\n".join(x.rstrip() for x in text.split("\n"))
            if text.strip():
                out.append(Line(owner, text, sum(len(p[0]) for p in parts if p[1]), True, [], len(out)))
            parts.clear()
            return
        if len(parts) == 1:  # plain text, as most lines are
            raw, linked, coded = parts[0]
            parts.clear()
            text = " ".join(raw.split())
            if text:
                out.append(Line(owner, text, len(text) if linked else 0, False, [(0, len(text))] if coded else [], len(out)))
            return
        text, link, code, space = "", 0, [], False
        chunks: list[str] = []
        length = 0
        for raw, linked, coded in parts:
            lead = raw[:1].isspace()
            words = raw.split()
            if not words:
                space = space or bool(raw)
                continue
            if (space or lead) and length:
                chunks.append(" ")
                length += 1
            piece = " ".join(words)
            chunks.append(piece)
            if linked:
                link += len(piece)
            if coded:
                if code and code[-1][1] == length:
                    code[-1] = (code[-1][0], length + len(piece))
                else:
                    code.append((length, length + len(piece)))
            length += len(piece)
            space = raw[-1:].isspace()
        text = "".join(chunks)
        if text:
            out.append(Line(owner, text, link, False, code, len(out)))
        parts.clear()

    def walk(node: Node, owner: Node, linked: bool, pre: bool, coded: bool) -> None:
        for c in node.children:
            if type(c) is str:
                parts.append((c, linked, coded))
                continue
            tag = c.tag
            if tag in UNSEEN or (c._attrs and c.hidden):
                continue
            if tag == "br":
                parts.append(("\n", linked, coded))
            elif tag == "img" or tag == "input" or tag == "hr":
                continue
            elif tag in BLOCKS:
                flush(owner, pre)
                p = pre or tag == "pre"
                walk(c, c, linked, p, coded)
                flush(c, p)
            else:
                walk(c, owner, linked or tag == "a", pre, coded or tag in ("code", "kbd", "samp", "tt"))

    walk(body, body, False, False, False)
    flush(body, False)
    if every:
        return out
    return [x for x in out if not any(d.tag in BLOCKS for d in x.node.iter() if d is not x.node)]


def leaf_blocks(body: Node) -> list[str]:
    """Squeezed visible text of every block-level element below ``body`` that holds no other, in order.

    Inline tags are dropped, entities decoded; elements that are never seen give nothing.
    """
    out: list[str] = []

    def walk(node: Node, parts: list[str]) -> bool:
        """Whether ``node`` holds a block; its own inline text goes to ``parts``."""
        holds = False
        for c in node.children:
            if type(c) is str:
                parts.append(c)
            elif c.tag in UNSEEN or c.hidden:
                continue
            elif c.tag == "br":
                parts.append(" ")
            elif c.tag in BLOCKS:
                holds = True
                own: list[str] = []
                at = len(out)
                if not walk(c, own):
                    text = squeeze("".join(own))
                    if text:
                        out.insert(at, text)
            elif walk(c, parts):
                holds = True
        return holds

    walk(body, [])
    return out
