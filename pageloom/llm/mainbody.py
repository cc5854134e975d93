"""Main body of a page by line-block distribution (problem 3).

The page is stripped of markup into visible lines; the cells of a table row are one line.
Each line weighs its text outside links, and lines of navigation, footers and the like
weigh nothing.  The weights are summed over a sliding window of lines.  The body begins
where the sums surge and ends where they dive; of several such stretches the one with most
text is the body's.  Its text is kept: the smallest element that holds nearly all of the
stretch's text joins to it what stands just outside (headings, short items), and the same
distribution is then read once more inside: a box whose own window sums never surge beside
those of the element around it is a dive, and its lines are left out, at every depth.
Without a container the stretch itself is the body.
"""

from __future__ import annotations

import re

from ..html.tree import BLOCKS, Line, Node, body_of, lines_of, parse

WINDOW = 3
#: The part of the largest window sum that a window must reach to belong to a surge, and the least sum of all.
SURGE, LEAST = 0.18, 24
#: The part of the stretch's text that its container holds.
HELD = 0.7
#: A box is a dive where its largest window sum is under this part of that of the element around it ...
DIVE = 0.5
#: ... and, where such boxes hold this part of the text or more, the body is made of boxes: half of it then, or under half of the usual box and as short as that.
PARTS, SHORT_BOX = 0.3, 150
#: Wide scripts say as much with fewer characters.
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")
_BOXES = frozenset("div section aside form header footer nav details dialog fieldset".split())
_LEAVES = frozenset("p li ul ol tr pre h1 h2 h3 h4 h5 h6 blockquote dl dd dt".split())
_FURNITURE_TAGS = frozenset("nav footer aside dialog".split())
_FURNITURE_ROLES = frozenset("navigation contentinfo complementary dialog banner search alertdialog".split())


def weight(line: Line) -> float:
    """Characters outside links; wide characters count two and a half."""
    n = len(line.text) - line.link
    if n <= 0:
        return 0.0
    if line.text.isascii():
        return float(n)
    wide = len(_WIDE.findall(line.text))
    return n + 1.5 * wide * n / len(line.text)


def blocks_of(weights: list[float], window: int = WINDOW) -> list[float]:
    """The window sums: element i is the text in lines i to i + window - 1."""
    out, total = [], sum(weights[:window])
    for i in range(len(weights)):
        out.append(total)
        total -= weights[i]
        if i + window < len(weights):
            total += weights[i + window]
    return out


def stretches(weights: list[float], window: int = WINDOW) -> list[tuple[int, int]]:
    """Surge and dive points as half-open ranges of lines, in order.

    A surge is the first line whose window reaches the threshold after one that does not;
    a dive is the first line after it from which the next window holds less.
    """
    sums = blocks_of(weights, window)
    if not sums:
        return []
    least = max(LEAST, SURGE * max(sums))
    out, start = [], None
    for i, s in enumerate(sums):
        if s >= least:
            if start is None:
                start = i
        elif start is not None:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, len(sums)))
    return out


class Page:
    """A parsed page: its lines with their weights, which of them are the main body, and the body's container."""

    __slots__ = ("body", "box", "lines", "main", "root", "weights")

    def __init__(self, source: str | None):
        self.root = parse(source)
        self.body = body_of(self.root)
        self.lines = lines_of(self.body)
        self.weights = [weight(x) for x in self.lines]
        self.main, self.box = _main(self.lines, self.weights, self.body)

    def main_lines(self) -> list[Line]:
        return [x for x, keep in zip(self.lines, self.main) if keep]


def _furniture(node: Node) -> bool:
    if node.tag in _FURNITURE_TAGS:
        return True
    return node.has("role") and node.attrs.get("role", "").lower() in _FURNITURE_ROLES


class _Paths:
    """The elements from the body down to a line's owner, and whether one of them is furniture; shared by lines of one owner."""

    def __init__(self, body: Node):
        self.known: dict[int, tuple[tuple[Node, ...], bool]] = {id(body): ((body,), False)}

    def of(self, node: Node) -> tuple[tuple[Node, ...], bool]:
        missing = []
        while id(node) not in self.known:
            missing.append(node)
            node = node.parent
        path, out = self.known[id(node)]
        for x in reversed(missing):
            path, out = (*path, x), out or _furniture(x)
            self.known[id(x)] = (path, out)
        return path, out


def _rows(lines: list[Line], paths: list[tuple[Node, ...]]) -> list[tuple[int, int]]:
    """Half-open ranges of lines: the cells of a table row together, every other line for itself."""
    out: list[tuple[int, int]] = []
    last = None
    for i, x in enumerate(lines):
        row = next((a for a in reversed(paths[i]) if a.tag == "tr"), None) if x.node.tag in ("td", "th") else None
        if row is not None and row is last:
            out[-1] = (out[-1][0], i + 1)
        else:
            out.append((i, i + 1))
        last = row
    return out


def _stretch(weights: list[float], rows: list[tuple[int, int]]) -> tuple[int, int]:
    """The lines between the surge and the dive point with most text between them."""
    found = [(rows[a][0], rows[b - 1][1]) for a, b in stretches([sum(weights[a:b]) for a, b in rows])]
    if not found:  # too little text for a surge: the heaviest line
        top = max(range(len(weights)), key=lambda i: (weights[i], -i))
        return top, top + 1
    return max(found, key=lambda r: (sum(weights[r[0] : r[1]]), -r[0]))


def _container(weights: list[float], paths: list[tuple[Node, ...]], body: Node, start: int, end: int) -> Node:
    """The smallest element that holds nearly all of the text in lines ``start`` to ``end``; the page's body where its loose text outweighs every branch."""
    box, depth, inside = body, 0, range(start, end)
    while True:
        held: dict[int, float] = {}
        child: dict[int, Node] = {}
        for i in inside:
            if len(paths[i]) > depth + 1:
                a = paths[i][depth + 1]
                child[id(a)] = a
                held[id(a)] = held.get(id(a), 0.0) + weights[i]
        if not held:
            return box
        whole = {k: v for k, v in held.items() if child[k].tag in BLOCKS and child[k].tag not in _LEAVES}
        if not whole:
            return box
        best = max(whole, key=lambda k: whole[k])
        here, loose = child[best], sum(held.values()) - sum(whole.values())
        # A short body is no large part of a stretch that runs on into the footer: among branches right below the page's body the heaviest does.
        if held[best] < loose or (box is not body and held[best] < HELD * sum(weights[i] for i in inside)):
            return box
        box, depth = here, depth + 1
        inside = [i for i in inside if len(paths[i]) > depth and paths[i][depth] is box]


def _dives(parent: Node, boxes: list[Node], held: dict[int, list[float]]) -> list[Node]:
    """Those of the boxes right below a part of the body whose windows never surge."""
    peak = {id(a): max(blocks_of(held[id(a)])) for a in (parent, *boxes)}
    furniture = [a for a in boxes if _furniture(a)]
    rest = [a for a in boxes if not _furniture(a)]
    flat = [a for a in rest if peak[id(a)] < max(LEAST, DIVE * peak[id(parent)])]
    total = {id(a): sum(held[id(a)]) for a in (parent, *rest)}
    if flat and sum(total[id(a)] for a in flat) >= PARTS * total[id(parent)]:
        least = max(LEAST, 0.5 * DIVE * peak[id(parent)])
        usual = sorted(total[id(a)] for a in rest)[len(rest) // 2]
        flat = [a for a in flat if peak[id(a)] < least or (total[id(a)] < SHORT_BOX and total[id(a)] < 0.5 * usual)]
    return furniture + flat


def _main(lines: list[Line], weights: list[float], body: Node) -> tuple[list[bool], Node]:
    keep = [False] * len(lines)
    known = _Paths(body)
    both = [known.of(x.node) for x in lines]
    paths = [p for p, _ in both]
    here = [0.0 if out else w for w, (_, out) in zip(weights, both)]
    if not any(here):  # nothing but links: their text counts
        here = [0.0 if out else float(len(x.text)) for x, (_, out) in zip(lines, both)]
        if not any(here):
            return keep, body
    start, end = _stretch(here, _rows(lines, paths))
    box = _container(here, paths, body, start, end)
    depth = len(known.of(box)[0])
    chains: list[list[Node] | None] = []  # the boxes around each line, from the container down
    held: dict[int, list[float]] = {}
    below: dict[int, dict[int, Node]] = {}
    for w, p in zip(here, paths):
        inside = len(p) >= depth and p[depth - 1] is box
        chain = [box, *(a for a in p[depth:] if a.tag in _BOXES)] if inside else None
        chains.append(chain)
        for k, a in enumerate(chain or []):
            held.setdefault(id(a), []).append(w)
            if k:
                below.setdefault(id(chain[k - 1]), {})[id(a)] = a
    dives: set[int] = set()
    waiting = [box]
    while waiting:
        parent = waiting.pop()
        boxes = list(below.get(id(parent), {}).values())
        if boxes:
            dives.update(map(id, _dives(parent, boxes, held)))
            waiting += [a for a in boxes if id(a) not in dives]
    for i, chain in enumerate(chains):
        if chain is not None and not any(id(a) in dives for a in chain):
            keep[i] = box is not body or (start <= i < end and not both[i][1])
    return keep, box


def main_text(page: Page) -> str:
    """The main body, one block a line: rows of a table and lines of a code sample are one line each."""
    out: list[str] = []
    row: Node | None = None
    for x in page.main_lines():
        this = next((a for a in (x.node, *x.node.ancestors()) if a.tag == "tr"), None)
        if this is not None and this is row:
            out[-1] += " " + x.text
            continue
        inside = this is not None and any(a is page.box for a in this.ancestors())
        row = this if inside else None
        out.extend(x.text.split("\n") if x.pre else [x.text])
    return "\n".join(out)


_DROP = re.compile(r"[|\u200b\u200c\u200d\u00ad]+")


def fold(text: str) -> str:
    """A line's comparison form: no white space, cell rules or zero-width characters."""
    text = "".join(text.split())
    return text if text.isascii() and "|" not in text else _DROP.sub("", text)


_JOINTS = re.compile(r"[\s|/·•»›>«‹<,;:~–—\-​‌‍­]+")


def _joined(key: str, parts: dict[str, list[str]]) -> bool:
    """Whether ``key`` is a run of whole ``parts``, which are given by their first character (a reachability table over positions)."""
    n = len(key)
    reach = bytearray(n + 1)
    reach[0] = 1
    for i in range(n):
        if reach[i]:
            for x in parts.get(key[i], ()):
                if key.startswith(x, i):
                    reach[i + len(x)] = 1
    return bool(reach[n])


def stray_lines(page: Page, content: str | None) -> list[int]:
    """Numbers (from 1) of the lines of ``content`` that are site furniture.

    A line is furniture when its folded form is one of the page's lines outside the main
    body, or is made of several of them joined by white space or separators, and is not
    itself a line of the main body.  Blank lines are never listed, nor are lines that the
    page does not show at all.
    """
    if not content:
        return []
    main = {fold(x) for x in main_text(page).split("\n")}
    main.update(fold(x.text) for x in page.main_lines())
    rest = [x.text for x, keep in zip(page.lines, page.main) if not keep]
    outside = {fold(x) for x in rest}
    parts: dict[str, list[str]] | None = None
    out = []
    for i, raw in enumerate(content.split("\n"), 1):
        key = fold(raw)
        if not key or key in main:
            continue
        if key in outside:
            out.append(i)
            continue
        if parts is None:
            parts = {}
            for y in {_JOINTS.sub("", x) for x in rest}:
                if y:
                    parts.setdefault(y[0], []).append(y)
        if _joined(_JOINTS.sub("", raw), parts):
            out.append(i)
    return out
