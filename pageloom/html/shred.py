"""A page as arrays: pre-order numbers, intervals, depths, text spans and link lengths.

All text of the page is one string; an element's text is a slice of it, so lengths of
nested elements cost nothing.  An element ``d`` lies inside ``a`` when
``a.pre < d.pre <= a.end`` - the form the node table carries into Spark.
"""

from __future__ import annotations


from ..model import CLEAN_TAGS
from .tree import Node, body_of, parse


class Dom:
    """The elements from ``body`` down, subtrees of ``drop`` left out."""

    __slots__ = ("depth", "end", "kids", "link", "nodes", "nth", "parent", "prose", "root", "span", "text", "where")

    def __init__(self, root: Node, drop: frozenset[str] = CLEAN_TAGS):
        self.root = root
        self.nodes: list[Node] = []
        self.end: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.nth: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.kids: list[list[int]] = []
        pieces: list[str] = []
        size = 0
        stack: list[tuple[Node | None, int, int]] = [(body_of(root), -1, 1)]
        counts: list[dict[str, int]] = []
        while stack:
            node, up, extra = stack.pop()
            if node is None:  # the end of element ``up``
                self.end[up] = len(self.nodes) - 1
                self.span[up] = (self.span[up][0], size)
                continue
            if type(node) is str:
                pieces.append(node)
                size += len(node)
                continue
            here = len(self.nodes)
            self.nodes.append(node)
            self.parent.append(up)
            self.depth.append(self.depth[up] + 1 if up >= 0 else 1)
            self.end.append(here)
            self.span.append((size, size))
            self.kids.append([])
            counts.append({})
            if up >= 0:
                seen = counts[up]
                seen[node.tag] = seen.get(node.tag, 0) + 1
                self.nth.append(seen[node.tag])
                self.kids[up].append(here)
            else:
                self.nth.append(1)
            stack.append((None, here, 0))
            for c in reversed(node.children):
                if type(c) is str or c.tag not in drop:
                    stack.append((c, here, 0))
        self.text = "".join(pieces)
        # Text inside links: once per link (nested ones count again), and once per outermost link.
        n = len(self.nodes)
        self.link, self.prose = [0] * n, [0] * n
        outer = [0] * n
        for i in range(n - 1, -1, -1):
            a, b = self.span[i]
            own = b - a if self.nodes[i].tag == "a" else 0
            self.link[i] += own
            outer[i] = own if own else outer[i]
            self.prose[i] = b - a - outer[i]
            if self.parent[i] >= 0:
                self.link[self.parent[i]] += self.link[i]
                outer[self.parent[i]] += outer[i]
        self.where = {id(x): i for i, x in enumerate(self.nodes)}

    @classmethod
    def of(cls, source: str | None, drop: frozenset[str] = CLEAN_TAGS) -> "Dom":
        return cls(parse(source), drop)

    def __len__(self) -> int:
        return len(self.nodes)

    def text_of(self, i: int) -> str:
        a, b = self.span[i]
        return self.text[a:b]

    def length(self, i: int) -> int:
        a, b = self.span[i]
        return b - a

    def trimmed(self, i: int) -> int:
        return len(self.text_of(i).strip())

    def density(self, i: int) -> float:
        n = self.length(i)
        return self.link[i] / n if n else 0.0

    def inside(self, i: int, a: int) -> bool:
        return a < i <= self.end[a]

    def under(self, i: int, tags: tuple[str, ...] | frozenset[str]) -> bool:
        """Whether an ancestor has one of the tags."""
        i = self.parent[i]
        while i >= 0:
            if self.nodes[i].tag in tags:
                return True
            i = self.parent[i]
        return False

    def ancestors(self, i: int) -> list[int]:
        out = []
        while (i := self.parent[i]) >= 0:
            out.append(i)
        return out

    def xpath(self, i: int) -> str:
        steps = []
        while i >= 0:
            steps.append(f"{self.nodes[i].tag}[{self.nth[i]}]")
            i = self.parent[i]
        return "/html[1]/" + "/".join(reversed(steps))

    def find(self, i: int, tags) -> list[int]:
        """Descendants of ``i`` with one of the tags, in order."""
        return [k for k in range(i + 1, self.end[i] + 1) if self.nodes[k].tag in tags]


NODE_SCHEMA = (
    "pre int, end int, parent int, depth int, tag string, nth int, sib_idx int, n_children int, attrs map<string,string>, id string, "
    "classes array<string>, own_text string, text_len int, text_trim_len int, link_len int, prose_len int, xpath string"
)


def node_rows(source: str | None, drop: frozenset[str] = CLEAN_TAGS) -> list[tuple]:
    """One row per element from body down, in the order of NODE_SCHEMA; xpaths are built top-down."""
    dom = Dom.of(source, drop)
    paths: list[str] = []
    rows = []
    for i, x in enumerate(dom.nodes):
        up = dom.parent[i]
        paths.append((paths[up] if up >= 0 else "/html[1]") + f"/{x.tag}[{dom.nth[i]}]")
        rows.append(
            (i, dom.end[i], up, dom.depth[i], x.tag, dom.nth[i], i if up < 0 else -1, len(dom.kids[i]), dict(x.attrs), x.attrs.get("id"), x.classes,
             " ".join("".join(c for c in x.children if type(c) is str).split()), dom.length(i), dom.trimmed(i), dom.link[i], dom.prose[i], paths[i])
        )
    # Sibling positions in one sweep over parents.
    out = [list(r) for r in rows]
    for kids in dom.kids:
        for k, c in enumerate(kids):
            out[c][6] = k
    if out:
        out[0][6] = 0
    return [tuple(r) for r in out]


__all__ = ["Dom", "NODE_SCHEMA", "node_rows"]
