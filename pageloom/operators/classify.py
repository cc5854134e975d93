"""Blocks of a page and their roles, as one page-local kernel.

The passes work on numbers of a ``Dom``: candidates are proposed by the segmenter, scored,
adjusted by detectors (navigation, wrappers, anchored inner bodies, repeated items), and a
set of non-overlapping winners is chosen.  Content winners are cleaned of furniture before
their text is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.stability import is_stable
from ..html.shred import Dom
from ..html.tree import Node
from ..model import (
    AD_HINTS, CHROME_HINTS, CONTAMINATION_HINTS, CONTENT_HINTS, COOKIE_PHRASES, COPYRIGHT, FOOTER_PHRASES, FRAMEWORK_HINTS, NAV_HINTS, REPEAT_SELF_TYPED,
    REPEAT_SKIP_ANCESTOR, REPEAT_SKIP_CHILD, REPEAT_SKIP_CONTAINER, SEGMENT_TAGS, TEXT_INPUTS,
)
from .markdown import to_markdown

_COPY = re.compile("|".join(COPYRIGHT), re.I)
_LOWER_CONTAMINATION = tuple(CONTAMINATION_HINTS)
# Bonus of each role in a block's score.
_BONUS = {
    "MainContent": 500, "Article": 500, "Table": 200, "CodeBlock": 200, "Form": 100, "Summary": 100, "Title": 75, "Heading": 50, "PrimaryNavigation": 50,
    "SecondaryNavigation": 50, "Breadcrumb": 50, "Sidebar": 20, "RelatedLinks": 20, "Footer": 10, "Header": 10, "CookieBanner": 10, "Advertisement": 10,
    "Boilerplate": -200, "Unknown": -200,
}
_CONTENT = frozenset(["MainContent", "Article"])
_SINGLE = frozenset(["MainContent", "Article", "PrimaryNavigation", "Footer", "Header"])
_RENDERED = frozenset("MainContent Article RepeatedItem Summary Title Heading Table CodeBlock Sidebar RelatedLinks".split())
SURE = 50_000.0


@dataclass
class Candidate:
    at: int
    role: str
    confidence: float
    score: float


@dataclass
class Block:
    role: str
    confidence: float
    text: str
    markdown: str
    xpath: str
    text_length: int
    link_density: float
    links: list[tuple[str, str, bool]] = field(default_factory=list)
    node: Node | None = None
    ord: int = 0

    def row(self) -> dict:
        links = [{"text": t, "href": h, "is_external": e} for t, h, e in self.links]
        return {"ord": self.ord, "role": self.role, "confidence": self.confidence, "text": self.text, "markdown": self.markdown, "xpath": self.xpath, "text_length": self.text_length, "link_density": self.link_density, "links": links}


def hinted(node: Node, hints) -> bool:
    """Whether a class token or the id contains a hint, without case."""
    tokens = [t.lower() for t in node.classes]
    if node.attrs.get("id"):
        tokens.append(node.attrs["id"].lower())
    return any(h.lower() in t for t in tokens for h in hints)


def segments(dom: Dom) -> list[int]:
    """Where blocks can start: sectioning tags, and div or section with 80 characters or 3 children."""
    out = []
    for i, x in enumerate(dom.nodes):
        if i and (x.tag in SEGMENT_TAGS or (x.tag in ("div", "section") and (dom.length(i) >= 80 or len(dom.kids[i]) >= 3))):
            out.append(i)
    return out


def _nav_rank(dom: Dom, i: int) -> str:
    return "PrimaryNavigation" if dom.under(i, ("header",)) or dom.depth[i] <= 3 else "SecondaryNavigation"


def typed_inputs(dom: Dom, i: int) -> int:
    return sum(dom.nodes[k].tag == "textarea" or dom.nodes[k].attrs.get("type", "text").lower() in TEXT_INPUTS for k in dom.find(i, ("input", "textarea")))


def classify_one(dom: Dom, i: int) -> tuple[str, float]:
    """Role and confidence of one element; the first rule that holds decides."""
    x, density, n = dom.nodes[i], dom.density(i), dom.length(i)
    tag = x.tag
    if tag == "nav" or (density > 0.7 and hinted(x, NAV_HINTS)):
        return _nav_rank(dom, i), 0.85
    low = dom.text_of(i).lower()
    if tag == "footer" or any("footer" in c.lower() for c in x.classes):
        return "Footer", 0.9 if any(p in low for p in FOOTER_PHRASES) or _COPY.search(low) else 0.6
    if tag == "header":
        return "Header", 0.7
    if tag in ("main", "article") or (tag in ("div", "section") and density < 0.6 and hinted(x, FRAMEWORK_HINTS)):
        return "MainContent", 0.92 if n > 200 else 0.7
    if tag == "aside":
        return ("RelatedLinks" if density > 0.5 else "Sidebar"), 0.75
    if tag == "form":
        whole = n >= 500 and n / max(dom.length(0), 1) >= 0.7
        if not whole and typed_inputs(dom, i):
            return "Form", 0.85
    if tag == "table":
        return "Table", 0.95
    if any(p in low for p in COOKIE_PHRASES) and dom.find(i, ("button",)):
        return "CookieBanner", 0.9
    if density > 0.5 and hinted(x, AD_HINTS):
        return "Advertisement", 0.8
    if n > 200:
        return (_depth_rank(dom, i), 0.85) if density >= 0.6 else ("MainContent", 0.5)
    return "Boilerplate", 0.3


def _depth_rank(dom: Dom, i: int) -> str:
    return "PrimaryNavigation" if dom.depth[i] <= 3 else "SecondaryNavigation"


def score(dom: Dom, i: int, role: str) -> float:
    x = dom.nodes[i]
    out = dom.trimmed(i) * (1 - dom.density(i)) ** 2 + _BONUS.get(role, 0) - (50 if x.tag == "div" else 0)
    if role in ("MainContent", "Boilerplate"):
        out += 300 * hinted(x, CONTENT_HINTS) - 300 * hinted(x, CHROME_HINTS)
    return out


# ---------------------------------------------------------------------------------- detectors


def find_navigation(dom: Dom) -> list[tuple[int, str, float]]:
    """Navigation outside main and article, by six rules in falling order of certainty."""
    nodes = dom.nodes
    content = [i for i, x in enumerate(nodes) if x.tag in ("main", "article")]
    inner = set()
    for i in content:
        inner.update(range(i + 1, dom.end[i] + 1))
    taken: set[int] = set()
    out: list[tuple[int, str, float]] = []

    def take(i: int, role: str, confidence: float) -> None:
        if i and i not in taken:
            out.append((i, role, confidence))
            taken.update(range(i, dom.end[i] + 1))

    def crumbs(x: Node) -> bool:
        return x.tag in ("nav", "ol", "ul") and any("breadcrumb" in x.attrs.get(a, "").lower() for a in ("aria-label", "class", "id"))

    def link_list(i: int) -> bool:
        items = [k for k in dom.kids[i] if nodes[k].tag == "li"]
        linked = sum(bool(dom.find(k, ("a",))) for k in items)
        return len(items) >= 3 and linked >= 3 and linked >= 0.5 * len(items)

    outside = [i for i in range(1, len(nodes)) if i not in inner]
    for i in outside:
        if crumbs(nodes[i]):
            take(i, "Breadcrumb", 0.95)
    for i in outside:
        if nodes[i].attrs.get("role", "").lower() == "navigation":
            take(i, "PrimaryNavigation", 0.95)
    for tag, role in (("header", "PrimaryNavigation"), ("footer", "SecondaryNavigation")):
        for i in outside:
            if nodes[i].tag == tag:
                for k in dom.find(i, ("nav",)):
                    take(k, role, 0.9)
    cutoff = max(50, (len(nodes) - 1) // 10)
    for i in outside:
        if i <= cutoff and nodes[i].tag == "nav":
            take(i, "PrimaryNavigation", 0.85)
    for tag, role in (("header", "PrimaryNavigation"), ("footer", "SecondaryNavigation")):
        for i in outside:
            if nodes[i].tag == tag and i not in taken:
                for k in dom.find(i, ("ul", "ol")):
                    if k not in taken and link_list(k):
                        take(k, role, 0.85)
    return out


def find_repeats(dom: Dom) -> list[tuple[int, list[int]]]:
    """Containers with at least three alike children that hold text, larger groups first, none overlapping."""
    found: list[tuple[int, list[int]]] = []
    for i, x in enumerate(dom.nodes):
        if x.tag in REPEAT_SKIP_CONTAINER or len(dom.kids[i]) < 3 or dom.under(i, REPEAT_SKIP_ANCESTOR):
            continue
        groups: dict[str, list[int]] = {}
        for k in dom.kids[i]:
            if dom.nodes[k].tag not in REPEAT_SKIP_CHILD and dom.trimmed(k) >= 100:
                groups.setdefault(dom.nodes[k].tag, []).append(k)
        for tag, items in groups.items():
            if len(items) < 3:
                continue
            sets = [set(dom.nodes[k].classes) for k in items]
            union, common = set().union(*sets), set.intersection(*sets)
            alike = tag in REPEAT_SELF_TYPED if not union else len(common) >= 0.5 * max(map(len, sets)) or tag in REPEAT_SELF_TYPED
            if alike and (tag == "article" or sum(map(dom.density, items)) / len(items) <= 0.65):
                found.append((i, items))
    used: set[int] = set()
    out = []
    for box, items in sorted(found, key=lambda g: (-len(g[1]), g[0])):
        if box in used or any(k in used for k in items):
            continue
        out.append((box, items))
        used.add(box)
        for k in items:
            used.update(range(k, dom.end[k] + 1))
    return out


def anchored(node: Node) -> bool:
    return bool(node.attrs.get("id") and is_stable(node.attrs["id"])) or any(map(is_stable, node.classes))


def choose(dom: Dom) -> list[Candidate]:
    """All passes up to the choice of blocks, in document order."""
    by_at: dict[int, Candidate] = {}
    for i in segments(dom):
        role, confidence = classify_one(dom, i)
        by_at[i] = Candidate(i, role, confidence, score(dom, i, role))
    navs = find_navigation(dom)
    for i, role, confidence in navs:
        by_at[i] = Candidate(i, role, confidence, SURE)
        for k in range(i + 1, dom.end[i] + 1):
            if k in by_at:
                by_at[k] = Candidate(k, "Boilerplate", 0.1, -9999.0)
    content = [i for i in by_at if dom.nodes[i].tag in ("main", "article")]
    for i in content:
        if dom.length(i) >= 500 and dom.density(i) < 0.5:
            for a in dom.ancestors(i):
                if a in by_at and dom.nodes[a].tag in ("div", "section"):
                    by_at[a] = Candidate(a, "Boilerplate", 0.1, -8000.0)
    for i in content:
        fits = [
            k for k in dom.find(i, ("div", "section"))
            if dom.density(k) < 0.5 and dom.prose[k] >= 200 and dom.prose[k] >= 0.8 * dom.prose[i] and anchored(dom.nodes[k])
        ]
        inmost = [k for k in fits if all(k == o or dom.inside(k, o) for o in fits)]
        if inmost and by_at.get(i) and by_at[i].score > -8000:
            by_at[inmost[0]] = Candidate(inmost[0], "MainContent", 0.95, SURE)
            by_at[i] = Candidate(i, "Boilerplate", 0.1, -8000.0)
    mains = {i for i, c in by_at.items() if c.role in _CONTENT}
    for box, items in find_repeats(dom):
        size = sum(dom.trimmed(k) for k in items)
        above = next((a for a in dom.ancestors(box) if a in mains), None)
        if above is not None and size < 0.6 * max(dom.trimmed(above), 1):
            continue
        if size < 0.85 * max(dom.trimmed(box), 1):
            continue
        if box in by_at:
            by_at[box] = Candidate(box, "Boilerplate", 0.1, -9999.0)
        for k in items:
            by_at[k] = Candidate(k, "RepeatedItem", 0.9, SURE)
    # Greedy choice: the best first, nothing that lies in or around a chosen one.
    chosen: list[Candidate] = []
    blocked: set[int] = set()
    covered = bytearray(len(dom))
    for c in sorted(by_at.values(), key=lambda c: (-c.score, c.at)):
        if covered[c.at] or c.at in blocked:
            continue
        chosen.append(c)
        covered[c.at : dom.end[c.at] + 1] = b"\x01" * (dom.end[c.at] + 1 - c.at)
        blocked.update(dom.ancestors(c.at))
    top = max((c.score for c in chosen if c.role in _CONTENT), default=0.0)
    if top >= 1000:
        for c in chosen:
            if c.role in _CONTENT and c.score < 0.25 * top:
                c.role, c.confidence = "Boilerplate", 0.3
    best: dict[str, Candidate] = {}
    semantic = ("main", "article", "nav", "header", "footer")
    for c in chosen:
        if c.role in _SINGLE:
            old = best.get(c.role)
            rank = (dom.nodes[c.at].tag in semantic, c.score, -c.at)
            if old is None or rank > (dom.nodes[old.at].tag in semantic, old.score, -old.at):
                best[c.role] = c
    for c in chosen:
        if c.role in _SINGLE and best[c.role] is not c:
            c.role, c.confidence = "Boilerplate", min(c.confidence, 0.3)
    return sorted(chosen, key=lambda c: c.at)


def furnish(dom: Dom, i: int) -> set[int]:
    """Elements to take out of a content block: navigation, furniture by name, link boxes, idle forms, button rows."""
    drop: set[int] = set()
    k = i + 1
    while k <= dom.end[i]:
        if _furniture(dom, k):
            drop.update(range(k, dom.end[k] + 1))
            k = dom.end[k] + 1
        else:
            k += 1
    return drop


def _furniture(dom: Dom, k: int) -> bool:
    x = dom.nodes[k]
    n, kids = dom.length(k), dom.kids[k]
    name = f"{x.attrs.get('id', '')} {x.attrs.get('class', '')}".lower()
    if x.tag == "nav" or (name.strip() and any(h in name for h in _LOWER_CONTAMINATION) and (n < 1000 or dom.density(k) >= 0.4)):
        return True
    if x.tag in ("div", "aside") and n >= 80 and dom.density(k) >= 0.6:
        return True
    if x.tag == "form" and not typed_inputs(dom, k):
        return True
    return x.tag == "div" and len(kids) >= 2 and sum(dom.nodes[c].tag in ("button", "a") for c in kids) >= 0.8 * len(kids)


def pruned(dom: Dom, i: int, drop: set[int]) -> Node:
    """A copy of an element without the dropped ones and without wrappers left empty."""

    def copy(k: int, up: Node | None) -> Node | None:
        x = dom.nodes[k]
        out = Node(x.tag, x._attrs, up)
        for c in x.children:
            if type(c) is str:
                out.children.append(c)
            elif (at := dom.where.get(id(c))) is not None and at not in drop:
                kid = copy(at, out)
                if kid is not None:
                    out.children.append(kid)
        keeps = any(type(c) is not str or c.strip() for c in out.children) or x.tag in ("img", "video", "audio", "picture", "iframe", "embed", "object", "br", "hr", "td", "th", "input")
        return out if keeps or k == i else None

    return copy(i, None)


def links_of(node: Node) -> list[tuple[str, str, bool]]:
    out = []
    for x in node.iter():
        if x.tag == "a" and x.attrs.get("href"):
            href = x.attrs["href"]
            out.append((" ".join(x.text().split()), href, href.lower().startswith("http")))
    return out


def title_of(dom: Dom) -> Block | None:
    """The page's h1: the first in main or article, else the first."""
    heads = [i for i, x in enumerate(dom.nodes) if x.tag == "h1" and dom.text_of(i).strip()]
    if not heads:
        return None
    inner = next((i for i in heads if dom.under(i, ("main", "article"))), None)
    at = heads[0] if inner is None else inner
    confidence = 0.95 if len(heads) == 1 else 0.85 if inner is not None else 0.7
    text = " ".join(dom.text_of(at).split())
    return Block("Title", confidence, text, f"# {text}", dom.xpath(at), len(text), dom.density(at), links_of(dom.nodes[at]), dom.nodes[at])


def blocks_of(dom: Dom) -> list[Block]:
    """The blocks of a page in document order, the title first. A page without text has none."""
    out: list[Block] = []
    title = title_of(dom)
    if title is not None:
        out.append(title)
    for c in choose(dom):
        node = dom.nodes[c.at]
        if c.role in _CONTENT or c.role == "RepeatedItem":
            node = pruned(dom, c.at, furnish(dom, c.at))
        text = node.text() if node is not dom.nodes[c.at] else dom.text_of(c.at)
        trimmed = text.strip()
        if not trimmed and not dom.find(c.at, ("img",)):
            continue
        links = links_of(node)
        density = sum(len(x.text()) for x in node.iter() if x.tag == "a") / len(text) if text else 0.0
        markdown = to_markdown(node) if c.role in _RENDERED else ""
        out.append(Block(c.role, c.confidence, trimmed, markdown, dom.xpath(c.at), len(text), density, links, dom.nodes[c.at]))
    for k, b in enumerate(out):
        b.ord = k
    return out
