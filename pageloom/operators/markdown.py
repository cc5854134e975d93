"""From an element to Markdown, and from blocks to a page in a profile."""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..html.tree import VOID, Node
from ..model import PROFILES

_SKIP = frozenset("script style noscript template".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i img kbd label mark q s samp small span strike strong sub sup time tt u var br input button".split())
_SPECIAL = re.compile(r"([\\*_`])")
MAX_SPAN, SHORT = 1000, 40


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def _fence(node: Node) -> list[str]:
    code = node.find("code")
    lang = next((t[9:] for t in (code.classes if code else []) if t.lower().startswith("language-")), "")
    body = (code or node).text().rstrip()
    bar = "```" if "```" not in body else "````"
    return [f"{bar}{lang}", *body.split("\n"), bar]


def inline(node: Node) -> str:
    """The inline Markdown of an element's content; white space runs become one space, ``br`` a hard break."""
    out: list[str] = []
    for c in node.children:
        if type(c) is str:
            out.append(escape(re.sub(r"[ \t\r\n\f]+", " ", c)))
        elif c.tag in _SKIP:
            continue
        elif c.tag == "br":
            out.append("  \n")
        elif c.tag == "img":
            if c.attrs.get("src"):
                alt = re.sub(r"[\[\]]", "", c.attrs.get("alt", ""))
                out.append(f"![{alt}]({c.attrs['src']})")
        elif c.tag in ("code", "kbd", "samp", "tt"):
            out.append(f"`{' '.join(c.text().split())}`" if c.text().strip() else "")
        else:
            inner = inline(c)
            if c.tag == "a" and c.attrs.get("href"):
                out.append(f"[{inner}]({c.attrs['href']})")
            elif c.tag in ("em", "i") and inner.strip():
                out.append(f"*{inner}*")
            elif c.tag in ("strong", "b") and inner.strip():
                out.append(f"**{inner}**")
            else:
                out.append(inner)
    text = "".join(out)
    return re.sub(r" {3,}\n", "  \n", re.sub(r"(?<! ) {2,}(?!\n)", " ", text))


def _cells(row: Node) -> list[Node]:
    return [c for c in row.elements() if c.tag in ("td", "th")]


def _raw(node: Node) -> str:
    attrs = "".join(f' {k}="{_html.escape(v)}"' for k, v in node.attrs.items())
    if node.tag in VOID:
        return f"<{node.tag}{attrs}>"
    return f"<{node.tag}{attrs}>" + "".join(_html.escape(c, quote=False) if type(c) is str else _raw(c) for c in node.children) + f"</{node.tag}>"


def _align(cell: Node) -> str:
    word = cell.attrs.get("align", "").lower()
    if word not in ("left", "center", "right"):
        m = re.search(r"text-align:\s*(left|center|right)", cell.attrs.get("style", "").lower())
        word = m[1] if m else ""
    return word


def _span(cell: Node, name: str) -> int:
    raw = cell.attrs.get(name, "1").strip()
    return min(MAX_SPAN, int(raw)) if raw.isdecimal() and int(raw) > 0 else 1


def _table(node: Node) -> list[str]:
    head: list[Node] = []
    body: list[Node] = []
    caption = ""
    for c in node.elements():
        if c.tag == "caption":
            caption = " ".join(c.text().split())
        elif c.tag == "tr":
            body.append(c)
        elif c.tag in ("thead", "tbody", "tfoot"):
            (head if c.tag == "thead" else body).extend(r for r in c.elements() if r.tag == "tr")
    if not head and body and _cells(body[0]) and all(c.tag == "th" for c in _cells(body[0])):
        head = [body.pop(0)]
    rows = head + body
    if not rows:
        return []
    deep = frozenset("h1 h2 h3 h4 h5 h6 ul ol pre blockquote hr table".split())
    complex_ = len(head) > 1 or any(
        any(d.tag in deep for d in cell.iter() if d is not cell) or sum(d.tag == "p" for d in cell.iter()) >= 2 for r in rows for cell in _cells(r)
    )
    if complex_:
        return [_raw(node).strip()]
    grid: list[list[str]] = []
    carried: dict[int, int] = {}
    votes: list[dict[str, int]] = []
    for r in rows:
        line: list[str] = []
        cells = _cells(r)
        at = 0
        while cells or carried.get(at, 0):
            if carried.get(at, 0):
                carried[at] -= 1
                line.append("")
                at += 1
                continue
            cell = cells.pop(0)
            text = re.sub(r"[ \t]*\n", "<br>", inline(cell).strip()).replace("|", "\\|")
            word = _align(cell)
            for _ in range(_span(cell, "colspan")):
                line.append(text)
                while len(votes) <= at:
                    votes.append({})
                if word:
                    votes[at][word] = votes[at].get(word, 0) + 1
                if _span(cell, "rowspan") > 1:
                    carried[at] = _span(cell, "rowspan") - 1
                at += 1
        grid.append(line)
    width = max(map(len, grid))
    if not width:
        return []
    marks = []
    for c in range(width):
        count = sorted((votes[c] if c < len(votes) else {}).items(), key=lambda kv: -kv[1])
        word = count[0][0] if count and (len(count) == 1 or count[0][1] > count[1][1]) else ""
        marks.append({"left": ":---", "center": ":---:", "right": "---:"}.get(word, "---"))
    out = [f"**{escape(caption)}**", ""] if caption else []
    lines = [r + [""] * (width - len(r)) for r in grid]
    out += ["| " + " | ".join(lines[0]) + " |", "| " + " | ".join(marks) + " |"]
    return out + ["| " + " | ".join(r) + " |" for r in lines[1:]]


def _blocks(node: Node, out: list[list[str]]) -> None:
    run: list = []

    def flush() -> None:
        if run:
            holder = Node("span", {}, None)
            holder.children = list(run)
            text = inline(holder).strip()
            if text:
                out.append(text.split("\n"))
            run.clear()

    for c in node.children:
        if type(c) is str or c.tag in _INLINE:
            run.append(c)
            continue
        flush()
        if c.tag in _SKIP:
            continue
        if len(c.tag) == 2 and c.tag[0] == "h" and c.tag[1].isdigit():
            text = " ".join(inline(c).split())
            if text:
                out.append(["#" * int(c.tag[1]) + " " + text])
        elif c.tag == "hr":
            out.append(["---"])
        elif c.tag in ("ul", "ol"):
            items = [x for x in c.elements() if x.tag == "li"]
            lines = [(f"{k}. " if c.tag == "ol" else "- ") + " ".join(inline(x).split()) for k, x in enumerate(items, 1)]
            if lines:
                out.append(lines)
        elif c.tag == "pre":
            out.append(_fence(c))
        elif c.tag == "blockquote":
            inner: list[list[str]] = []
            _blocks(c, inner)
            if inner:
                out.append([("> " + x).rstrip() for k, part in enumerate(inner) for x in ([""] if k else []) + part])
        elif c.tag == "table":
            lines = _table(c)
            if lines:
                out.append(lines)
        elif c.tag == "figure":
            image, caption = c.find("img"), c.find("figcaption")
            holder = Node("span", {}, None)
            holder.children = [x for x in (image,) if x is not None]
            lines = [x for x in (inline(holder), inline(caption).strip() if caption else "") if x]
            if lines:
                out.append(lines)
        else:
            _blocks(c, out)
    flush()


def to_markdown(node: Node) -> str:
    """Markdown of an element's content, one newline at the end; empty content gives a lone newline."""
    holder = node
    if node.tag in ("table", "pre", "blockquote", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "figure"):
        holder = Node("div", {}, None)
        holder.children = [node]
    out: list[list[str]] = []
    _blocks(holder, out)
    return "\n\n".join("\n".join(x.rstrip() if not x.endswith("  ") else x for x in part) for part in out).strip() + "\n"


# ------------------------------------------------------------------------------- profiles


def profiled(blocks: Column, profile: str) -> Column:
    """The blocks (an array of structs) that a profile prints; short ones without links only as titles or headings."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    roles = sorted(PROFILES[profile])
    keep = lambda b: b["role"].isin(roles)
    if profile == "DebugFull":
        return F.filter(blocks, keep)
    small = lambda b: (F.length(F.trim(b["text"])) < SHORT) & (F.size(b["links"]) == 0) & ~b["role"].isin("Title", "Heading")
    return F.filter(blocks, lambda b: keep(b) & ~small(b))


def rendered(blocks: Column, profile: str) -> Column:
    """A page's Markdown: its blocks in a profile, joined by blank lines, with one newline at the end."""
    space = F.lit(" \t\r\n")
    link_list = lambda b: F.array_join(F.transform(b["links"], lambda x: F.concat(F.lit("- ["), x["text"], F.lit("]("), x["href"], F.lit(")"))), "\n")
    nav = ["PrimaryNavigation", "SecondaryNavigation", "Breadcrumb"]
    body = lambda b: (
        F.when(F.lit(profile == "Wcxb"), b["text"])
        .when(b["role"].isin(nav) & (F.size(b["links"]) > 0), link_list(b))
        .when(F.length(F.btrim(b["markdown"], space)) > 0, F.btrim(b["markdown"], space))
        .otherwise(b["text"])
    )
    shown = lambda b: F.concat(F.lit("<!-- "), b["role"], F.lit(" -->\n"), body(b)) if profile == "DebugFull" else body(b)
    return F.concat(F.btrim(F.array_join(F.transform(profiled(blocks, profile), shown), "\n\n"), space), F.lit("\n"))
