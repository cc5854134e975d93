"""Compact views of a page for language models and people: its skeleton, and the selectors worth naming; and site maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut, stored
from ..functions.stability import is_stable
from ..functions.web import host_of
from ..html.css import BadSelector, select
from ..html.shred import Dom

DEEPEST, CLASSES, EXCERPT, RUN, SHOWN, TOP = 8, 3, 120, 5, 3, 40


def skeleton(dom: Dom) -> str:
    """An indented outline: tags with ids and stable classes, text starts, runs of alike siblings shown by three."""
    out: list[str] = []

    def name(i: int) -> str:
        x = dom.nodes[i]
        ident = f"#{x.attrs['id']}" if x.attrs.get("id") else ""
        return x.tag + ident + "".join(f".{c}" for c in [c for c in x.classes if is_stable(c)][:CLASSES])

    stack: list = [(0, 0)]
    while stack:
        i, depth = stack.pop()
        if type(i) is str:
            out.append("  " * depth + i)
            continue
        own = " ".join("".join(c for c in dom.nodes[i].children if type(c) is str).split())
        out.append("  " * depth + name(i) + (f": {own[:EXCERPT]}" if own else ""))
        if depth + 1 >= DEEPEST:
            continue
        later: list = []
        kids, k = dom.kids[i], 0
        while k < len(kids):
            m = k
            while m < len(kids) and name(kids[m]) == name(kids[k]):
                m += 1
            show = kids[k:m] if m - k < RUN else kids[k : k + SHOWN]
            later += [(c, depth + 1) for c in show]
            if m - k >= RUN:
                later.append((f"... {m - k - SHOWN} more {name(kids[k])}", depth + 1))
            k = m
        stack.extend(reversed(later))
    return "\n".join(out)


def catalog(dom: Dom, top: int = TOP) -> list[tuple[str, int, float]]:
    """(selector, elements, weight): selectors by stable id or class, by text less twenty times their links; a top-k by design."""
    groups: dict[str, list[int]] = {}
    for i, x in enumerate(dom.nodes):
        if x.attrs.get("id") and is_stable(x.attrs["id"]):
            groups.setdefault(f"#{x.attrs['id']}", []).append(i)
        for c in set(filter(is_stable, x.classes)):
            groups.setdefault(f"{x.tag}.{c}", []).append(i)
        if x.tag in ("main", "article", "nav", "header", "footer", "aside"):
            groups.setdefault(x.tag, []).append(i)
    weight = {s: float(sum(dom.length(i) - 20 * len(dom.find(i, ("a",))) for i in at)) for s, at in groups.items()}
    return [(s, len(groups[s]), weight[s]) for s in sorted(weight, key=lambda s: (-weight[s], s))[:top]]


class TextProvider(Protocol):
    """A language model: a prompt in, a text out. None is shipped; tests use a canned one."""

    def __call__(self, prompt: str) -> str: ...


def prompt_for(host: str, dom: Dom) -> str:
    listed = "\n".join(f"{s} ({n})" for s, n, _ in catalog(dom))
    return f"Write an operator template in YAML for {host}: for every role, the CSS selectors of its blocks. MainContent is required.\nOutline:\n{skeleton(dom)}\nSelectors:\n{listed}\n"


def fenced_yaml(answer: str) -> str:
    """The first fenced block of an answer, or all of it."""
    lines = answer.split("\n")
    marks = [k for k, x in enumerate(lines) if x.strip().startswith("```")]
    return "\n".join(lines[marks[0] + 1 : marks[1]] if len(marks) > 1 else lines[marks[0] + 1 :] if marks else lines)


def usable_rules(dom: Dom, rules: list[dict]) -> list[dict]:
    """Rules with the selectors that match something; none at all when no MainContent is left."""
    out = []
    for r in rules:
        good = []
        for css in r["selectors"]:
            try:
                if select(dom, css):
                    good.append(css)
            except BadSelector:
                continue
        if good:
            out.append(r | {"selectors": good})
    return out if any(r["role"] == "MainContent" for r in out) else []


def induce_with(provider: TextProvider, host: str, source: str, parse: Callable[[str], dict]) -> dict | None:
    """An operator template written by a model: the host is ours, and only selectors that match are kept."""
    dom = Dom.of(source)
    try:
        template = parse(fenced_yaml(provider(prompt_for(host, dom))))
    except ValueError:
        return None
    rules = usable_rules(dom, template["rules"])
    return template | {"host": host, "rules": rules} if rules else None


def _outlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        doms = [Dom.of(x) for x in pdf["source"]]
        yield pd.DataFrame({"page": pdf["page"], "skeleton": [skeleton(d) for d in doms], "selectors": [[{"selector": s, "n": n, "weight": w} for s, n, w in catalog(d)] for d in doms]})


def outlines(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``page, skeleton, selectors``; empty pages have a lone body."""
    rows = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("page"), F.col(html).alias("source"))
    return rows.mapInPandas(_outlines, "page string, skeleton string, selectors array<struct<selector:string,n:int,weight:double>>")


def site_map(links: DataFrame, seeds: DataFrame, depth: int = 3, pages: int = 50) -> DataFrame:
    """``root, url, depth``: pages reachable from each seed on its own host, breadth first, limited as a crawl is.

    ``links`` has ``source, target`` (canonical URLs), ``seeds`` has ``url``.  Each round joins the
    frontier only, and drops what was reached before.
    """
    own = stored(links.where(host_of(F.col("source")) == host_of(F.col("target"))).select("source", "target").distinct())
    reached = cut(seeds.select(F.col("url").alias("root"), "url", F.lit(0).alias("depth")).distinct())
    frontier = reached
    for k in range(1, depth + 1):
        step = frontier.join(own, frontier["url"] == own["source"]).select("root", F.col("target").alias("url"), F.lit(k).alias("depth")).distinct()
        new = step.join(reached.select("root", "url"), ["root", "url"], "left_anti")
        # A crawl stops at its limit: what lies beyond it is not walked on.
        room = F.lit(pages) - F.col("had")
        place = F.row_number().over(Window.partitionBy("root").orderBy("url"))
        frontier = cut(new.join(reached.groupBy("root").agg(F.count("*").alias("had")), "root").where(room > 0).withColumn("place", place).where(F.col("place") <= room).select("root", "url", "depth"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def tree_markdown(reached: DataFrame) -> DataFrame:
    """``root, pages, markdown``: a site map as one nested Markdown list a root, by depth and address."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.col("url"))
    rows = reached.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("depth", "url", line.alias("line")))).alias("list"))
    return rows.select("root", F.size("list").alias("pages"), F.array_join(F.transform("list", lambda x: x["line"]), "\n").alias("markdown"))


__all__ = ["catalog", "induce_with", "outlines", "prompt_for", "site_map", "skeleton", "tree_markdown", "usable_rules"]
