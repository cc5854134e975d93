"""Lines repeated across one site's pages (problem 6).

Every site is a weighted graph: its nodes are normalised lines, weighted by the number of
pages that have them; its edges join lines that follow each other in a page, weighted by
the number of pages where they do.  Nodes with high support stay, edges with high support
between them stay, and the connected components are the site's boilerplate blocks - a line
that is repeated but always stands elsewhere is a block of its own.  A page's lines are
deleted where they occur in a block of its site.

Nodes and edges of all sites are counted in one partial aggregation of hashes.  What is kept
of a site is small however many pages it has: a kept node is in a fifth of its pages, so
there are at most five times as many as a page has lines on average, and a kept edge is in
a fifth of a fifth, so at most twenty-five times.  That is why a site's components can be
found in one task, and why its blocks travel to its pages as one row, spread by a salt.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import stored
from ..html.tree import body_of, leaf_blocks, parse

LEAST_PAGES, LEAST_SHARE, EDGE_SHARE = 5, 0.2, 0.2
_DIGITS = re.compile(r"[0-9]+")


def normal_line(text: str) -> str:
    """Lower case, runs of 0-9 as '#'. Empty when the line has no letter."""
    text = _DIGITS.sub("#", text.lower())
    return text if any(c.isalpha() for c in text) else ""


def page_lines(source: str | None) -> list[str]:
    """The normalised lines of a page in order, repeated ones included. Null and empty pages have none."""
    if not source:
        return []
    return [y for x in leaf_blocks(body_of(parse(source))) if (y := normal_line(x))]


def _shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"id": pdf["id"], "site": pdf["site"], "lines": [page_lines(x) for x in pdf["source"]]})


def site_of(host):
    """A host's site: lower case, without a leading ``www.``."""
    return F.regexp_replace(F.lower(F.trim(host)), r"^www\.", "")


def lines_by_page(pages: DataFrame, key: str, host: str, html: str) -> DataFrame:
    """``id, site, lines``: one row per page; a repeated id counts once. Rows with a null key or host are left out."""
    rows = pages.where(F.col(key).isNotNull() & F.col(host).isNotNull()).select(F.col(key).cast("string").alias("id"), site_of(F.col(host)).alias("site"), F.col(html).alias("source"))
    shred = rows.mapInPandas(_shred, "id string, site string, lines array<string>")
    return shred.groupBy("id", "site").agg(F.max("lines").alias("lines"))


def site_graphs(lines: DataFrame, least: int = LEAST_PAGES, share: float = LEAST_SHARE, edge_share: float = EDGE_SHARE) -> DataFrame:
    """``site, a, b, weight, pages``: the nodes (b null) and edges of all sites that may be kept, lines as hashes."""
    totals = lines.groupBy("site").agg(F.count("*").alias("pages"))
    hashes = F.transform("lines", lambda x: F.xxhash64(x))
    nodes = F.transform(F.array_distinct("h"), lambda x: F.struct(x.alias("a"), F.lit(None).cast("bigint").alias("b")))
    follow = F.expr("filter(transform(h, (x, i) -> named_struct('a', x, 'b', get(h, i + 1))), e -> e.b IS NOT NULL AND e.a <> e.b)")
    parts = lines.select("site", hashes.alias("h")).select("site", F.explode(F.concat(nodes, F.array_distinct(follow))).alias("e"))
    counts = parts.groupBy("site", "e.a", "e.b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
    part = F.when(F.col("b").isNull(), F.lit(share)).otherwise(F.lit(share * edge_share))
    return counts.join(totals, "site").where(F.col("weight") >= F.col("pages") * part - 1e-9)


def components_of(graph: Iterable[dict], edge_share: float = EDGE_SHARE) -> dict[int, int]:
    """Kept line -> the smallest line of its component; an edge stays when its weight is at least ``edge_share`` of the smaller support of its ends."""
    support = {e["a"]: e["weight"] for e in graph if e["b"] is None}
    block = {x: x for x in support}

    def root(x: int) -> int:
        while block[x] != x:
            block[x] = x = block[block[x]]
        return x

    for e in graph:
        a, b = e["a"], e["b"]
        if a in support and b in support and e["weight"] >= edge_share * min(support[a], support[b]) - 1e-9:
            a, b = root(a), root(b)
            block[max(a, b)] = min(a, b)
    return {x: root(x) for x in support}


def site_blocks(lines: DataFrame, least: int = LEAST_PAGES, share: float = LEAST_SHARE, edge_share: float = EDGE_SHARE) -> DataFrame:
    """``site, kept``: for every site with kept lines a map from their hashes to the component each is in, named by its smallest hash."""
    found = F.udf(lambda graph: components_of(graph, edge_share), "map<bigint,bigint>", useArrow=True)
    graphs = site_graphs(lines, least, share, edge_share).groupBy("site").agg(F.collect_list(F.struct("a", "b", "weight")).alias("graph"))
    return graphs.where(F.exists("graph", lambda e: e["b"].isNull())).select("site", found("graph").alias("kept"))


def _with_blocks(lines: DataFrame) -> DataFrame:
    """``lines`` with ``kept``: hash -> block of the page's site, null where the site has none."""
    salts = max(4, lines.sparkSession.sparkContext.defaultParallelism)
    spread = site_blocks(lines).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return lines.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))).join(spread, ["site", "salt"], "left").drop("salt")


def repeated_lines(pages: DataFrame, key: str, host: str, html: str) -> DataFrame:
    """``id, line, block``: every distinct repeated line of every page with the block it belongs to.

    Pages without lines give no rows; empty tables give an empty result; ties do not arise, as
    all lines at a threshold stay.
    """
    lines = stored(lines_by_page(pages, key, host, html))
    found = F.filter(F.transform(F.array_distinct("lines"), lambda x: F.struct(x.alias("line"), F.try_element_at("kept", F.xxhash64(x)).alias("block"))), lambda e: e["block"].isNotNull())
    return _with_blocks(lines).where("kept IS NOT NULL").select("id", F.explode(found).alias("e")).select("id", "e.line", "e.block")


def without_repeated(pages: DataFrame, key: str, host: str, html: str) -> DataFrame:
    """``id, text``: every page's normalised lines that are in no block of its site, in order, one a line."""
    lines = stored(lines_by_page(pages, key, host, html))
    left = F.filter("lines", lambda x: F.col("kept").isNull() | F.try_element_at("kept", F.xxhash64(x)).isNull())
    return _with_blocks(lines).select("id", F.array_join(left, "\n").alias("text"))


def boilerplate_blocks(pages: DataFrame, key: str, host: str, html: str) -> DataFrame:
    """``site, block, lines, support, text``: every block of every site, the pages that have its most frequent line, and its lines in the order of their text."""
    found = repeated_lines(pages, key, host, html).join(pages.where(F.col(key).isNotNull() & F.col(host).isNotNull()).select(F.col(key).cast("string").alias("id"), site_of(F.col(host)).alias("site")).distinct(), "id")
    lines = found.groupBy("site", "block", "line").agg(F.count("*").alias("n"))
    return lines.groupBy("site", "block").agg(F.count("*").alias("lines"), F.max("n").alias("support"), F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"))
