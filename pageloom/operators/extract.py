"""Pages to nodes, blocks and Markdown, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..html.shred import NODE_SCHEMA, Dom, node_rows
from ..html.tree import parse
from ..model import BLOCK_FIELDS, ROLES
from .classify import blocks_of
from .learn import RESCUE_BELOW
from .markdown import rendered
from .rescue import rescue
from .rules import CONTENT, apply_rules, induce

_NODES = [c.split()[0] for c in NODE_SCHEMA.split(", ")]


def _pages(pages: DataFrame, key: str, html: str, *more) -> DataFrame:
    return pages.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("page"), *more, F.col(html).alias("source"))


def _shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(page, *r) for page, source in zip(pdf["page"], pdf["source"]) for r in node_rows(source)]
        yield pd.DataFrame(rows, columns=["page", *_NODES])


def dom_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``page`` and the node columns: one row per element from body down, cleaned of scripts and the like.

    An element lies inside another of its page when its ``pre`` is above the other's and at most its ``end``.
    Null pages are a lone body; null keys are left out; repeated pages repeat.
    """
    return _pages(pages, key, html).mapInPandas(_shred, f"page string, {NODE_SCHEMA}")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for source in pdf["source"]:
            rows = [b.row() for b in blocks_of(Dom.of(source))]
            if sum(len(r["text"]) for r in rows if r["role"] in CONTENT) < RESCUE_BELOW:
                saved = rescue(parse(source))
                if saved:
                    extra = {"ord": -1, "role": "MainContent", "confidence": saved[1], "text": saved[2], "markdown": saved[2], "xpath": "", "text_length": len(saved[2]), "link_density": 0.0, "links": []}
                    rows = [extra, *rows]
            out.append(rows)
        yield pd.DataFrame({"page": pdf["page"], "blocks": out})


def _struct() -> str:
    fields = BLOCK_FIELDS.replace("ord int", "ord:int")
    parts = [f.strip() for f in fields.split(", ")]
    return "array<struct<" + ",".join(p if ":" in p.split("<")[0] else p.replace(" ", ":", 1) for p in parts) + ">>"


def page_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``page, blocks``: the role-labelled blocks of every page in document order, the rescue block first where content is short."""
    return _pages(pages, key, html).mapInPandas(_blocks, f"page string, blocks {_struct()}")


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row per block."""
    return page_blocks(pages, key, html).select("page", F.explode("blocks").alias("b")).select("page", "b.*")


def markdown(pages: DataFrame, key: str, html: str, profile: str = "RagFull") -> DataFrame:
    """``page, n_blocks, title, markdown`` in a profile."""
    b = page_blocks(pages, key, html)
    title = F.filter("blocks", lambda x: x["role"] == "Title")
    return b.select("page", F.size("blocks").alias("n_blocks"), F.try_element_at(title, F.lit(1))["text"].alias("title"), rendered(F.col("blocks"), profile).alias("markdown"))


def overridden(pages: DataFrame, key: str, host: str, html: str, templates: list[dict], snapshots: bool = False) -> DataFrame:
    """``page, host, matched, blocks``: blocks of pages whose host has a hand-written template, by its rules alone.

    The templates are configuration, one per host, and travel with the tasks; deterministic
    snapshots only count when asked for.
    """
    from ..sources.operator_templates import as_extractor

    by_host = {t["host"].lower(): as_extractor(t) for t in templates if snapshots or not t.get("deterministic")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [apply_rules(Dom.of(s), by_host[h]) for h, s in zip(pdf["host"], pdf["source"])]
            yield pd.DataFrame({"page": pdf["page"], "host": pdf["host"], "matched": [hit > 0 for _, hit, _ in found], "blocks": [[x.row() for x in b] for b, _, _ in found]})

    own = _pages(pages, key, html, F.lower(host).alias("host")).where(F.col("host").isin(sorted(by_host)))
    return own.mapInPandas(run, f"page string, host string, matched boolean, blocks {_struct()}")


def best_render(pages: DataFrame, key: str, static: str, rendered_: str, least: int = 200) -> DataFrame:
    """``page, used, markdown``: what is extracted from a page as it was sent, or as a browser rendered it where that gives more.

    The rendered form is only looked at where the static one gives under ``least`` characters, and
    used only where it gives more; pages without either are empty and ``static``.
    """
    from .learn import plain_markdown

    def text(source: str | None) -> str:
        return plain_markdown(blocks_of(Dom.of(source))) if source and source.strip() else "\n"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, first, second in zip(pdf["page"], pdf["source"], pdf["rendered"]):
                used, best = "static", text(first)
                if len(best.strip()) < least:
                    other = text(second)
                    if len(other.strip()) > len(best.strip()):
                        used, best = "rendered", other
                rows.append((page, used, best))
            yield pd.DataFrame(rows, columns=["page", "used", "markdown"])

    return _pages(pages, key, static, F.col(rendered_).alias("rendered")).mapInPandas(run, "page string, used string, markdown string")


CLAIMS = "array<struct<tag:string,id:string,classes:array<string>,data:map<string,string>,aria:map<string,string>,role:string>>"


def induced_rules(pages: DataFrame, key: str, host: str, html: str, at: str) -> DataFrame:
    """``page, host, bucket, role, claims, confidence, selectors, induced_at``: what each page alone would teach."""
    from .fingerprint import fingerprint

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, h, when, source in zip(pdf["page"], pdf["host"], pdf["at"], pdf["source"]):
                dom = Dom.of(source)
                bucket = fingerprint(dom)["bands"][0]
                for r in induce(dom, blocks_of(dom))["rules"]:
                    rows.append((page, h, bucket, r["role"], r["claims"] or [], r["confidence"], r["css"], when))
            yield pd.DataFrame(rows, columns=["page", "host", "bucket", "role", "claims", "confidence", "selectors", "induced_at"])

    source = _pages(pages, key, html, F.lower(F.coalesce(F.col(host), F.lit(""))).alias("host"), F.col(at).alias("at"))
    return source.mapInPandas(run, f"page string, host string, bucket bigint, role string, claims {CLAIMS}, confidence double, selectors array<string>, induced_at timestamp")


def register(spark, classifier: Callable | None = None) -> None:
    """SQL functions: ``html_to_markdown(html)``, ``html_title(html)``, ``is_stable_class(token)``, and the table
    function ``html_blocks(html)``; a classifier (Dom -> list of blocks) can take the place of ours."""
    from pyspark.sql.functions import pandas_udf, udtf

    from ..functions.stability import is_stable
    from ..html.tree import body_of
    from .classify import title_of
    from .markdown import to_markdown

    blocks_by = classifier or blocks_of
    spark.udf.register("html_to_markdown", pandas_udf(lambda s: s.map(lambda x: to_markdown(body_of(parse(x)))), "string"))
    spark.udf.register("html_title", pandas_udf(lambda s: s.map(lambda x: (t.text if (t := title_of(Dom.of(x))) else None)), "string"))
    spark.udf.register("is_stable_class", pandas_udf(lambda s: s.map(lambda x: bool(x) and is_stable(x)), "boolean"))

    @udtf(returnType="ord int, role string, confidence double, text string, markdown string")
    class HtmlBlocks:
        def eval(self, html: str):
            for b in blocks_by(Dom.of(html)):
                yield b.ord, b.role, b.confidence, b.text, b.markdown

    spark.udtf.register("html_blocks", HtmlBlocks)


__all__ = ["ROLES", "best_render", "blocks", "dom_nodes", "induced_rules", "markdown", "overridden", "page_blocks", "register"]
