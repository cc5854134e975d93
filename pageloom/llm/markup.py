"""Markup residue in readable text, and its conversion to clean text (problem 1).

Pages go through the line-block distribution: markup is stripped into lines, the text
weights of sliding windows give the surge and dive points, and the text between them is
kept, with headings, lists, tables, code blocks and formulas as light Markdown.  Residue
is looked for in that text alone, outside code and placeholders; what a menu or a footer
shows is dropped with it and makes no record an affected one.  Answers are Markdown
already, one body without site furniture: their distribution has nothing to cut, so they
are kept whole, without blank lines at either end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..html.tree import Line, Node
from .mainbody import Page
from .notations import FOREIGN_SIGNS, clean, hide_markdown_code, kinds_in, newlines

_SCHEMA = "record_key string, kinds array<string>, clean_text string"


def page_kinds(source: str | None) -> list[str]:
    """Kinds of foreign markup in the text that the line-block distribution keeps of a page."""
    return _kinds_of(Page(source).main_lines()) if source else []


def _kinds_of(lines: list[Line]) -> list[str]:
    return kinds_in("\n".join(x.outside_code() for x in lines))


def answer_kinds(markdown: str | None) -> list[str]:
    """Kinds of foreign markup in a Markdown answer; Markdown itself is none."""
    if not markdown or not markdown.strip():
        return []
    return kinds_in(hide_markdown_code(newlines(markdown)), own_markdown=True)


def _prefix(node: Node, numbers: dict[int, int]) -> str:
    """The Markdown mark of a line's owner; ``numbers`` has the places of list items already met."""
    tag = node.tag
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        return "#" * int(tag[1]) + " "
    if tag == "li":
        depth = sum(a.tag in ("ul", "ol", "menu") for a in node.ancestors())
        parent = node.parent
        mark = "- "
        if parent is not None and parent.tag == "ol":
            if id(node) not in numbers:
                numbers.update((id(x), n) for n, x in enumerate((x for x in parent.elements() if x.tag == "li"), 1))
            mark = f"{numbers[id(node)]}. "
        return "  " * max(0, depth - 1) + mark
    return "> " if tag == "blockquote" else ""


def clean_page(source: str | None) -> str:
    """The main body of a page as clean text. Null, empty and textless pages give an empty string."""
    return _text_of(Page(source))


def _text_of(page: Page) -> str:
    out: list[str] = []
    row = None
    numbers: dict[int, int] = {}
    for x in page.main_lines():
        here = next((a for a in (x.node, *x.node.ancestors()) if a.tag == "tr"), None)
        if x.pre:
            out.append("```\n" + x.text + "\n```")
        elif here is not None and here is row and any(a is page.box for a in here.ancestors()):
            out[-1] += " | " + clean(x.text)
        else:
            text, at = [], 0
            for a, b in x.code:
                text += [clean(x.text[at:a]) + (" " if x.text[at:a].endswith(" ") else ""), "`" + x.text[a:b] + "`"]
                at = b
            rest = x.text[at:]
            text.append((" " if at and rest.startswith(" ") else "") + clean(rest))
            line = "".join(text)
            if line:
                quoted = x.node.tag == "p" and x.node.parent is not None and x.node.parent.tag == "blockquote"
                out.append(("> " if quoted else _prefix(x.node, numbers)) + line)
        row = here
    return "\n\n".join(out)


def clean_answer(markdown: str | None) -> str:
    """A Markdown answer without foreign markup. Null and blank give an empty string."""
    return clean(markdown, own_markdown=True) if markdown and markdown.strip() else ""


def _page_both(source: str | None) -> tuple[list[str], str]:
    page = Page(source)
    return _kinds_of(page.main_lines()), _text_of(page)


def _kernel(page: bool, text: bool):
    if text:
        both = _page_both if page else lambda x: (answer_kinds(x), clean_answer(x))
    else:
        both = lambda x: (page_kinds(x) if page else answer_kinds(x), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [both(x) for x in pdf["source"]]
            yield pd.DataFrame({"record_key": pdf["record_key"], "kinds": [k for k, _ in out], "clean_text": [t for _, t in out]})

    return run


def markup_residue(records: DataFrame, key: str, text: str, notation: str, with_text: bool = True) -> DataFrame:
    """``record_key, kinds, clean_text`` for every record; ``notation`` is ``html`` or ``markdown``.

    Null and empty texts have no kinds and an empty clean text; rows with a null key are
    left out; repeated rows stay repeated; other columns are not read.  Without
    ``with_text`` only records with residue come back, their clean_text null.
    """
    if notation not in ("html", "markdown"):
        raise ValueError(f"notation must be html or markdown, not {notation!r}")
    source = records.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("record_key"), F.col(text).alias("source"))
    if with_text:
        return source.mapInPandas(_kernel(notation == "html", True), _SCHEMA)
    if notation == "markdown":
        # The JVM leaves answers without any sign of foreign markup out before Python sees them.
        source = source.where(F.col("source").rlike(FOREIGN_SIGNS))
    return source.where(F.col("source").isNotNull()).mapInPandas(_kernel(notation == "html", False), _SCHEMA).where(F.size("kinds") > 0)


def found(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """p1_found: the residue kinds of both tables, one row per record and kind."""
    a = markup_residue(pages, "file_id", "html", "html", with_text=False).withColumn("source_table", F.lit("wcxb_samples"))
    b = markup_residue(answers, "response_id", "markdown", "markdown", with_text=False).withColumn("source_table", F.lit("test_responses"))
    return a.unionByName(b).select("source_table", "record_key", F.explode("kinds").alias("markup")).distinct()


def cleaned(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """p1_clean: every record of both tables with its residue kinds and its clean text, repeated records once."""
    a = markup_residue(pages, "file_id", "html", "html").withColumn("source_table", F.lit("wcxb_samples"))
    b = markup_residue(answers, "response_id", "markdown", "markdown").withColumn("source_table", F.lit("test_responses"))
    return a.unionByName(b).select("source_table", "record_key", "kinds", "clean_text").distinct()
