"""Main body of every page, and furniture in its extracted text, as Spark operators (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import stored
from .mainbody import Page, main_text
from .residue import labelled_records, residue_units


def _bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"record": pdf["record"], "main_body": [main_text(Page(x)) for x in pdf["source"]]})


def main_bodies(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``record, main_body``: one body block a line. A page without text has an empty body; repeated rows stay repeated."""
    return pages.select(F.col(key).cast("string").alias("record"), F.col(html).alias("source")).mapInPandas(_bodies, "record string, main_body string")


def furniture_lines(pages: DataFrame, key: str, html: str, content: str) -> DataFrame:
    """``record, line_no``: the lines of ``content``, counted from 1, that are furniture of the page.

    Pages of problem 2 are left out; a page is parsed once for its own lines and for the units
    that tell whether it is one.  Null or empty pages or contents give no rows, rows with a
    null key are ignored, a repeated row counts once, other columns are not read.
    """
    units = stored(residue_units(pages, key, html, content))
    strays = units.where("strays IS NOT NULL").select("record", F.explode("strays").alias("line_no"))
    return strays.join(labelled_records(units).select("record"), "record", "left_anti").distinct()


__all__ = ["furniture_lines", "main_bodies"]
