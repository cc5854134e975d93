"""Where results go: feature files, Markdown and JSON, event lines, deterministic templates, webhooks."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operator_templates import snapshot_of


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls as nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_tsv(features: DataFrame, path: str, names: list[str]) -> None:
    """Feature rows (``page, xpath, features``, and ``in_gold`` where there is one) with a column per feature, tab-separated with a header."""
    label = [F.col("in_gold").cast("int").alias("label")] if "in_gold" in features.columns else []
    columns = [F.get("features", F.lit(i)).alias(n) for i, n in enumerate(names)]
    features.select("page", "xpath", *label, *columns).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def write_markdown(results: DataFrame, path: str) -> None:
    """``page, markdown`` as one text a page, in folders ``page=...``; pages without text are left out."""
    results.where(F.length("markdown") > 0).select("page", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("page").text(path)


def write_events(lines: DataFrame, path: str) -> None:
    """Event lines (``value``) appended to a folder."""
    lines.select("value").write.mode("append").text(path)


def posting(send: Callable[[str], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: every event line of a batch goes to ``send`` (a webhook), from the executors; a line that fails does not stop the rest."""

    def each(rows) -> None:
        for r in rows:
            try:
                send(r["value"])
            except OSError:
                continue

    return lambda batch, _: batch.foreachPartition(each)


def write_templates(novel: DataFrame, folder: str) -> DataFrame:
    """Deterministic templates of ``host, extractor`` (JSON), one file a host in a folder that all executors share; returns ``host, file``.

    Of several extractors of a host the smallest text counts, so that a repeated run writes the same files.
    """
    one = novel.where("host IS NOT NULL AND host <> ''").groupBy("host").agg(F.min("extractor").alias("extractor"))

    @F.udf("string")
    def write(host: str, extractor: str) -> str:
        name, text = snapshot_of(host, json.loads(extractor))
        target = Path(folder)
        target.mkdir(parents=True, exist_ok=True)
        (target / name).write_text(text, encoding="utf-8")
        return name

    return one.select("host", write("host", "extractor").alias("file"))


def json_results(results: DataFrame) -> DataFrame:
    """``value``: every result row as one JSON line."""
    return results.select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("value"))
