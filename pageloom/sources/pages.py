"""Where pages come from: tables, folders, labelled corpora, address lists, and a fetching data source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.web import host_of


def from_folder(spark: SparkSession, path: str) -> DataFrame:
    """``url, host, html`` of the HTML files of a folder; a file's host is ``file:<name>``."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
    stem = F.regexp_replace(F.regexp_extract("url", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return files.select("url", F.concat(F.lit("file:"), stem).alias("host"), "html")


def addresses(spark: SparkSession, path: str) -> DataFrame:
    """``url`` of a list file; blank lines and lines that begin with # are no addresses."""
    line = F.trim("value")
    return spark.read.text(path).where((F.length(line) > 0) & ~F.col("value").startswith("#")).select(line.alias("url"))


def labelled_corpus(spark: SparkSession, folder: str, split: str, page_type: str | None = None) -> DataFrame:
    """``file_id, url, page_type, main_content, wanted, unwanted, html`` of a split: JSON labels joined with (gzipped) pages."""
    schema = (
        "file_id string, url string, _internal struct<page_type:struct<primary:string>>, ground_truth struct<main_content:string,`with`:array<string>,without:array<string>>"
    )
    gold = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{split}/ground-truth/*.json")
    labels = gold.select("file_id", "url", F.col("_internal.page_type.primary").alias("page_type"), F.col("ground_truth.main_content").alias("main_content"), F.col("ground_truth.with").alias("wanted"), F.col("ground_truth.without").alias("unwanted"))
    if page_type is not None:
        labels = labels.where(F.col("page_type") == page_type)
    pages = spark.read.text(f"{folder}/{split}/html/*", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.html(?:\.gz)?$", 1).alias("file_id"), F.col("value").alias("html"))
    return labels.join(pages, "file_id")


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        super().__init__(0)
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], fetch: Callable[[str], str | None], parts: int):
        self.urls, self.fetch, self.parts = urls, fetch, parts

    def partitions(self):
        n = max(1, min(self.parts, len(self.urls)))
        return [_Part(self.urls[k::n]) for k in range(n)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for url in partition.urls:
            yield url, self.fetch(url)


def fetching_source(name: str, urls: list[str], fetch: Callable[[str], str | None], parts: int = 8) -> type[DataSource]:
    """A data source ``name`` that reads ``url, html`` through ``fetch`` (static or rendered); register it with
    ``spark.dataSource.register``.  A fetch that fails gives null."""

    class Fetching(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "url string, html string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(urls, fetch, parts)

    return Fetching


def links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``source, target``: the links of pages as canonical absolute addresses, by regular expression in the JVM."""
    href = F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1)))
    rows = pages.where(F.col(url).isNotNull()).select(F.lower(F.regexp_replace(F.col(url), "#.*$", "")).alias("source"), href.alias("href"))
    base = F.regexp_extract("source", r"^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    target = F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(base, F.col("href")))
    return rows.select("source", F.lower(F.regexp_replace(target, "#.*$", "")).alias("target")).where(F.col("target").isNotNull() & (host_of(F.col("target")) != "")).distinct()
