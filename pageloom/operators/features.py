"""45 features per element, and labels from gold text, for training block classifiers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a32
from ..html.shred import Dom

_TAGS = "main article section aside nav header footer form table pre div".split()
NAMES = (
    [f"tag_{t}" for t in _TAGS] + ["tag_other"] + [f"class_{i}" for i in range(8)]
    + "log_text link_density image_density log_words log_headings log_paragraphs log_items para_heading inputs buttons depth from_start from_end siblings "
    "sibling_text same_tag same_tag_share entropy largest texty_siblings in_main in_article in_nav in_form in_aside".split()
)
_HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")


def features_of(dom: Dom, i: int) -> list[float]:
    """The features of one element, in the order of NAMES."""
    x, n = dom.nodes[i], dom.length(i)
    out = [float(x.tag == t) for t in _TAGS] + [float(x.tag not in _TAGS)]
    buckets = {fnv1a32(c) % 8 for c in x.classes}
    out += [float(k in buckets) for k in range(8)]
    tags = Counter(dom.nodes[k].tag for k in range(i + 1, dom.end[i] + 1))
    heads, paras = sum(tags[h] for h in _HEADS), tags["p"]
    words = len(dom.text_of(i).replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")) - dom.text_of(i).replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ").count("")
    out += [math.log1p(n), dom.density(i), tags["img"] / (1 + n // 100) if n else 0.0, math.log1p(words), math.log1p(heads), math.log1p(paras), math.log1p(tags["li"])]
    out += [paras / heads if heads else float(min(paras, 10)), float(min(tags["input"], 20)), float(min(tags["button"], 20))]
    up = dom.parent[i]
    kids = dom.kids[up] if up >= 0 else [i]
    at, m = kids.index(i), len(kids)
    above = dom.length(up) if up >= 0 else n
    same = sum(dom.nodes[k].tag == x.tag for k in kids) - 1
    others = Counter(dom.nodes[k].tag for k in kids if k != i)
    total = sum(others.values())
    entropy = -sum(c / total * math.log2(c / total) for c in others.values()) if m > 2 else 0.0
    out += [float(min(dom.depth[i], 20)), at / (m - 1) if m > 1 else 0.0, (m - 1 - at) / (m - 1) if m > 1 else 0.0, float(min(m, 50)), (above - n) / above if above else 0.0]
    out += [float(min(same, 20)), same / (m - 1) if m > 1 else 0.0, entropy, float(n > 0 and n == max(dom.length(k) for k in kids)), float(min(sum(bool(dom.trimmed(k)) for k in kids if k != i), 20))]
    return out + [float(dom.under(i, (t,))) for t in ("main", "article", "nav", "form", "aside")]


def _rows(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, source in zip(pdf["page"], pdf["source"]):
                dom = Dom.of(source, drop=frozenset())
                for i in range(1, len(dom)):
                    if dom.length(i) >= least:
                        text = " ".join(dom.text_of(i).split())
                        rows.append((page, dom.xpath(i), dom.nodes[i].tag, dom.length(i), text, features_of(dom, i)))
            yield pd.DataFrame(rows, columns=["page", "xpath", "tag", "text_len", "text", "features"])

    return run


def element_features(pages: DataFrame, key: str, html: str, least: int = 1) -> DataFrame:
    """``page, xpath, tag, text_len, text, features`` of every element with at least ``least`` characters, from the uncleaned page."""
    rows = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("page"), F.col(html).alias("source"))
    return rows.mapInPandas(_rows(least), "page string, xpath string, tag string, text_len int, text string, features array<float>")


def gold_labels(features: DataFrame, gold: DataFrame, key: str, text: str, least: int = 20) -> DataFrame:
    """``page, xpath, in_gold``: whether an element's squeezed text of at least ``least`` characters stands in the gold text."""
    flat = gold.select(F.col(key).cast("string").alias("page"), F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " ")).alias("gold"))
    return features.join(flat, "page").select("page", "xpath", ((F.length("text") >= least) & F.contains("gold", F.lower("text"))).alias("in_gold"))
