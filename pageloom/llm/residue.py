"""Template residue, filler, error and notice pages (problem 2).

Page-local kernels give each page its visible units - the main body, and on pages
without real content each top-level block - with a trusted label where the unit itself
proves to be residue (a field, a notice, filler).  Spark then spreads the trusted labels
over near-duplicates:

* units with the same masked text are collapsed into one class (pre-aggregated, so a
  text copied a million times is one row);
* every class gets the hashes of its five-word shingles and a SimHash signature of several
  words, made of them in one vectorised pass; the signature is cut into parts, one a
  table.  The width of the parts follows the number of classes, so that a bucket stays
  small at every size, and the number of tables follows from the width: as many as meet
  a pair at the wanted similarity with the wanted recall;
* rounds of label propagation join only the classes labelled last (the frontier) with
  the classes not labelled yet on the table key, verify the Hamming distance and the shingle
  similarity, and stop when no class is new.  The labelled classes are the connected
  components that hold a trusted label; components without one are never expanded.

Texts stay out of every join: pairs carry names, and are verified on hashes.  Each round's
frontier is written through ``checkpoint`` so that lost executors do not recompute
earlier rounds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import FEW, counted, cut, stored
from ..html.tree import Line
from .mainbody import Page, stray_lines, weight
from .notices import is_filler, is_notice, may_hold_filler, may_hold_notice, notice_line
from .placeholders import has_placeholder, may_hold_placeholder

SHINGLE, SIMILARITY = 5, 0.8
#: Of the pairs at the similarity, the part that the tables keep; pairs above it are missed less often.
RECALL = 0.95
#: A page whose main body weighs less has no real content, one with more may be a long notice; a notice may have so much text besides.
CONTENT, BESIDE = 420.0, 170.0
_INCIDENT, _NUMBER, _PATH = re.compile(r"\b[A-Z]{2}-\d+\b"), re.compile(r"\d+"), re.compile(r"/[a-z]{2,12}\b")
_WORDS = re.compile(r"\w+|#|§", re.U)


def mask(text: str, site: str) -> str:
    """Lower-case text with numbers, incident codes, paths and the site's name masked."""
    if "-" in text:
        text = _INCIDENT.sub("§", text)
    text = text.lower()
    if len(site) >= 3:
        text = text.replace(site.lower(), "§")
    text = _NUMBER.sub("#", text)
    if "/" in text:
        text = _PATH.sub("/§", text)
    return " ".join(text.split())


def shingles(text: str, width: int = SHINGLE) -> list[str]:
    words = _WORDS.findall(text)
    if len(words) < width:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def site_name(page: Page) -> str:
    title = next((x for x in page.root.children[0].elements() if x.tag == "title"), None)
    text = title.text() if title is not None else ""
    return re.split(r"\s[|–—·-]\s", text)[-1].strip() if re.search(r"\s[|–—·-]\s", text) else ""


def _all_notice(lines: list[Line], heavy: float) -> bool:
    """Whether a main body of the weight is a notice and little besides; the heaviest lines come first, so that content is told after a few."""
    spare, found = 0.0, False
    for x in sorted(lines, key=weight, reverse=True):
        if not x.pre and notice_line(x.text):
            found = True
        elif not x.node.tag.startswith("h"):
            spare += weight(x)
            if spare > BESIDE and spare > 0.2 * heavy:
                return False
    return found


def units_of(page: Page) -> list[tuple[str, bool]]:
    """(masked text, trusted) of a page's units; the first is the page as a whole."""
    site = site_name(page)
    shown = [x.outside_code() for x in page.lines]
    # A page without a sign of a field costs one search; fields do not cross lines.
    fields = [x for x in shown if has_placeholder(x)] if may_hold_placeholder("\n".join(shown)) else []
    if fields:
        # The unit is the lines with fields alone: what stands beside them may be real content, and says nothing of other pages.
        return [(mask(" ".join(fields), site), True)]
    out: list[tuple[str, bool]] = []
    main = [(x, w) for x, w, k in zip(page.lines, page.weights, page.main) if k]
    heavy = sum(w for _, w in main)
    text = " ".join(x.text for x, _ in main)
    told = may_hold_filler(text)
    filler = [is_filler(x.text, told) for x, _ in main]
    if any(filler):
        beside = [w for (x, w), f in zip(main, filler) if not f and not x.node.tag.startswith("h")]
        total = sum(w for (_, w), f in zip(main, filler) if f)
        return [(mask(text, site), len(beside) <= 2 and sum(beside) <= max(BESIDE, 0.25 * total))]
    if heavy >= CONTENT:
        return [(mask(text, site), may_hold_notice(text) and _all_notice([x for x, _ in main], heavy))]
    branches: dict[int, list[tuple[Line, float]]] = {}
    for x, w in zip(page.lines, page.weights):
        top = x.node
        while top is not page.body and top.parent is not page.body and top.parent is not None:
            top = top.parent
        branches.setdefault(id(top), []).append((x, w))
    for lines in branches.values():
        found = [bool(x.text) and not x.pre and is_notice(x.text) for x, _ in lines]
        spare = sum(w for (x, w), f in zip(lines, found) if not f and not x.node.tag.startswith("h"))
        out.append((mask(" ".join(x.text for x, _ in lines), site), any(found) and spare <= BESIDE))
    return out


def _kernel(strays: bool):
    """(record, source[, content]) -> one row per unit of a page, and with ``strays`` one row more with the numbers of its stray lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at, (key, source) in enumerate(zip(pdf["record"], pdf["source"])):
                if source is None:
                    continue
                page = Page(source)
                rows += [(key, text, trusted, None) for text, trusted in units_of(page) if text]
                if strays and pdf["content"].iloc[at]:
                    rows.append((key, None, None, stray_lines(page, pdf["content"].iloc[at])))
            yield pd.DataFrame(rows, columns=["record", "text", "trusted", "strays"])

    return run


def residue_units(pages: DataFrame, key: str, html: str, content: str | None = None) -> DataFrame:
    """``record, text, trusted, strays``: one row per unit of a page, its strays null.

    With ``content`` (the column of extracted text) a page has one row more, its text and
    trusted null, with the numbers of the content's lines that the page shows outside its main
    body: every page is parsed once for both.
    """
    rows = pages.where(F.col(key).isNotNull() & F.col(html).isNotNull())
    columns = [F.col(key).cast("string").alias("record"), F.col(html).alias("source"), *([F.col(content).alias("content")] if content else [])]
    return rows.select(*columns).mapInPandas(_kernel(content is not None), "record string, text string, trusted boolean, strays array<int>")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of all texts in a row, and how many each text has.

    A text with fewer words than ``width`` has one shingle of all its words; one without words has none.
    """
    words = [_WORDS.findall(x) for x in texts]
    counts = np.array([len(x) for x in words], dtype=np.int64)
    flat = [w for x in words for w in x]
    if not flat:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    codes, unique = pd.factorize(np.array(flat, dtype=object))
    tokens = pd.util.hash_array(np.asarray(unique, dtype=object), categorize=False)[codes]
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    last = (first + counts)[owner]
    starts = np.arange(len(tokens))
    value = np.zeros(len(tokens), np.uint64)
    for i in range(width):
        there = starts + i < last
        step = np.where(there, tokens[np.minimum(starts + i, len(tokens) - 1)], np.uint64(0))
        value = np.where(there, _mix(value * np.uint64(0x9E3779B97F4A7C15) ^ step), value)
    whole = (starts + width <= last) | (starts == first[owner])
    owner, value = owner[whole], value[whole]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
    return value[new], np.bincount(owner[new], minlength=len(texts))


#: A byte's bits, the highest first, as eight counters of a byte in one number.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def signatures(hashes: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """SimHash signatures of 64 x ``words`` bits, one row of 64-bit numbers a text; texts without shingles have zeros."""
    out = np.zeros((len(counts), words), np.uint64)
    some = np.nonzero(counts)[0]
    if not len(some):
        return out
    edges = np.concatenate([[0], np.cumsum(counts)])
    lo = 0
    while lo < len(some):  # so many texts at a time that their counters stay small
        hi = lo + 1
        while hi < len(some) and edges[some[hi] + 1] - edges[some[lo]] <= 100_000:
            hi += 1
        a, b = edges[some[lo]], edges[some[hi - 1] + 1]
        sizes = counts[some[lo:hi]]
        # A counter of a byte holds 255 votes: longer texts are counted in pieces.
        pieces = -(-sizes // 255)
        first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
        within = np.arange(pieces.sum()) - np.repeat(first, pieces)
        starts = np.repeat(edges[some[lo:hi]] - a, pieces) + within * 255
        for w in range(words):
            mixed = _mix(hashes[a:b] + np.uint64((w + 1) * 0xD1342543DE82EF95 % 2**64))
            votes = np.add.reduceat(_LANES[mixed.view(np.uint8).reshape(-1, 8)], starts, axis=0).view(np.uint8)
            if len(starts) > len(sizes):
                votes = np.add.reduceat(votes, first, axis=0, dtype=np.int64)
            out[some[lo:hi], w] = np.packbits(votes * 2 > sizes[:, None] if votes.dtype == np.int64 else votes > sizes[:, None] // 2, axis=1).view(np.uint64)[:, 0]
        lo = hi
    return out


def differing(similarity: float) -> float:
    """The share of SimHash bits in which two sets of the (Jaccard) similarity differ on average: the angle between them over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(classes: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, tables): keys wide enough for the number of classes, and as many tables as keep a pair at the similarity with the recall."""
    bits = min(24, max(12, math.ceil(math.log2(max(2, classes)))))
    same = (1 - differing(similarity)) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def table_keys(sign: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One key a table and signature: the table's own part of the signature, with the table's number above it."""
    flat = np.unpackbits(sign.view(np.uint8).reshape(len(sign), -1), axis=1)[:, : bits * tables].reshape(-1, bits)
    values = np.zeros(len(flat), np.int64)
    for k in range(bits):
        values = values * 2 + flat[:, k]
    values = values.reshape(len(sign), tables)
    return values + (np.arange(tables, dtype=np.int64) << 32)


def _sketched(classes: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, int]:
    """``classes`` with shingle hashes, signature and table keys, and the Hamming distance up to which pairs are verified."""
    bits, tables = tables_for(classes.count(), similarity, recall)
    words = math.ceil(bits * tables / 64)
    p, n = differing(similarity), 64 * words
    limit = math.ceil(n * p + 4 * math.sqrt(n * p * (1 - p)))

    def sketch(text: pd.Series) -> pd.DataFrame:
        hashes, counts = shingle_hashes(list(text))
        sign = signatures(hashes, counts, words)
        keys = list(table_keys(sign, bits, tables))
        for i in np.nonzero(counts == 0)[0]:  # nothing to be similar by
            keys[i] = keys[i][:0]
        return pd.DataFrame({"shingles": np.split(hashes.view(np.int64), np.cumsum(counts)[:-1]), "signature": list(sign.view(np.int64)), "keys": keys})

    made = F.pandas_udf(sketch, "struct<shingles:array<bigint>,signature:array<bigint>,keys:array<bigint>>")
    return classes.withColumn("s", made("text")).select("klass", "trusted", "s.*"), limit


def spread_labels(units: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, few: int = FEW) -> DataFrame:
    """``klass, trusted``: the classes of text (``xxhash64`` of it) that are in one connected component with a trusted one.

    ``units`` has ``text`` and ``trusted``.  Two texts are linked when they share a key in a
    SimHash table, are within the Hamming distance of pairs at the similarity, and their
    shingle sets reach it.  A frontier, its keys and its pairs are broadcast to the stored tables
    where counting shows at most ``few`` rows, and shuffled beyond.
    """
    classes = stored(units.groupBy(F.xxhash64("text").alias("klass")).agg(F.first("text").alias("text"), F.max("trusted").alias("trusted")))
    sketched, limit = _sketched(classes, similarity, recall)
    sketched = stored(sketched)
    tables = stored(sketched.where(~F.col("trusted")).select("klass", F.explode("keys").alias("key")))
    labelled = sketched.where("trusted").select("klass", "trusted")
    frontier = cut(labelled.select("klass"))
    distance = F.aggregate(F.zip_with("signature", "signature0", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    both = F.size(F.array_intersect("shingles", "shingles0"))
    jaccard = both / (F.size("shingles") + F.size("shingles0") - both)
    marks = lambda klass, end: sketched.select(F.col("klass").alias(klass), F.col("signature").alias(f"signature{end}"), F.col("shingles").alias(f"shingles{end}"))
    while True:
        probes = cut(sketched.join(counted(frontier, few), "klass", "left_semi").select(F.col("klass").alias("from"), F.explode("keys").alias("key")))
        met = tables.join(counted(probes, few), "key").select("klass", "from").distinct().join(labelled.select("klass"), "klass", "left_anti")
        met = counted(cut(met), few)
        pairs = marks("klass", "").join(met, "klass").join(marks("from", "0").join(met.select("from"), "from", "left_semi"), "from")
        frontier = cut(pairs.where((distance <= limit) & (jaccard >= similarity - 1e-9)).select("klass").distinct())
        if frontier.isEmpty():
            return labelled
        labelled = labelled.unionByName(frontier.withColumn("trusted", F.lit(False)))


def labelled_records(units: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``record, trusted``: the pages with a labelled unit, each once; trusted where one of its own units was a seed."""
    named = units.where("text IS NOT NULL").withColumn("klass", F.xxhash64("text"))
    return named.select("record", "klass").join(spread_labels(named, similarity, recall), "klass").groupBy("record").agg(F.max("trusted").alias("trusted"))


def find_residue(pages: DataFrame, key: str, html: str, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``record``: the keys of pages that are residue, each once.

    Null and empty pages are no residue (they show nothing); rows with a null key are
    ignored; repeated rows count once; other columns are not read.
    """
    return labelled_records(stored(residue_units(pages, key, html)), similarity, recall).select("record")


def without_residue(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The pages that are no residue, with all their columns."""
    found = find_residue(pages, key, html).withColumnRenamed("record", "_record")
    return pages.join(found, pages[key].cast("string") == found["_record"], "left_anti")
