"""Structural fingerprints of pages, and likeness between them.

One Arrow pass per page gives everything a template needs (shingle MinHash, its bands,
anchor MinHash, pq-grams).  Likeness, banding joins, sparse dot products and the choice of
the best template are plain Catalyst.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import stored
from ..functions.hashing import bands, minhash, xxh64
from ..functions.stability import quiet_classes
from ..html.shred import Dom

P, Q, TOP, WIDTH, MANY = 2, 3, 256, 3, 4
FAST, SLOW = 0.85, 0.75
#: Aging: weight of observations, weight of recency, and its time constant in days.
BY_COUNT, BY_AGE, DAYS = 0.02, 0.05, 30.0
SCHEMA = "minhash array<bigint>, bands array<bigint>, anchors array<bigint>, grams map<string,double>, norm double, n_shingles int, hex string"


def _u64(x: int) -> bytes:
    return x.to_bytes(8, "little")


@functools.lru_cache(maxsize=1 << 16)
def _class_hash(classes: tuple[str, ...]) -> int:
    kept = quiet_classes(list(classes))
    return xxh64(",".join(sorted(kept)).encode()) if kept else 0


def class_hash(classes: list[str]) -> int:
    """The hash of an element's class tokens without noise; the same few token lists stand on most elements."""
    return _class_hash(tuple(classes)) if classes else 0


def shingles(dom: Dom) -> np.ndarray:
    """Hashes of WIDTH consecutive elements in document order; fewer elements stand for themselves."""
    above = [0] * len(dom)
    marks = []
    for i, x in enumerate(dom.nodes):
        up = dom.parent[i]
        tag = x.tag.encode()
        path = above[up] if up >= 0 else 0
        marks.append(xxh64(_u64(class_hash(x.classes)) + min(dom.nth[i], MANY).to_bytes(4, "little") + _u64(path) + tag))
        above[i] = xxh64(_u64(path) + tag)
    if len(marks) < WIDTH:
        return np.array(marks, dtype=np.uint64)
    raw = np.array(marks, dtype="<u8").tobytes()
    return np.array([xxh64(raw[8 * i : 8 * (i + WIDTH)]) for i in range(len(marks) - WIDTH + 1)], dtype=np.uint64)


def anchor_marks(dom: Dom) -> np.ndarray:
    """One hash per link: where it stands, where it leads, whether it has a fragment, its classes."""
    out = []
    for i, x in enumerate(dom.nodes):
        if x.tag != "a":
            continue
        path = "".join(dom.nodes[k].tag + "/" for k in dom.ancestors(i)) + "html/"
        href = x.attrs.get("href", "")
        try:
            host = "" if href.startswith(("/", "#")) else (urlsplit(href).hostname or "") if "://" in href else ""
        except ValueError:
            host = ""
        out.append(xxh64(f"{xxh64(path.encode())}|{host}|{int('#' in href)}|{class_hash(x.classes)}".encode()))
    return np.array(out, dtype=np.uint64)


def gram_counts(dom: Dom) -> Counter:
    """How often each pq-gram occurs: an element with its parent, and every window over its children."""
    out: Counter = Counter()
    for i, x in enumerate(dom.nodes):
        stem = f"{dom.nodes[dom.parent[i]].tag if dom.parent[i] >= 0 else '*'},{x.tag}"
        row = ["*"] * (Q - 1) + [dom.nodes[k].tag for k in dom.kids[i]] + ["*"] * (Q - 1)
        for k in range(len(row) - Q + 1):
            out[f"{stem},{','.join(row[k : k + Q])}"] += 1
    return out


def _shape(dom: Dom) -> tuple:
    """All that a fingerprint depends on: the elements with their parents and attributes, no text."""
    return tuple(dom.parent), tuple([x.tag for x in dom.nodes]), tuple([a if type(a := x._attrs) is str else tuple(a.items()) for x in dom.nodes])


#: Fingerprints and their digests by shape, for pages that differ in their texts only; at most so many at a time.
_KNOWN: dict[tuple, tuple[bytes, dict]] = {}
_KEPT = 512


def _known(dom: Dom) -> tuple[bytes, dict]:
    shape = _shape(dom)
    if shape not in _KNOWN:
        if len(_KNOWN) >= _KEPT:
            _KNOWN.clear()
        one = _fingerprint(dom)
        _KNOWN[shape] = hashlib.blake2b(json.dumps(one).encode(), digest_size=16).digest(), one
    return _KNOWN[shape]


def fingerprint(source: "str | Dom | None") -> dict:
    """The fingerprint of a page. An empty page has the marks of its lone body element."""
    return dict(_known(source if isinstance(source, Dom) else Dom.of(source))[1])


def _fingerprint(dom: Dom) -> dict:
    marks = shingles(dom)
    slots = minhash(marks)
    top = dict(sorted(gram_counts(dom).items(), key=lambda kv: (-kv[1], kv[0]))[:TOP])
    return {
        "minhash": slots.astype(np.int64).tolist(),
        "bands": bands(slots).tolist(),
        "anchors": minhash(anchor_marks(dom)).astype(np.int64).tolist(),
        "grams": {k: float(v) for k, v in top.items()},
        "norm": float(np.sqrt(sum(v * v for v in top.values()))),
        "n_shingles": len(marks),
        "hex": slots[:4].astype("<u4").tobytes().hex().upper(),
    }


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [fingerprint(x) for x in pdf["source"]]
        yield pd.concat([pdf[["page", "host"]].reset_index(drop=True), pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])], axis=1)


def fingerprints(pages: DataFrame, key: str, host: str, html: str) -> DataFrame:
    """``page, host`` and the fingerprint columns; one row per page, rows with a null key left out."""
    rows = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("page"), F.lower(F.coalesce(F.col(host), F.lit(""))).alias("host"), F.col(html).alias("source"))
    return rows.mapInPandas(_prints, f"page string, host string, {SCHEMA}")


def layouts(pages: DataFrame, key: str, host: str, html: str, *more: str) -> DataFrame:
    """``page, host``, the columns ``more``, ``klass, minhash, bands, grams``: one narrow row per page.

    ``klass`` names the host and the whole fingerprint.  The fingerprint itself is only in a row of each
    class in every Arrow batch and null in the others, so that a layout with many pages costs little more
    than their names; ``classes_of`` gathers it.  Rows with a null key are left out.
    """
    parts = ["minhash", "bands", "grams"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, seen = [], set()
            for h, source in zip(pdf["host"], pdf["source"]):
                digest, one = _known(Dom.of(source))
                klass = hashlib.blake2b(h.encode() + b"\0" + digest, digest_size=16).hexdigest()
                rows.append((klass, *([None] * len(parts) if klass in seen else [one[c] for c in parts])))
                seen.add(klass)
            yield pd.concat([pdf.drop(columns="source").reset_index(drop=True), pd.DataFrame(rows, columns=["klass", *parts], dtype=object)], axis=1)

    rows = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("page"), F.lower(F.coalesce(F.col(host), F.lit(""))).alias("host"), *more, F.col(html).alias("source"))
    given = "".join(f"{c} {pages.schema[c].dataType.simpleString()}, " for c in more)
    return rows.mapInPandas(run, f"page string, host string, {given}klass string, " + ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in parts))


def classes_of(pages: DataFrame) -> DataFrame:
    """``host, klass, minhash, bands, grams``: one row per class of what ``layouts`` gives."""
    return pages.where("minhash IS NOT NULL").groupBy("host", "klass").agg(*[F.first(c).alias(c) for c in ("minhash", "bands", "grams")])


# ------------------------------------------------------------------------------- Catalyst side


def jaccard(a: Column, b: Column) -> Column:
    """Part of equal slots of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a).cast("double")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two sparse vectors (maps); 0 where either is empty."""
    # One pass over the keys of both, by hash, instead of a search per key.
    dot = F.aggregate(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x * y, F.lit(0.0)))), F.lit(0.0), lambda s, v: s + v)
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))
    return F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def aging(likeness: Column, observations: Column, age_days: Column) -> Column:
    """A template's score: likeness, plus a little for being seen often and lately."""
    return likeness + BY_COUNT * F.log1p(observations.cast("double")) + BY_AGE * F.exp(-age_days / DAYS)


def _best(scored: DataFrame) -> DataFrame:
    """The template with the best score of every page; ties go to the smaller template_id."""
    return scored.groupBy("page").agg(F.min_by(F.struct("template_id", "similarity", "score"), F.struct(-F.round("score", 9), F.col("template_id"))).alias("b")).select("page", "b.*")


def _scored(both: DataFrame, as_of: Column) -> DataFrame:
    age = (F.unix_micros(as_of) - F.unix_micros("last_seen")) / 86_400_000_000.0
    return both.withColumn("score", aging(F.col("similarity"), F.col("observation_count"), age))


def _shuffled(df: DataFrame) -> DataFrame:
    """A side that is never broadcast: equal fingerprints make files so much smaller than their rows that an estimate by bytes would send them all to the driver."""
    return df.hint("merge")


def fast_probe(pages: DataFrame, templates: DataFrame, as_of: Column, threshold: float = FAST) -> DataFrame:
    """``page, template_id, similarity, score``: the best template of the page's own host that shares a band.

    ``pages`` has page, host, minhash, bands; ``templates`` template_id, host, minhash, bands,
    observation_count, last_seen; slots and bands may be of any type.  Candidates come from an
    equi-join on (host, band number, band) of equal fingerprints taken together, so that a layout
    with many pages is one row; a template never matches the page of its own name.
    """
    classes = pages.groupBy("host", "minhash").agg(F.first("bands").alias("bands")).withColumn("klass", F.xxhash64("host", "minhash"))
    return fast_classes(pages.select("page", F.xxhash64("host", "minhash").alias("klass")), classes, templates, as_of, threshold)


def fast_classes(named: DataFrame, classes: DataFrame, templates: DataFrame, as_of: Column, threshold: float = FAST) -> DataFrame:
    """The same with equal fingerprints taken together already: ``named`` has page and klass, ``classes`` klass, host, minhash, bands."""
    split = lambda df, *keep: df.select(*keep, "host", F.posexplode("bands").alias("band", "hash"))
    met = split(classes, "klass").join(_shuffled(split(templates, "template_id")), ["host", "band", "hash"]).select("klass", "template_id").distinct()
    both = met.join(_shuffled(classes.select("klass", F.col("minhash").alias("probe"))), "klass").join(_shuffled(templates.select("template_id", "minhash", "observation_count", "last_seen")), "template_id")
    alike = both.withColumn("similarity", jaccard(F.col("probe"), F.col("minhash"))).where(F.col("similarity") >= threshold).drop("probe", "minhash")
    return _best(_scored(_shuffled(named.select("page", "klass")).join(alike, "klass").where(F.col("page") != F.col("template_id")), as_of))


#: So many classes or templates of a host meet at once in one task, and so many classes at a time inside it.
BLOCK, ROWS = 2048, 512
#: Matrices of so few entries are full whatever their codes.
FULL = 1 << 20


def slow_probe(pages: DataFrame, templates: DataFrame, as_of: Column, threshold: float = SLOW) -> DataFrame:
    """The same by cosine of pq-grams: every page meets every template of its host, exactly.

    Equal grams of a host are taken together, and a class needs its two best templates only, as a
    page is barred from one at most.  Hosts meet in blocks, as products of matrices.
    """
    name = F.sha2(F.concat_ws("|", "host", F.to_json(F.array_sort(F.map_entries("grams")))), 256)
    rows = stored(pages.where("host IS NOT NULL AND grams IS NOT NULL").select("page", "host", "grams", name.alias("klass")))
    classes = rows.groupBy("host", "klass").agg(F.first("grams").alias("grams"))
    return slow_classes(rows.select("page", "klass"), classes, templates, as_of, threshold)


def slow_classes(named: DataFrame, classes: DataFrame, templates: DataFrame, as_of: Column, threshold: float = SLOW) -> DataFrame:
    """The same with equal grams taken together already: ``named`` has page and klass, ``classes`` klass, host, grams."""
    age = (F.unix_micros(as_of) - F.unix_micros("last_seen")) / 86_400_000_000.0
    left = stored(classes.select("host", "klass", "grams"))
    right = stored(templates.where("host IS NOT NULL").select("host", F.col("template_id").alias("klass"), "grams", (BY_COUNT * F.log1p(F.col("observation_count").cast("double"))).alias("often"), (BY_AGE * F.exp(-age / DAYS)).alias("lately")))
    sizes = left.groupBy("host").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("m")).unionByName(right.groupBy("host").agg(F.lit(0).cast("bigint").alias("n"), F.count("*").alias("m"))).groupBy("host").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    parts = lambda c: F.ceil(F.col(c) / BLOCK)
    sizes = stored(sizes.where("n > 0 AND m > 0").select("host", parts("n").cast("int").alias("n_parts"), parts("m").cast("int").alias("m_parts")))
    # Hosts of one block share tasks; the blocks of a larger one meet block by block.
    tasks = (left.count() + right.count()) // BLOCK + 1
    alone = F.col("n_parts") * F.col("m_parts") == 1
    own = F.when(alone, F.pmod(F.xxhash64("host"), F.lit(tasks)).cast("int"))
    at = lambda c: F.pmod(F.xxhash64("klass"), F.col(c)).cast("int")
    placed = lambda df, i, j: df.join(_shuffled(sizes), "host").select(*df.columns, F.when(alone, F.lit("")).otherwise(F.concat(F.lit("="), "host")).alias("whose"), F.coalesce(own, i).alias("i"), F.explode(F.when(alone, F.array(F.lit(0))).otherwise(j)).alias("j"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    a = placed(left, at("n_parts"), upto("m_parts"))
    b = placed(right, at("m_parts"), upto("n_parts")).select(*right.columns, "whose", F.when(F.col("whose") == "", F.col("i")).otherwise(F.col("j")).alias("i"), F.when(F.col("whose") == "", F.col("j")).otherwise(F.col("i")).alias("j"))
    # Tasks by number, not by bytes: few bytes are much work here.
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, min(4 * (tasks + (sizes.agg(F.sum(F.when(~alone, F.col("n_parts").cast("bigint") * F.col("m_parts")))).first()[0] or 0)), 4096))
    a, b = (x.repartition(tasks, "whose", "i", "j") for x in (a, b))
    met = a.groupBy("whose", "i", "j").cogroup(b.groupBy("whose", "i", "j"))
    best = met.applyInArrow(lambda x, y: nearest(x, y, threshold), "klass string, template_id string, similarity double, score double")
    return _best(_shuffled(named).join(best, "klass").where(F.col("page") != F.col("template_id")))


def _entries(grams: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, key and value of every entry of a column of maps."""
    keys, rows, values, first = [], [], [], 0
    for c in grams.chunks:
        ends = c.offsets.to_numpy()
        rows.append(np.repeat(np.arange(first, first + len(c)), np.diff(ends)))
        keys.append(c.keys[ends[0] : ends[-1]])
        values.append(c.items[ends[0] : ends[-1]].to_numpy(zero_copy_only=False))
        first += len(c)
    if not keys:
        return np.zeros(0, dtype=np.int64), pa.array([], "string"), np.zeros(0)
    return np.concatenate(rows), pa.concat_arrays(keys), np.concatenate(values)


def nearest(left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    """``klass, template_id, similarity, score``: of every class of ``left`` the best template of its host in ``right``, and the best of another name.

    The order is that of ``_best``: the score to nine digits, then the template_id.
    """
    n = len(left)
    (row_a, keys_a, x), (row_b, keys_b, y) = _entries(left["grams"]), _entries(right["grams"])
    code = pa.concat_arrays([keys_a, keys_b]).dictionary_encode().indices.to_numpy()
    norm_a, norm_b = np.sqrt(np.bincount(row_a, x * x, n)), np.sqrt(np.bincount(row_b, y * y, len(right)))
    names = pa.concat_arrays([*left["host"].chunks, *right["host"].chunks]).dictionary_encode().indices.to_numpy()
    rank = _ranks(right["klass"].to_pylist())
    sides = []
    for hosts, row, codes, value in ((names[:n], row_a, code[: len(row_a)], x), (names[n:], row_b, code[len(row_a) :], y)):
        by, order = np.argsort(hosts, kind="stable"), np.argsort(hosts[row], kind="stable")
        bounds = np.arange(int(names.max()) + 2)
        spot = np.empty(len(hosts), dtype=np.int64)
        spot[by] = np.arange(len(by))
        ends = np.searchsorted(hosts[by], bounds)
        sides.append((by, ends, np.searchsorted(hosts[row][order], bounds), spot[row][order] - ends[hosts[row][order]], codes[order], value[order]))
    (by_a, ends_a, cuts_a, *flat_a), (by_b, ends_b, cuts_b, *flat_b) = sides
    often, lately = (right[c].to_numpy() for c in ("often", "lately"))
    out = []
    for h in range(int(names.max()) + 1):
        rows, cols = by_a[ends_a[h] : ends_a[h + 1]], by_b[ends_b[h] : ends_b[h + 1]]
        if not len(rows) or not len(cols):
            continue
        here_a, here_b = ([c[cuts[h] : cuts[h + 1]] for c in flat] for flat, cuts in ((flat_a, cuts_a), (flat_b, cuts_b)))
        for lo, dot in _products(here_a, here_b, len(rows), len(cols)):
            norms = norm_a[rows[lo : lo + len(dot)]][:, None] * norm_b[cols][None, :]
            alike = np.divide(dot, norms, out=np.zeros_like(dot), where=norms != 0)
            score = alike + often[cols] + lately[cols]
            for i, j in _two(np.where(alike >= threshold, np.where(np.isnan(score), np.inf, score), -np.inf), score, rank[cols]):
                out.append((rows[lo + i], cols[j], alike[i, j], score[i, j]))
    k, t, s, v = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))
    return pa.table({"klass": left["klass"].take(pa.array(k)), "template_id": right["klass"].take(pa.array(t)), "similarity": pa.array(s), "score": pa.array(v, from_pandas=True)})


def _ranks(names: list[str]) -> np.ndarray:
    """The places of names in their order; equal names have one."""
    place = {k: i for i, k in enumerate(sorted(set(names)))}
    return np.array([place[k] for k in names], dtype=np.int64)


def _products(a: list[np.ndarray], b: list[np.ndarray], n: int, m: int) -> Iterator[tuple[int, np.ndarray]]:
    """Dot products of n and m sparse rows, given as (row, code, value) in the order of rows: ROWS of the first at a time.

    Codes that many rows of both have are columns of matrices, the others are added pair by pair.
    """
    both = np.intersect1d(a[1], b[1])
    a, b = ([c[np.isin(side[1], both)] for c in side] for side in (a, b))
    (row_a, code_a, x), (row_b, code_b, y) = ((row, np.searchsorted(both, code), value) for row, code, value in (a, b))
    often_a, often_b = np.bincount(code_a, minlength=len(both)), np.bincount(code_b, minlength=len(both))
    dense = (often_a * often_b >= n * m / 500) | ((n + m) * len(both) <= FULL)
    column = np.cumsum(dense) - 1
    width = int(dense.sum())
    full_a, full_b = dense[code_a], dense[code_b]
    rest = np.flatnonzero(~full_b)[np.argsort(code_b[~full_b], kind="stable")]
    starts = np.searchsorted(code_b[rest], np.arange(len(both)))

    def matrix(rows, columns, values, height, lo):
        out = np.zeros((height, min(BLOCK, width - lo)))
        inside = (columns >= lo) & (columns < lo + out.shape[1])
        out[rows[inside], columns[inside] - lo] = values[inside]
        return out

    right = [matrix(row_b[full_b], column[code_b[full_b]], y[full_b], m, lo) for lo in ([0] if 0 < width <= BLOCK else [])]
    for first in range(0, n, ROWS):
        height = min(ROWS, n - first)
        part = slice(*np.searchsorted(row_a, [first, first + height]))
        r, c, v, f = row_a[part] - first, code_a[part], x[part], full_a[part]
        dot = np.zeros((height, m))
        for lo in range(0, width, BLOCK):
            other = right[0] if right else matrix(row_b[full_b], column[code_b[full_b]], y[full_b], m, lo)
            dot += matrix(r[f], column[c[f]], v[f], height, lo) @ other.T
        r, c, v = r[~f], c[~f], v[~f]
        if len(c):
            times = often_b[c]
            at = rest[np.repeat(starts[c] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            dot += np.bincount(np.repeat(r, times) * m + row_b[at], np.repeat(v, times) * y[at], height * m).reshape(height, m)
        yield first, dot


def _nine(score: np.ndarray) -> np.ndarray:
    """Scores in units of the ninth digit, halves away from zero as ``round`` has it; unknown ones come first, as nulls do."""
    units = np.floor(score * 1e9 + 0.5)
    for k in np.flatnonzero(np.abs(score * 1e9 - np.floor(score * 1e9) - 0.5) < 1e-4):
        units[k] = float(Decimal(repr(float(score[k]))).quantize(Decimal("1e-9"), ROUND_HALF_UP).scaleb(9))
    return np.where(np.isnan(score), np.inf, units)


def _two(worth: np.ndarray, score: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and column of the best of every row that has one, then of the best of another name; ``worth`` is used up."""
    for again in (False, True):
        top = worth.max(axis=1)
        some = np.flatnonzero(top > -np.inf)
        i, j = np.nonzero(worth[some] >= top[some, None] - 2e-9)
        i = some[i]
        order = np.lexsort((rank[j], -_nine(score[i, j]), i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        yield i[first], j[first]
        if not again:
            taken = np.full(len(worth), -1, dtype=np.int64)
            taken[i[first]] = rank[j[first]]
            worth[rank[None, :] == taken[:, None]] = -np.inf


def node_shingles(nodes: DataFrame) -> DataFrame:
    """``page, pre, shingle``: the shingle windows over the node table with built-in functions only (tags, not hashes)."""
    order = Window.partitionBy("page").orderBy("pre")
    tags = [F.col("tag"), F.lead("tag", 1).over(order), F.lead("tag", 2).over(order)]
    return nodes.select("page", "pre", F.concat_ws(">", *tags).alias("shingle"), tags[2].alias("last")).where("last IS NOT NULL").drop("last")


def node_grams(nodes: DataFrame) -> DataFrame:
    """``page, gram, n``: pq-gram counts from the node table: children windows with null padding, then a count."""
    parents = nodes.select("page", F.col("pre").alias("parent"), F.col("tag").alias("tag0"), F.col("parent").alias("up"))
    above = nodes.select("page", F.col("pre").alias("up"), F.col("tag").alias("stem0"))
    kids = nodes.where("parent >= 0").select("page", "parent", "sib_idx", "tag")
    lists = kids.groupBy("page", "parent").agg(F.transform(F.sort_array(F.collect_list(F.struct("sib_idx", "tag"))), lambda x: x["tag"]).alias("tags"))
    pad = F.array_repeat(F.lit("*"), Q - 1)
    padded = F.concat(pad, F.coalesce(F.col("tags"), F.array().cast("array<string>")), pad)
    rows = parents.join(lists, ["page", "parent"], "left").join(above, ["page", "up"], "left").withColumn("row", padded)
    windows = F.transform(F.sequence(F.lit(1), F.size("row") - (Q - 1)), lambda i: F.array_join(F.slice("row", i, Q), ","))
    gram = F.explode(F.transform(windows, lambda w: F.concat_ws(",", F.coalesce(F.col("stem0"), F.lit("*")), F.col("tag0"), w)))
    return rows.select("page", gram.alias("gram")).groupBy("page", "gram").agg(F.count("*").alias("n"))
