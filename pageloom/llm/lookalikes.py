"""Almost equal templates by chosen-path join (problem 5).

A template's evidence is a weighted set: the 128 (slot, value) tokens of its MinHash
signature, all of equal weight, or the keys of its pq-gram vector, each weighing its
squared share of the norm.  Two sets at the threshold share at least ``overlap`` of
their weight (109/128 for signatures; a cosine c leaves 1 - sqrt(1 - c^2) for vectors).

One run of the join walks both sets down the same random tree: at every node each set
chooses tokens whose hash, seeded by the path so far, lies under ``rate`` times the
token's weight, and goes to one child per chosen token; sets with common tokens choose
them together.  Nodes with few sets are brute-forced, larger ones are split further; what has not
fallen apart after DEEPEST levels is alike, and its pairs are made whole by a join.
Runs are repeated until a pair at the threshold is missed with a probability of at most
``1 - recall``.  Candidates are verified exactly.

Equal fingerprints are collapsed into one class before the join, so copies cost nothing
until the result lists them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut, stored
from ..functions.codecs import read_vector

SLOTS, EQUAL_SLOTS, COSINE = 128, 109, 0.90
RECALL, SHARED, SMALL, START, DEEPEST, BITS = 0.999, 1.6, 128, 2, 6, 22


def slots_of(blob: bytes | None) -> np.ndarray | None:
    """The slots of a signature, or None where it is no evidence."""
    if blob is None or len(blob) != 4 * SLOTS:
        return None
    slots = np.frombuffer(blob, dtype="<u4")
    return None if (slots == slots[0]).all() else slots


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature_set(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    slots = np.frombuffer(blob, dtype="<u4").astype(np.uint64)
    return _mix(slots | (np.arange(SLOTS, dtype=np.uint64) << np.uint64(32))), np.full(SLOTS, 1.0 / SLOTS)


def vector_set(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    vector = read_vector(blob)
    keys = pd.util.hash_array(np.array(list(vector), dtype=object)) if vector else np.zeros(0, np.uint64)
    squares = np.array(list(vector.values())) ** 2
    return keys, squares / max(squares.sum(), 1e-300)


def runs_for(recall: float = RECALL, shared: float = SHARED, depth: int = START) -> int:
    """Runs after which a pair at the threshold is missed with probability 1 - recall at most, at the usual depth."""
    hit = (1 - math.exp(-shared)) ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def _padded(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    width = max((len(t) for t, _ in sets), default=0)
    tokens, weights = np.zeros((len(sets), width), np.uint64), np.zeros((len(sets), width))
    for i, (t, w) in enumerate(sets):
        tokens[i, : len(t)], weights[i, : len(w)] = t, w
    return tokens, weights


def _descend(tokens: np.ndarray, weights: np.ndarray, owner: np.ndarray, path: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """One level: (owner, path) of all children of the given nodes."""
    owners, paths = [], []
    for lo in range(0, len(owner), 4096):
        o, p = owner[lo : lo + 4096], path[lo : lo + 4096]
        mixed = _mix(tokens[o] ^ p[:, None])
        chosen = (mixed >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate * weights[o]
        at, which = np.nonzero(chosen)
        owners.append(o[at])
        paths.append(_mix(mixed[at, which] + np.uint64(0x9E3779B97F4A7C15)))
    return (np.concatenate(owners), np.concatenate(paths)) if owners else (owner[:0], path[:0])


def _in_set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values.astype(np.uint64) >> np.uint64(64 - BITS)
    return ((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def bit_set(slots: DataFrame, bits: int = BITS) -> np.ndarray:
    """The numbers below 2 ** bits of a one-column table as a bit set of fixed size.

    The bits are put together in the JVM, 64 a row, so that at most 2 ** (bits - 6) rows come to
    the driver, whatever the data.
    """
    slot = F.col(slots.columns[0])
    words = slots.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slots.columns[0]} & 63 AS int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out.view(np.uint8)


def _plant(decode: Callable, rate: float, runs: int, depth: int, crowded: list[np.ndarray]):
    """(id, data) -> (path, id) at ``depth`` of all runs, without a shuffle.

    ``crowded`` has, for every depth from START on that is not the last, the bit set of the
    nodes there that were too large; only their children are walked on.
    """
    seeds = _mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                tokens, weights = _padded([decode(x) for x in part["data"]])
                owner = np.repeat(np.arange(len(part)), runs)
                path = np.tile(seeds, len(part))
                for level in range(1, depth + 1):
                    owner, path = _descend(tokens, weights, owner, path, rate)
                    if START <= level < depth:
                        keep = _in_set(crowded[level - START], path)
                        owner, path = owner[keep], path[keep]
                yield pd.DataFrame({"path": path.view(np.int64), "id": part["id"].to_numpy()[owner]})

    return run


def chosen_path_candidates(sets: DataFrame, decode: Callable, overlap: float, recall: float = RECALL) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b, each pair once): pairs that met in a small node of some run.

    ``sets`` has ``id bigint, data binary``, each id once, and should be a written table, as
    every level reads it anew; ``decode`` makes tokens and weights of data.  Rows of a node are
    counted with partial aggregation and only then joined, so a node with many sets is never
    gathered; it is walked one level deeper, from the table, until it falls apart.
    """
    rate, runs = SHARED / overlap, runs_for(recall)
    pairs: DataFrame | None = None
    crowded: list[np.ndarray] = []
    for depth in range(START, DEEPEST + 1):
        rows = sets.mapInPandas(_plant(decode, rate, runs, depth, crowded), "path bigint, id bigint")
        sizes = rows.groupBy("path").count().where("count > 1")
        small = rows.join(sizes.where(F.col("count") <= SMALL), "path").groupBy("path").agg(F.sort_array(F.collect_set("id")).alias("ids"))
        met = small.select(F.explode(F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> named_struct('id_a', x, 'id_b', y))))")).alias("p")).select("p.id_a", "p.id_b").distinct()
        large = sizes.where(F.col("count") > SMALL).select(F.lit(None).cast("bigint").alias("id_a"), F.shiftrightunsigned("path", 64 - BITS).alias("id_b")).distinct()
        both = cut(met.unionByName(large))
        found = both.where("id_a IS NOT NULL")
        pairs = found if pairs is None else pairs.unionByName(found)
        slots = both.where("id_a IS NULL").select("id_b")
        if slots.isEmpty():
            break
        if depth == DEEPEST:  # sets that no token tells apart: the pairs themselves are the result
            again = rows.join(sizes.where(F.col("count") > SMALL).select("path"), "path")
            a, b = again.withColumnRenamed("id", "id_a"), again.withColumnRenamed("id", "id_b")
            pairs = pairs.unionByName(a.join(b, "path").where("id_a < id_b").select("id_a", "id_b"))
            break
        crowded.append(bit_set(slots))
    return pairs.distinct()


def equal_slots(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of equal slots of two columns of signatures, all at once."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), "<u4").reshape(-1, SLOTS) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def cosines(a: pd.Series, b: pd.Series) -> pd.Series:
    """The cosine of two columns of vectors; a vector that occurs in many pairs of a batch is read once."""
    known: dict[bytes, tuple[dict[str, float], float]] = {}

    def read(blob: bytes) -> tuple[dict[str, float], float]:
        if blob not in known:
            vector = read_vector(blob)
            known[blob] = vector, math.sqrt(sum(v * v for v in vector.values()))
        return known[blob]

    out = []
    for x, y in zip(a, b):
        (p, n), (q, m) = read(x), read(y)
        if len(p) > len(q):
            p, q = q, p
        out.append(sum(v * q[k] for k, v in p.items() if k in q) / (n * m) if n and m else 0.0)
    return pd.Series(out, dtype="float64")


def _evidence(signature: pd.Series) -> pd.Series:
    return signature.map(lambda s: slots_of(s) is not None)


def _counts(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: bool(read_vector(v)))


def fingerprints(templates: DataFrame) -> DataFrame:
    """``template_id, signature``: one row per template; where one file's is null, another's is taken."""
    return templates.where(F.col("template_id").isNotNull()).groupBy("template_id").agg(F.max("signature_minhash").alias("signature"))


def _classes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id, template_id``: which templates have which data; ``id, data``: every different data once), both written."""
    named = members.withColumn("id", F.xxhash64("data"))
    return cut(named.select("id", "template_id").distinct()), stored(named.groupBy("id").agg(F.first("data").alias("data")))


def _near(sets: DataFrame, decode: Callable, overlap: float, measure: Callable, threshold: float) -> DataFrame:
    """``id_a, id_b`` of all different data that reach the threshold."""
    close = F.pandas_udf(measure, "double")
    met = cut(chosen_path_candidates(sets, decode, overlap))
    # Only sets that are in some pair go into the verification join.
    ids = met.select(F.explode(F.array("id_a", "id_b")).alias("id")).select(F.shiftrightunsigned("id", 64 - BITS).alias("slot"))
    bits = bit_set(ids)
    wanted = F.pandas_udf(lambda s: pd.Series(_in_set(bits, s.to_numpy().view(np.uint64))), "boolean")
    some = sets.where(wanted("id"))
    a, b = some.select(F.col("id").alias("id_a"), F.col("data").alias("data_a")), some.select(F.col("id").alias("id_b"), F.col("data").alias("data_b"))
    return met.join(a, "id_a").join(b, "id_b").where(close("data_a", "data_b") >= threshold - 1e-12).select("id_a", "id_b")


def _both_ways(near: DataFrame) -> DataFrame:
    """``id_a, id_b`` of links in both directions."""
    turn = F.explode(F.array(F.struct("id_a", "id_b"), F.struct(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))))
    return near.select(turn.alias("e")).select("e.id_a", "e.id_b")


def _evidences(templates: DataFrame) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """(owners, sets, near) of both kinds of evidence, signatures and vectors."""
    evidence, counts = F.pandas_udf(_evidence, "boolean"), F.pandas_udf(_counts, "boolean")
    rows = templates.where(F.col("template_id").isNotNull())
    by_slot = rows.where(F.length("signature_minhash") == 4 * SLOTS).select("template_id", F.col("signature_minhash").alias("data")).where(evidence("data"))
    by_gram = rows.where(F.length("pq_gram_vector") > 4).select("template_id", F.col("pq_gram_vector").alias("data")).where(counts("data"))
    out = []
    for members, decode, overlap, measure, threshold in (
        (by_slot, signature_set, EQUAL_SLOTS / SLOTS, equal_slots, EQUAL_SLOTS / SLOTS), (by_gram, vector_set, 1 - math.sqrt(1 - COSINE**2), cosines, COSINE),
    ):
        owners, sets = _classes(members)
        out.append((owners, sets, _near(sets, decode, overlap, measure, threshold)))
    return out


def lookalike_pairs(templates: DataFrame) -> DataFrame:
    """``template_id_a, template_id_b``, the smaller first: each pair of almost equal templates once.

    Signatures that are null, cut short or the same in all slots and empty or broken vectors
    give no pairs; rows with a null template_id are ignored; a template never pairs with itself.
    """
    pairs = []
    for owners, _, near in _evidences(templates):
        left, right = owners.select(F.col("id").alias("id_a"), F.col("template_id").alias("x")), owners.select(F.col("id").alias("id_b"), F.col("template_id").alias("y"))
        copies = owners.join(owners.groupBy("id").count().where("count > 1").select("id"), "id")
        within = copies.select("id", F.col("template_id").alias("x")).join(copies.select("id", F.col("template_id").alias("y")), "id").select("x", "y")
        pairs.append(near.join(left, "id_a").join(right, "id_b").select("x", "y").unionByName(within).where("x <> y"))
    both = pairs[0].unionByName(pairs[1])
    return both.select(F.least("x", "y").alias("template_id_a"), F.greatest("x", "y").alias("template_id_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the connected components of ``a, b`` links, named by their smallest node.

    Labels shrink along links until they stand still; each round is written to the
    checkpoint folder, and a jump to the label's own label halves long chains.
    """
    turn = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges = cut(edges.where("a <> b").select(turn.alias("e")).select("e.a", "e.b").distinct())
    labels = cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        heard = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        jumped = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = labels.join(heard, F.col("node") == F.col("a")).join(jumped, "label", "left")
        low = F.least("label", "other", "beyond")
        new = cut(new.select("node", low.alias("label"), (low != F.col("label")).alias("moved")))
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels


def lookalike_groups(templates: DataFrame) -> DataFrame:
    """``template_id, group_id, links``: the groups of templates that are linked directly or through others, and how many each is linked to.

    Only templates with a link are listed; ``group_id`` is the smallest member.  Templates hang
    on the classes of their equal fingerprints, and links are between classes: a layout with a
    million copies has a million links to its class, not their square.  ``links`` counts the
    other templates of the own classes and of all linked ones, by each evidence.
    """
    members, edges, counts = [], [], []
    for kind, (owners, _, near) in zip("sg", _evidences(templates)):
        near = cut(near)
        sizes = cut(owners.groupBy("id").agg(F.count("*").alias("n")))
        both = _both_ways(near)
        beside = both.join(sizes.withColumnRenamed("id", "id_b"), "id_b").groupBy(F.col("id_a").alias("id")).agg(F.sum("n").alias("more"))
        name = lambda c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
        linked = owners.join(sizes, "id").join(beside, "id", "left").select("template_id", name("id").alias("class"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links")).where("links > 0")
        members.append(linked)
        edges += [near.select(name("id_a").alias("a"), name("id_b").alias("b")), linked.select(F.concat(F.lit("t:"), "template_id").alias("a"), F.col("class").alias("b"))]
    everyone = members[0].unionByName(members[1])
    graph = edges[0]
    for e in edges[1:]:
        graph = graph.unionByName(e)
    labels = components(graph).where("node LIKE 't:%'").select(F.substring("node", 3, 1_000_000).alias("template_id"), "label")
    first = labels.groupBy("label").agg(F.min("template_id").alias("group_id"))
    return labels.join(first, "label").join(everyone.groupBy("template_id").agg(F.sum("links").alias("links")), "template_id").select("template_id", "group_id", "links")


def wandering_observations(observations: DataFrame, templates: DataFrame) -> DataFrame:
    """Observations whose page is closer to a look-alike of the template they were logged for.

    ``template_id, observed_at, nearest_id, own_slots, nearest_slots``: the signature of each
    observation is compared with its own template's and with the different signatures of its
    look-alikes, each once, under the smallest template that has it.  The rivals of a template
    travel to its observations as one row of one signature each, spread by a salt, so that a
    template with a tenth of all observations takes no task for itself.  Observations without
    evidence or of unknown templates are left out; repeated rows count once.
    """
    evidence = F.pandas_udf(_evidence, "boolean")
    prints = stored(fingerprints(templates).where(F.length("signature") == 4 * SLOTS).where(evidence("signature")).select("template_id", "signature"))
    named = prints.withColumn("id", F.xxhash64("signature"))
    classes = stored(named.groupBy("id").agg(F.first("signature").alias("signature"), F.min("template_id").alias("first")))
    links = []
    for owners, _, near in _evidences(templates):
        both = _both_ways(near).unionByName(owners.select(F.col("id").alias("id_a"), F.col("id").alias("id_b")).distinct())
        # From a template by its evidence to classes of evidence, and from their templates to classes of signatures.
        target = owners.join(named.select("template_id", F.col("id").alias("klass")), "template_id").select(F.col("id").alias("id_b"), "klass").distinct()
        links.append(owners.withColumnRenamed("id", "id_a").join(both, "id_a").join(target, "id_b").select("template_id", "klass"))
    rivals = links[0].unionByName(links[1]).distinct().join(named.select("template_id", F.col("id").alias("own")), "template_id").where("klass <> own").select("template_id", "klass")
    rivals = rivals.join(classes.select(F.col("id").alias("klass"), F.col("signature").alias("near"), "first"), "klass")
    gathered = prints.join(rivals.groupBy("template_id").agg(F.sort_array(F.collect_list(F.struct("first", "near"))).alias("rivals")), "template_id")
    salts = max(2, observations.sparkSession.sparkContext.defaultParallelism)
    spread = gathered.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    seen = observations.where(F.length("signature_minhash") == 4 * SLOTS).where(evidence("signature_minhash")).select("template_id", "observed_at", "signature_minhash").distinct()
    met = seen.withColumn("salt", F.pmod(F.xxhash64("observed_at", "signature_minhash"), F.lit(salts))).join(spread, ["template_id", "salt"])

    def nearest(seen_: pd.Series, own: pd.Series, near: pd.Series) -> pd.DataFrame:
        rows = []
        for s, o, others in zip(seen_, own, near):
            s = np.frombuffer(s, "<u4")
            scores = (np.frombuffer(b"".join(x["near"] for x in others), "<u4").reshape(-1, SLOTS) == s).sum(axis=1)
            at = int(scores.argmax())  # rivals are in the order of their names, so ties go to the first
            rows.append((int((np.frombuffer(o, "<u4") == s).sum()), others[at]["first"], int(scores[at])))
        return pd.DataFrame(rows, columns=["own", "id", "slots"])

    found = F.pandas_udf(nearest, "struct<own:int,id:string,slots:int>")
    scored = met.select("template_id", "observed_at", found("signature_minhash", "signature", "rivals").alias("n")).where("n.slots > n.own")
    return scored.select("template_id", "observed_at", F.col("n.id").alias("nearest_id"), F.col("n.own").alias("own_slots"), F.col("n.slots").alias("nearest_slots"))
