"""Mining selectors across hosts from rule observations.

``observations``: ``obs_id, host, bucket, role, claims, target, cardinality, confidence,
induced_at``; claims is an array of structs, root first.  A cluster is (bucket, role).
Counting is relational: positions are counted from the leaf, features exploded and counted
with partial aggregation, and only what reaches the majority comes back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import stored
from .rules import selector_distance

LEAST, PRESENCE, NEWEST, OUTLIER = 3, 0.7, 1000, 5.0
CLAIM = "struct<tag:string,id:string,classes:array<string>,data:map<string,string>,aria:map<string,string>,role:string>"
CLUSTER = ["bucket", "role"]


def rule_observations(results: DataFrame) -> DataFrame:
    """Observations from induced rules (``page, host, bucket, role, claims, confidence, selectors, induced_at``).

    The target is a hash of the leaf's tag and id, the cardinality the number of selectors, 1 at least.
    """
    leaf = F.element_at("claims", -1)
    return results.where(F.size("claims") > 0).select(
        F.sha2(F.concat_ws("|", "page", "role", F.to_json("claims")), 256).alias("obs_id"), "host", F.col("bucket").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("bucket"), "role", "claims",
        F.xxhash64(leaf["tag"], F.coalesce(leaf["id"], F.lit(""))).alias("target"), F.greatest(F.lit(1), F.size("selectors")).alias("cardinality"), "confidence", "induced_at",
    )


def newest(observations: DataFrame, limit: int = NEWEST) -> DataFrame:
    """The newest observations of each cluster; the window's partitions are pre-limited by WindowGroupLimit before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*CLUSTER).orderBy(F.desc("induced_at"), "obs_id"))
    return observations.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def clusters(observations: DataFrame) -> DataFrame:
    """``bucket, role, n, hosts``."""
    return observations.groupBy(*CLUSTER).agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"))


def cluster_hosts(observations: DataFrame) -> DataFrame:
    """``bucket, role, host, n``: the hosts that contribute to a cluster."""
    return observations.groupBy(*CLUSTER, "host").agg(F.count("*").alias("n"))


def _positions(observations: DataFrame) -> DataFrame:
    return observations.select(*CLUSTER, "obs_id", F.posexplode(F.reverse("claims")).alias("pos", "c"))


def claim_frequency(observations: DataFrame) -> DataFrame:
    """``bucket, role, pos, feature, name, value, n``: how often each feature occurs at each position from the leaf."""
    c, none = F.col("c"), F.lit("")
    single = lambda feature: F.when(c[feature].isNotNull(), F.array(F.struct(F.lit(feature).alias("feature"), none.alias("name"), c[feature].alias("value"))))
    classes = F.transform(F.array_distinct(c["classes"]), lambda x: F.struct(F.lit("class").alias("feature"), none.alias("name"), x.alias("value")))
    pairs = lambda feature: F.transform(F.map_entries(c[feature]), lambda e: F.struct(F.lit(feature).alias("feature"), e["key"].alias("name"), e["value"].alias("value")))
    # All features of a position at once: the observations, however they were made, are read a single time.
    features = F.flatten(F.array_compact(F.array(single("tag"), single("id"), single("role"), classes, pairs("data"), pairs("aria"))))
    return _positions(observations).select(*CLUSTER, "pos", F.explode(features).alias("f")).groupBy(*CLUSTER, "pos", "f.feature", "f.name", "f.value").agg(F.count("*").alias("n"))


def stable_chains(observations: DataFrame, presence: float = PRESENCE, least: int = LEAST) -> DataFrame:
    """``bucket, role, n, claims``: what at least ``presence`` of a cluster's chains share, position by position from the leaf.

    Clusters of fewer than ``least`` observations give none.  A position without a majority tag ends the chain
    (chains with an empty claim could match nothing), and so does a leaf without one end the cluster.
    """
    observations = stored(observations.select(*CLUSTER, "obs_id", "claims"))
    sizes = observations.groupBy(*CLUSTER).agg(F.count("*").alias("total")).where(F.col("total") >= least)
    need = F.ceil(F.col("total") * F.lit(presence) - F.lit(1e-9))
    kept = claim_frequency(observations).join(sizes, CLUSTER).where(F.col("n") >= need)
    single = lambda f: F.max_by(F.when(F.col("feature") == f, F.col("value")), F.when(F.col("feature") == f, F.struct("n", "value")))
    many = lambda f: F.sort_array(F.collect_set(F.when(F.col("feature") == f, F.col("value"))))
    pairs = lambda f: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("feature") == f, F.struct("name", "value")))))
    claim = F.struct(single("tag").alias("tag"), single("id").alias("id"), many("class").alias("classes"), pairs("data").alias("data"), pairs("aria").alias("aria"), single("role").alias("role"))
    by_pos = kept.groupBy(*CLUSTER, "total", "pos").agg(claim.alias("claim")).where("claim.tag IS NOT NULL")
    chain = by_pos.groupBy(*CLUSTER, "total").agg(F.array_sort(F.collect_list(F.struct("pos", "claim")), lambda x, y: x["pos"] - y["pos"]).alias("list"))
    run = F.filter("list", lambda x, i: x["pos"] == i)
    return chain.select(*CLUSTER, F.col("total").alias("n"), F.reverse(F.transform(run, lambda x: x["claim"])).alias("claims")).where(F.size("claims") > 0)


def distances(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([selector_distance(_plain(a), _plain(b)) for a, b in zip(left, right)], dtype="float64")


def _plain(chain) -> list[dict]:
    out = []
    for c in [] if chain is None else chain:
        c = c.asDict() if hasattr(c, "asDict") else dict(c)
        for part in ("data", "aria"):
            c[part] = dict(c[part]) if c.get(part) is not None else {}
        c["classes"] = list(c["classes"]) if c.get("classes") is not None else []
        out.append(c)
    return out


def _chains(observations: DataFrame) -> DataFrame:
    """Equal chains of a cluster as one row with a count: distances are between different chains only."""
    key = F.to_json("claims")
    return observations.groupBy(*CLUSTER, key.alias("chain")).agg(F.count("*").alias("copies"), F.min_by(F.struct("obs_id", "claims"), "obs_id").alias("first")).select(*CLUSTER, "chain", "copies", F.col("first.obs_id").alias("obs_id"), F.col("first.claims").alias("claims"))


def medoids(observations: DataFrame, least: int = LEAST) -> DataFrame:
    """``bucket, role, obs_id, claims, total_distance``: the chain nearest to all others of its cluster.

    A cluster enters with its newest NEWEST observations, as its operator defines; ties go to the
    smallest obs_id.
    """
    observations = stored(observations)
    sized = newest(observations).join(observations.groupBy(*CLUSTER).agg(F.count("*").alias("n")).where(F.col("n") >= least), CLUSTER)
    rows = _chains(sized)
    far = F.pandas_udf(distances, "double")
    a, b = rows.alias("a"), rows.select(*CLUSTER, F.col("chain").alias("chain_b"), F.col("copies").alias("copies_b"), F.col("claims").alias("claims_b"))
    sums = a.join(b, CLUSTER).withColumn("d", far("claims", "claims_b") * F.col("copies_b")).groupBy(*CLUSTER, "chain").agg(F.sum("d").alias("total_distance"), F.min("obs_id").alias("obs_id"), F.first("claims").alias("claims"))
    return sums.groupBy(*CLUSTER).agg(F.min_by(F.struct("obs_id", "claims", "total_distance"), F.struct(F.round("total_distance", 9), "obs_id")).alias("m")).select(*CLUSTER, "m.*")


def outliers(observations: DataFrame, limit: float = OUTLIER) -> DataFrame:
    """``bucket, role, obs_id, distance``: observations far from their cluster's medoid."""
    far = F.pandas_udf(distances, "double")
    observations = stored(observations)
    center = medoids(observations).select(*CLUSTER, F.col("claims").alias("medoid"))
    return newest(observations).join(center, CLUSTER).withColumn("distance", far("claims", "medoid")).where(F.col("distance") > limit).select(*CLUSTER, "obs_id", "distance")


def candidates(observations: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``candidate_id, host, bucket, role, claims, target, source_count``: one per stable chain and contributing host.

    Those already in ``existing`` (host, role, target) are left out.
    """
    recent = stored(newest(observations).select(*CLUSTER, "obs_id", "host", "claims"))
    leaf = F.element_at("claims", -1)
    chains = stable_chains(recent).withColumn("target", F.xxhash64(leaf["tag"], F.coalesce(leaf["id"], F.lit(""))))
    out = chains.join(cluster_hosts(recent).drop("n"), CLUSTER).select("host", "bucket", "role", "claims", "target", F.col("n").alias("source_count"))
    out = out.groupBy("host", "role", "target").agg(F.max_by(F.struct("bucket", "claims", "source_count"), F.struct(F.col("source_count"), -F.col("bucket"))).alias("c")).select("host", "c.bucket", "role", "c.claims", "target", "c.source_count")
    if existing is not None:
        out = out.join(existing.select("host", "role", "target").distinct(), ["host", "role", "target"], "left_anti")
    return out.withColumn("candidate_id", F.substring(F.sha2(F.concat_ws("|", "host", "role", F.col("target").cast("string")), 256), 1, 32))


def totals(observations: DataFrame, found: DataFrame) -> DataFrame:
    """``clusters, mined, hosts, candidates``: what one mining pass looked at and what it gave."""
    parts = stored(cluster_hosts(observations))  # the observations are read once, for clusters and hosts
    sizes = parts.groupBy(*CLUSTER).agg(F.sum("n").alias("n")).agg(F.count("*").alias("clusters"), F.sum(F.when(F.col("n") >= LEAST, 1).otherwise(0)).alias("mined"))
    hosts = parts.agg(F.countDistinct("host").alias("hosts"))
    return sizes.crossJoin(hosts).crossJoin(found.agg(F.count("*").alias("candidates")))  # one row each


def scan_candidates(candidates: DataFrame, host: str, role: str | None = None, limit: int | None = None) -> DataFrame:
    """A host's candidates, the newest (``created_at``) first, of one role where it is given; the filter reaches the files."""
    out = candidates.where(F.col("host") == host.lower())
    out = (out.where(F.col("role") == role) if role else out).orderBy(F.desc("created_at"), "candidate_id")
    return out.limit(limit) if limit else out


def evaluated(candidates: DataFrame, pages: DataFrame, key: str, host: str, html: str, at: str, least: int = 200) -> DataFrame:
    """``candidate_id, page, won, at``: the outcome log of trying every candidate on every page of its host.

    A candidate wins where its chain finds an element of the page with at least ``least``
    characters that are not mostly links.  A host's candidates travel to its pages as one row.
    """
    from collections.abc import Iterator

    from ..html.shred import Dom
    from .rules import match_chain

    listed = candidates.groupBy("host").agg(F.collect_list(F.struct("candidate_id", "claims")).alias("tries"))
    source = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("page"), F.lower(F.coalesce(F.col(host), F.lit(""))).alias("host"), F.col(at).alias("at"), F.col(html).alias("source"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, when, html_, tries in zip(pdf["page"], pdf["at"], pdf["source"], pdf["tries"]):
                dom = Dom.of(html_)
                for t in tries:
                    found = match_chain(dom, _plain(t["claims"]))
                    rows.append((t["candidate_id"], page, any(dom.trimmed(i) >= least and dom.density(i) < 0.5 for i in found), when))
            yield pd.DataFrame(rows, columns=["candidate_id", "page", "won", "at"])

    return source.join(listed, "host").mapInPandas(run, "candidate_id string, page string, won boolean, at timestamp")


def reputation(outcomes: DataFrame) -> DataFrame:
    """``candidate_id, reputation, last_won_at, last_lost_at`` from an outcome log (candidate_id, won, at)."""
    return outcomes.groupBy("candidate_id").agg(
        F.sum(F.when(F.col("won"), 1).otherwise(-1)).alias("reputation"), F.max(F.when(F.col("won"), F.col("at"))).alias("last_won_at"), F.max(F.when(~F.col("won"), F.col("at"))).alias("last_lost_at")
    )
