"""Template stores as tables: scans, versions, rings, probes of stored signatures, bundles.

A store is append-only: registering a template, bumping its version or observing it adds a
row, and what an index would update in place is a query over the rows.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import equal_share
from .fingerprint import aging

RING, HISTORY, FORMAT = 100, 3, 4


def latest_rows(templates: DataFrame) -> DataFrame:
    """Each template's row of its store's newest file; repeated rows count once."""
    order = F.struct("file_seq", "version_number", "last_seen", F.xxhash64("extractor_blob"))
    return templates.where("template_id IS NOT NULL").groupBy("store_id", "template_id").agg(F.max_by(F.struct(*[c for c in templates.columns if c not in ("store_id", "template_id")]), order).alias("t")).select("store_id", "template_id", "t.*")


def scan_host(templates: DataFrame, host_hash: bytes, limit: int | None = None) -> DataFrame:
    """A host's templates, newest first; the filter reaches the files."""
    out = templates.where(F.col("host_hash") == F.lit(host_hash)).orderBy(F.desc("created_at"), "template_id")
    return out.limit(limit) if limit else out


def ring(observations: DataFrame, size: int = RING) -> DataFrame:
    """The newest observations of every template. Rows per template are cut to the limit before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("template_id").orderBy(F.desc("observed_at"), F.desc("loaded_at"), F.desc_nulls_last("similarity_at_match")))
    return observations.dropDuplicates().withColumn("place", rank).where(F.col("place") <= size)


def drift_average(observations: DataFrame, alpha: float = 0.2) -> DataFrame:
    """``template_id, n, ewma``: the exponentially weighted drift (1 - similarity) of every template, the oldest observation starting it.

    Observations without similarity are left out.  Weights fall by 1 - alpha a step, so that
    what lies further back than double precision reaches (some 200 steps at 0.2) adds nothing
    to the sum: only the newest so many rows of a template are put in order, in windows that
    are cut to them before the shuffle; ``n`` counts all.
    """
    seen = observations.where("similarity_at_match IS NOT NULL").select("template_id", "observed_at", "loaded_at", "similarity_at_match").distinct()
    counts = seen.groupBy("template_id").agg(F.count("*").alias("n"))
    reach = math.ceil(-53 * math.log(2) / math.log(1 - alpha)) + 8
    rank = F.row_number().over(Window.partitionBy("template_id").orderBy(F.desc("observed_at"), F.desc("loaded_at"), F.desc("similarity_at_match")))
    newest = seen.withColumn("k", rank - 1).where(F.col("k") < reach)
    weight = F.pow(F.lit(1 - alpha), F.col("k")) * F.when(F.col("k") == F.col("n") - 1, 1.0).otherwise(alpha)
    return newest.join(counts, "template_id").groupBy("template_id").agg(F.max("n").alias("n"), F.sum(weight * (1 - F.col("similarity_at_match"))).alias("ewma"))


def longest_drift(observations: DataFrame, below: float) -> DataFrame:
    """``template_id, longest``: the longest run of successive observations less alike than ``below``.

    Each template's day is summarised on its own (length, run at the start, at the end, longest),
    and only the days are put in order per template: a template with a third of all rows is
    spread over its days.
    """
    seen = observations.where("similarity_at_match IS NOT NULL").select("template_id", "observed_at", "loaded_at", "similarity_at_match").distinct()
    day = seen.withColumn("day", F.to_date("observed_at")).withColumn("hit", F.col("similarity_at_match") < below)
    order = Window.partitionBy("template_id", "day").orderBy("observed_at", "loaded_at", "similarity_at_match")
    runs = day.withColumn("i", F.row_number().over(order)).withColumn("breaks", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(order))
    per = runs.groupBy("template_id", "day", "breaks").agg(F.sum(F.col("hit").cast("int")).alias("run"), F.count("*").alias("rows"))
    days = per.groupBy("template_id", "day").agg(
        F.sum("rows").alias("n"), F.max("run").alias("best"), F.max(F.when(F.col("breaks") == 0, F.col("run")).otherwise(0)).alias("head"), F.max_by("run", "breaks").alias("tail")
    )
    start = F.struct(F.lit(0).cast("long").alias("best"), F.lit(0).cast("long").alias("open"))
    step = lambda s, d: F.struct(
        F.greatest(s["best"], d["best"], s["open"] + d["head"]).alias("best"), F.when(d["head"] == d["n"], s["open"] + d["n"]).otherwise(d["tail"]).alias("open")
    )
    listed = days.groupBy("template_id").agg(F.sort_array(F.collect_list(F.struct("day", "n", "best", "head", "tail"))).alias("days"))
    return listed.select("template_id", F.aggregate("days", start, step)["best"].alias("longest"))


def fence_versions(fences: DataFrame) -> DataFrame:
    """``host, versions, latest``: every host's version numbers and the template of the highest (latest created, then largest id)."""
    rows = fences.where("host IS NOT NULL").select(F.lower("host").alias("host"), "version", "template_id", "created_at").distinct()
    return rows.groupBy("host").agg(F.sort_array(F.collect_set("version")).alias("versions"), F.max_by("template_id", F.struct("version", "created_at", "template_id")).alias("latest"))


def fence_at(fences: DataFrame, version: Column | int) -> DataFrame:
    """``host, template_id`` at one version."""
    rows = fences.where((F.col("version") == version) & F.col("host").isNotNull())
    return rows.groupBy(F.lower("host").alias("host")).agg(F.max_by("template_id", F.struct("created_at", "template_id")).alias("template_id"))


def history(templates: DataFrame, depth: int = HISTORY) -> DataFrame:
    """``store_id, file_seq, place``: the last files of every store."""
    files = templates.select("store_id", "file_seq").distinct()
    return files.withColumn("place", F.row_number().over(Window.partitionBy("store_id").orderBy(F.desc("file_seq")))).where(F.col("place") <= depth)


def file_changes(templates: DataFrame) -> DataFrame:
    """``store_id, file_seq, template_id, change``: templates that appear in or vanish from a file against the one before."""
    ids = templates.where("template_id IS NOT NULL").select("store_id", "file_seq", "template_id").distinct()
    files = ids.select("store_id", "file_seq").distinct()
    later = ids.select("store_id", (F.col("file_seq") + 1).alias("file_seq"), "template_id").join(files, ["store_id", "file_seq"])
    first = files.select("store_id", (F.col("file_seq") + 1).alias("file_seq")).join(files, ["store_id", "file_seq"])
    added = ids.join(first, ["store_id", "file_seq"]).join(later, ["store_id", "file_seq", "template_id"], "left_anti").withColumn("change", F.lit("added"))
    removed = later.join(ids, ["store_id", "file_seq", "template_id"], "left_anti").withColumn("change", F.lit("removed"))
    return added.select("store_id", "file_seq", "template_id", "change").unionByName(removed.select("store_id", "file_seq", "template_id", "change"))


def best_template(templates: DataFrame, as_of: Column) -> DataFrame:
    """``host_hash, template_id, score``: every host's template with the best aging score at likeness 1."""
    age = (F.unix_micros(as_of) - F.unix_micros("last_seen")) / 86_400_000_000.0
    rows = latest_rows(templates).where("last_seen IS NOT NULL AND host_hash IS NOT NULL")
    scored = rows.select(F.hex("host_hash").alias("host_hash"), "template_id", aging(F.lit(1.0), F.col("observation_count"), age).alias("score"))
    return scored.groupBy("host_hash").agg(F.min_by(F.struct("template_id", "score"), F.struct(-F.round("score", 9), F.col("template_id"))).alias("b")).select("host_hash", "b.*")


def true_likeness(observations: DataFrame, templates: DataFrame) -> DataFrame:
    """``template_id, observed_at, logged, likeness``: what was logged for a match, and the signatures' real likeness.

    One row per observation and template signature; observations or templates without 512 signature bytes are left out.
    """
    own = templates.where(F.length("signature_minhash") == 512).select("template_id", F.col("signature_minhash").alias("own")).distinct()
    seen = observations.where(F.length("signature_minhash") == 512).select("template_id", "observed_at", "signature_minhash", F.col("similarity_at_match").alias("logged")).distinct()
    return seen.join(own, "template_id").select("template_id", "observed_at", "logged", equal_share(F.col("own"), F.col("signature_minhash")).alias("likeness"))


# ----------------------------------------------------------------------------------- bundles


def export_bundle(templates: DataFrame) -> DataFrame:
    """One JSON line per template: schema version 1, signatures in base64, pq-gram parameters; the host key is never part of it."""
    t = latest_rows(templates)
    plain = lambda c: F.regexp_replace(F.base64(c), r"[\r\n]", "")
    return t.select(
        F.to_json(
            F.struct(
                F.lit(1).alias("schemaVersion"), F.lit("hmac-sha256").alias("hashAlgorithm"), F.lit(2).alias("pqGramP"), F.lit(3).alias("pqGramQ"), F.lit(256).alias("pqGramTopK"), "store_id", "template_id",
                F.hex("host_hash").alias("hostHash"), F.col("version_number").alias("version"), plain("signature_minhash").alias("signature"), plain("pq_gram_vector").alias("pqGramVector"),
                plain("extractor_blob").alias("extractor"), F.col("observation_count").alias("observationCount"), F.unix_micros("created_at").alias("createdAt"), F.unix_micros("last_seen").alias("lastSeen"),
            )
        ).alias("value")
    )


BUNDLE = (
    "schemaVersion int, store_id string, template_id string, hostHash string, version int, signature string, pqGramVector string, extractor string, observationCount int, createdAt bigint, lastSeen bigint"
)


def import_bundle(lines: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Templates of exported lines, replacing existing ones of the same store and id; only schema version 1 is read.

    Of several lines of one template that with the highest version counts, then the one seen last.

    Bands are computed anew by whoever probes, from the signature, so they are never stale.
    """
    b = lines.select(F.from_json("value", BUNDLE).alias("b")).select("b.*").where("schemaVersion = 1 AND template_id IS NOT NULL")
    new = b.select(
        "store_id", "template_id", F.unhex("hostHash").alias("host_hash"), F.col("version").alias("version_number"), F.unbase64("signature").alias("signature_minhash"), F.unbase64("pqGramVector").alias("pq_gram_vector"),
        F.unbase64("extractor").alias("extractor_blob"), F.col("observationCount").alias("observation_count"), F.timestamp_micros("createdAt").alias("created_at"), F.timestamp_micros("lastSeen").alias("last_seen"),
    )
    order = F.struct("version_number", "last_seen", "observation_count", F.xxhash64("extractor_blob", "signature_minhash", "pq_gram_vector"))
    rest = F.struct(*[c for c in new.columns if c not in ("store_id", "template_id")])
    new = new.groupBy("store_id", "template_id").agg(F.max_by(rest, order).alias("t")).select("store_id", "template_id", "t.*")
    if existing is None:
        return new
    kept = existing.select(*new.columns).join(new.select("store_id", "template_id"), ["store_id", "template_id"], "left_anti")
    return kept.select(*new.columns).unionByName(new)


def import_report(lines: DataFrame, existing: DataFrame) -> DataFrame:
    """``store_id, imported, replaced, refused``: what an import would add and replace, and how many lines it cannot read."""
    b = lines.select(F.from_json("value", BUNDLE).alias("b"))
    readable = F.col("b.schemaVersion").eqNullSafe(F.lit(1)) & F.col("b.template_id").isNotNull()
    refused = b.where(~readable).select(F.col("b.store_id").alias("store_id"), F.lit("refused").alias("what"))
    old = existing.select("store_id", "template_id").distinct().withColumn("there", F.lit(True))
    new = import_bundle(lines).select("store_id", "template_id").join(old, ["store_id", "template_id"], "left")
    rows = new.select("store_id", F.when(F.col("there"), "replaced").otherwise("imported").alias("what")).unionByName(refused)
    return rows.groupBy("store_id").agg(*[F.count_if(F.col("what") == c).alias(c) for c in ("imported", "replaced", "refused")])


def bundle_json(lines: list[str]) -> str:
    """A small bundle as one JSON document, as the command line exchanges it."""
    return json.dumps([json.loads(x) for x in lines], sort_keys=True)


def read_base64(text: str) -> bytes:
    return base64.b64decode(text)


def upsert_candidates(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates that are not there yet, one per (host, role, target)."""
    return new.dropDuplicates(["host", "role", "target"]).join(existing, ["host", "role", "target"], "left_anti")


def cooled(jobs: DataFrame, key: list[str], at: str, wait: float = 3600.0, taken: str | None = None, keep: float = 1800.0) -> DataFrame:
    """The key and ``at`` of the jobs a queue takes: of a key's jobs none within ``wait`` seconds after the last one taken.

    With ``taken``, the time a job would be worked on, jobs that are older than ``keep`` seconds by
    then are dropped and start no cooldown.  Which job is taken depends on the one taken before,
    so a key's times are gone through in order; they are deduplicated before the shuffle and
    stream through their task, which holds the last one only.  Null times are left out.
    """
    rows = jobs.where(F.col(at).isNotNull())
    if taken is not None:
        rows = rows.where(F.unix_micros(F.col(taken).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")) <= F.lit(int(keep * 1e6)))
    named = F.struct(*key)
    times = rows.groupBy(*key, at).agg(F.first(F.lit(1))).select(F.to_json(named, {"ignoreNullFields": "false"}).alias("_key"), F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), *key, at)
    schema = times.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, until = None, 0
        step = int(wait * 1e6)
        for pdf in batches:
            keys, at_, keep_ = pdf["_key"].to_numpy(), pdf["_at"].to_numpy(), []
            i, n = 0, len(pdf)
            while i < n:
                if keys[i] != last:
                    last, until = keys[i], at_[i]
                if at_[i] >= until:
                    keep_.append(i)
                    until = at_[i] + step
                i += 1
            yield pdf.iloc[keep_]

    parts = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return times.repartition(parts, "_key").sortWithinPartitions("_key", "_at").mapInPandas(run, schema).drop("_key", "_at")


def registered(new: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows to append for new templates (``template_id, host, minhash, bands``) and for their bands (``host, band, hash, template_id``): those not in the store."""
    fresh = new.dropDuplicates(["template_id"]).join(store.select("template_id"), "template_id", "left_anti")
    return fresh, fresh.select("host", F.posexplode("bands").alias("band", "hash"), "template_id")


def usable_rows(rows: DataFrame, version: int = FORMAT, column: str = "format_version") -> DataFrame:
    """Rows of the format that is understood; rows of another or no format are left out, as if they had never been learned."""
    return rows.where(F.col(column) == version).drop(column) if column in rows.columns else rows.limit(0)


def stamped(rows: DataFrame, version: int = FORMAT, column: str = "format_version") -> DataFrame:
    """Rows as they are written: with the format they are in."""
    return rows.withColumn(column, F.lit(version))
