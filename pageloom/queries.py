"""The queries of the core: name -> (spark, directory) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rendered_queries
from .checkpoints import stored
from .functions import stability, web
from .model import STRUCTURAL_TAGS
from .operators import evaluate, extract, features, fingerprint, learn, mining, skeleton, stores
from .plans import schema_drift
from .sources import pages as page_sources
from .sources.tables import read, spread
from .streaming import jobs

AS_OF = "2026-01-01 00:00:00"


def _read(spark: SparkSession, where: str, table: str) -> DataFrame:
    return read(spark, where, table)


def _pages(spark: SparkSession, where: str) -> DataFrame:
    """The labelled pages, each once: a page delivered again differs only in when it was loaded."""
    return _read(spark, where, "wcxb_samples")


def _blobs(spark: SparkSession, where: str) -> DataFrame:
    fences = schema_drift.blobs_of(_read(spark, where, "streaming_templates"), "streaming_templates", "template_blob")
    return fences.unionByName(schema_drift.blobs_of(_read(spark, where, "templates"), "templates", "extractor_blob"))


# ------------------------------------------------------------------- drift of stored schemas


def p4_found(spark: SparkSession, where: str) -> DataFrame:
    return schema_drift.schema_changes(_blobs(spark, where))


#: The fields of both blob kinds under the names of the stores' first files, and the types they have in the tables.
FENCE_FIELDS = ["Host", "Version", "PrefixPattern", "ContentStartPattern", "ContentEndPattern", "BailoutBytes", "MaxCaptureBytes"]
FENCE_KINDS = {"Version": "number", "BailoutBytes": "number", "MaxCaptureBytes": "number"} | {
    f"{p}.{f}": k for p in FENCE_FIELDS[2:5] for f, k in {"TagName": "string", "IsClose": "boolean", "RequiredAttributes": "array", "RequiredAttributes[].Name": "string", "RequiredAttributes[].Value": "string"}.items()
}
RULE_FIELDS = ["templateId", "version", "rules", "centroid", "notes"]
RULE_KINDS = {"version": "number", "rules": "array", "rules[].role": "number", "rules[].ruleId": "string", "rules[].meanConfidence": "number", "rules[].observationCount": "number", "rules[].driftScore": "number", "centroid.totalObservations": "number"}


def p4_moves(spark: SparkSession, where: str) -> DataFrame:
    """The same changes with moves told from removals and additions."""
    return schema_drift.schema_changes(_blobs(spark, where), moves=True)


def p4_table(spark: SparkSession, where: str) -> DataFrame:
    """The fence stores as one table under the names and types of their first files."""
    blobs = _blobs(spark, where).where("blob_table = 'streaming_templates'")
    return schema_drift.unify(blobs, schema_drift.schema_changes(blobs), FENCE_FIELDS, FENCE_KINDS)


def p4_template_table(spark: SparkSession, where: str) -> DataFrame:
    """The learned-template stores as one table under the names and types of their first files, those inside rules and centroids too."""
    blobs = _blobs(spark, where).where("blob_table = 'templates'")
    return schema_drift.unify(blobs, schema_drift.schema_changes(blobs), RULE_FIELDS, RULE_KINDS)


# ---------------------------------------------------------------------- pages and their kernel


def flagship(spark: SparkSession, where: str) -> DataFrame:
    """Every page matched to its host's templates, learning as it goes: status, template, title and Markdown."""
    return learn.learned(_pages(spark, where), "file_id", "host", "html", "crawled_at").select("host", "page", "status", "template_id", "version", "similarity", "n_blocks", "title", "markdown")


def learn_templates(spark: SparkSession, where: str) -> DataFrame:
    return learn.learned(_pages(spark, where), "file_id", "host", "html", "crawled_at")


def template_events(spark: SparkSession, where: str) -> DataFrame:
    return learn.events(learn_templates(spark, where))


#: When match_frozen stops learning.
FROZEN_AT = "2025-04-01 00:00:00"


def match_frozen(spark: SparkSession, where: str) -> DataFrame:
    """The pages since FROZEN_AT, matched to what the pages before it taught and to nothing later."""
    from datetime import datetime, timezone

    until = datetime.fromisoformat(FROZEN_AT).replace(tzinfo=timezone.utc).timestamp()
    late = _pages(spark, where).where(F.col("crawled_at") >= F.to_timestamp(F.lit(FROZEN_AT))).select(F.col("file_id").alias("page")).distinct()
    return learn.learned(_pages(spark, where), "file_id", "host", "html", "crawled_at", until=until).join(late, "page", "left_semi")


def dom_nodes(spark: SparkSession, where: str) -> DataFrame:
    return extract.dom_nodes(_pages(spark, where), "file_id", "html")


def extract_blocks(spark: SparkSession, where: str) -> DataFrame:
    return extract.blocks(_pages(spark, where), "file_id", "html")


def extract_markdown(spark: SparkSession, where: str) -> DataFrame:
    return extract.markdown(_pages(spark, where), "file_id", "html")


def markdown_main_only(spark: SparkSession, where: str) -> DataFrame:
    return extract.markdown(_pages(spark, where), "file_id", "html", "MainContentOnly")


def page_outlines(spark: SparkSession, where: str) -> DataFrame:
    return skeleton.outlines(_pages(spark, where), "file_id", "html")


def page_fingerprints(spark: SparkSession, where: str, even: bool = False) -> DataFrame:
    return fingerprint.fingerprints(spread(_pages(spark, where)) if even else _pages(spark, where), "file_id", "host", "html")


def _probe_sides(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame]:
    prints = stored(page_fingerprints(spark, where, True).dropDuplicates(["page"]))  # both sides read it
    dated = prints.hint("merge").join(_pages(spark, where).groupBy(F.col("file_id").alias("page")).agg(F.min("crawled_at").alias("last_seen")), "page")
    oldest = dated.groupBy("host", "minhash").agg(F.min_by(F.struct("page", "minhash", "bands", "grams", "norm", "last_seen"), F.struct("last_seen", "page")).alias("t"), F.count("*").alias("observation_count"))
    return prints, oldest.select(F.col("t.page").alias("template_id"), "host", "t.minhash", "t.bands", "t.grams", "observation_count", "t.last_seen")


def fast_probe(spark: SparkSession, where: str) -> DataFrame:
    pages, templates = _probe_sides(spark, where)
    return fingerprint.fast_probe(pages, templates, F.to_timestamp(F.lit(AS_OF)))


def slow_probe(spark: SparkSession, where: str) -> DataFrame:
    pages, templates = _probe_sides(spark, where)
    return fingerprint.slow_probe(pages, templates, F.to_timestamp(F.lit(AS_OF)))


def node_grams(spark: SparkSession, where: str) -> DataFrame:
    return fingerprint.node_grams(dom_nodes(spark, where).dropDuplicates(["page", "pre"]))


def node_shingles(spark: SparkSession, where: str) -> DataFrame:
    return fingerprint.node_shingles(dom_nodes(spark, where).dropDuplicates(["page", "pre"])).groupBy("page").agg(F.count("*").alias("n"), F.countDistinct("shingle").alias("n_distinct"))


def element_features(spark: SparkSession, where: str) -> DataFrame:
    return features.element_features(_pages(spark, where), "file_id", "html")


def gold_labels(spark: SparkSession, where: str) -> DataFrame:
    fixtures = _read(spark, where, "fixtures").dropDuplicates(["id"])
    return features.gold_labels(features.element_features(fixtures, "id", "html"), fixtures.where("gold IS NOT NULL"), "id", "gold")


def extraction_scores(spark: SparkSession, where: str) -> DataFrame:
    """Word precision, recall and F1 of extracted main content against the fixtures' gold text, by page type."""
    fixtures = _read(spark, where, "fixtures").dropDuplicates(["id"])
    got = extract.markdown(fixtures, "id", "html", "Wcxb").select(F.col("page").alias("id"), F.col("markdown").alias("predicted"))
    pairs = fixtures.where("gold IS NOT NULL").select("id", "page_type", "gold").join(got, "id")
    return evaluate.f1_report(evaluate.word_f1(pairs, "id", "predicted", "gold").join(pairs.select("id", "page_type"), "id"), "page_type")


# ----------------------------------------------------------------------------------- mining


def _observations(spark: SparkSession, where: str) -> DataFrame:
    pages = _pages(spark, where).dropDuplicates(["file_id"])
    return mining.rule_observations(extract.induced_rules(pages, "file_id", "host", "html", "crawled_at"))


def rule_observations(spark: SparkSession, where: str) -> DataFrame:
    return _observations(spark, where)


def stable_chains(spark: SparkSession, where: str) -> DataFrame:
    return mining.stable_chains(mining.newest(_observations(spark, where)))


def claim_frequency(spark: SparkSession, where: str) -> DataFrame:
    return mining.claim_frequency(_observations(spark, where))


def cluster_medoids(spark: SparkSession, where: str) -> DataFrame:
    return mining.medoids(_observations(spark, where))


def cluster_outliers(spark: SparkSession, where: str) -> DataFrame:
    return mining.outliers(_observations(spark, where))


def emit_candidates(spark: SparkSession, where: str) -> DataFrame:
    return mining.candidates(_observations(spark, where))


# ------------------------------------------------------------------------------ fence scanning


def _fences(spark: SparkSession, where: str) -> DataFrame:
    """``host, blob``: the newest usable fence of every host, from the stores as one table; where there is none, one made from the host's first page."""
    stored = p4_table(spark, where)
    parts = [F.concat(F.lit(f'"{c}":'), F.col(c)) for c in FENCE_FIELDS]
    blob = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).cast("binary")
    rows = _read(spark, where, "streaming_templates").where("host IS NOT NULL").select("store_id", "file_seq", "template_id", "host", "version", "created_at").distinct()
    known = jobs.latest_usable(rows.join(stored.select("store_id", "file_seq", "template_id", blob.alias("blob")), ["store_id", "file_seq", "template_id"]))
    made = jobs.induced_fences(_pages(spark, where), "file_id", "host", "html", "crawled_at")
    return known.unionByName(made.join(known.select("host"), "host", "left_anti"))


def fence_scan(spark: SparkSession, where: str) -> DataFrame:
    """Pages scanned with the newest usable fence of their host."""
    return jobs.scan_pages(_pages(spark, where).dropDuplicates(["file_id"]), _fences(spark, where), "file_id", "host", "html")


def fence_store(spark: SparkSession, where: str) -> DataFrame:
    """Every host's newest usable fence."""
    return _fences(spark, where).select("host", F.decode("blob", "UTF-8").alias("blob"))


def fence_refits(spark: SparkSession, where: str) -> DataFrame:
    """When the fences of hosts are made, looked at again, and become new versions, page by page."""
    return jobs.refit_pages(_pages(spark, where), "file_id", "host", "html", "crawled_at")


def site_links(spark: SparkSession, where: str) -> DataFrame:
    return page_sources.links(_pages(spark, where), "url", "html")


def site_map(spark: SparkSession, where: str) -> DataFrame:
    """A crawl from the first address of every host, three steps deep and of fifty pages at most, as crawls are limited."""
    url = web.canonical_url(F.col("url"))
    seeds = _pages(spark, where).where("url IS NOT NULL").select(web.host_of(F.col("url")).alias("host"), url.alias("url")).where("host <> ''").groupBy("host").agg(F.min("url").alias("url")).select("url")
    return skeleton.site_map(site_links(spark, where), seeds)


def queue_cooldown(spark: SparkSession, where: str) -> DataFrame:
    """The events a queue would take, at most one per user and kind within an hour after the last one taken."""
    return stores.cooled(_read(spark, where, "events"), ["user_id", "event_type"], "ts")


def bundle_export(spark: SparkSession, where: str) -> DataFrame:
    return stores.export_bundle(_read(spark, where, "templates"))


def bundle_roundtrip(spark: SparkSession, where: str) -> DataFrame:
    out = stores.import_bundle(stores.export_bundle(_read(spark, where, "templates")))
    return out.select("store_id", "template_id", F.hex("host_hash").alias("host_hash"), "version_number", F.md5("signature_minhash").alias("signature"), F.md5("pq_gram_vector").alias("vector"), F.md5("extractor_blob").alias("extractor"), "observation_count")


# ------------------------------------------------------------------------- relational queries


def pages_by_host(spark: SparkSession, where: str) -> DataFrame:
    host = web.host_of(F.col("url"))
    return _pages(spark, where).groupBy(host.alias("host")).agg(F.countDistinct("file_id").alias("pages"), F.min("crawled_at").alias("first_seen"))


def host_hash(spark: SparkSession, where: str) -> DataFrame:
    return _pages(spark, where).where("host IS NOT NULL").select(F.lower("host").alias("host")).distinct().select("host", F.left(F.sha2("host", 256), F.lit(32)).alias("host_hash"))


def keyed_host_hash(spark: SparkSession, where: str) -> DataFrame:
    """Hosts under pseudonyms that need the key."""
    from .functions.hashing import host_hash as hashed
    from .oracles import KEY

    made = F.pandas_udf(lambda s: s.map(lambda h: hashed(h, KEY).hex()), "string")
    return _pages(spark, where).where("host IS NOT NULL").select(F.lower("host").alias("host")).distinct().select("host", made("host").alias("host_hash"))


def class_buckets(spark: SparkSession, where: str) -> DataFrame:
    """The hashes by which class tokens go into feature buckets."""
    from .functions.hashing import fnv1a32

    raw = F.explode(F.regexp_extract_all("html", F.lit(r'class="([^"]*)"'), F.lit(1)))
    tokens = _pages(spark, where).select(raw.alias("c")).select(F.explode(F.split("c", " ")).alias("token")).where("token <> ''").distinct()
    return tokens.select("token", F.pandas_udf(lambda s: s.map(fnv1a32), "bigint")("token").alias("fnv"))


def url_functions(spark: SparkSession, where: str) -> DataFrame:
    u = F.col("url")
    rows = _pages(spark, where).select("file_id", "url").distinct()
    return rows.select("file_id", web.canonical_url(u).alias("canonical"), web.is_hostname(web.host_of(u)).alias("valid_host"), web.is_public_url(u).alias("public"), web.cache_key(F.lit("get"), u, F.lit("RagFull")).alias("cache_key"))


def accept_quality(spark: SparkSession, where: str) -> DataFrame:
    """Accept headers made of the responses' block counts, and what they say about Markdown."""
    n = F.col("block_count")
    header = F.concat(F.lit("text/html, text/*;q=0."), (n % 9 + 1).cast("string"), F.when(n % 3 == 0, ",text/markdown;q=0.75").otherwise(""), F.when(n % 2 == 0, ", */*;q=0.1").otherwise(""))
    rows = _read(spark, where, "test_responses").where("block_count IS NOT NULL").select("response_id", header.alias("accept")).distinct()
    return rows.select("response_id", "accept", web.accept_quality(F.col("accept"), "text/markdown").alias("markdown_q"), web.accept_quality(F.col("accept"), "text/html").alias("html_q"))


_TAG = r"<([a-zA-Z][a-zA-Z0-9]*)"


def _tags(spark: SparkSession, where: str) -> DataFrame:
    pages = _pages(spark, where).select("file_id", "html").distinct()
    return pages.select("file_id", F.posexplode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(1))).alias("pos", "tag")).select("file_id", "pos", F.lower("tag").alias("tag"))


def tag_events(spark: SparkSession, where: str) -> DataFrame:
    return _tags(spark, where).groupBy("file_id", "tag").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def structural_tags(spark: SparkSession, where: str) -> DataFrame:
    """Structural tags of every page and their share of all its tags."""
    t = tag_events(spark, where)
    total = t.groupBy("file_id").agg(F.sum("n").alias("total"))
    return t.where(F.col("tag").isin(STRUCTURAL_TAGS)).groupBy("file_id").agg(F.sum("n").alias("structural")).join(total, "file_id").select("file_id", "structural", F.round(F.col("structural") / F.col("total"), 9).alias("share"))


def event_sessions(spark: SparkSession, where: str) -> DataFrame:
    return jobs.sessions(_read(spark, where, "events"), "ts", "user_id")


def events_ndjson(spark: SparkSession, where: str) -> DataFrame:
    """Template events as lines for a sink, emitted at the page's time."""
    at = _pages(spark, where).groupBy(F.col("file_id").alias("page")).agg(F.min("crawled_at").alias("at"))
    return jobs.envelope(template_events(spark, where).join(at, "page"), "kind", "at")


def tag_histogram(spark: SparkSession, where: str) -> DataFrame:
    return _tags(spark, where).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("pages"))


def _shingles(spark: SparkSession, where: str) -> DataFrame:
    w = Window.partitionBy("file_id").orderBy("pos")
    t = _tags(spark, where).withColumn("b", F.lead("tag", 1).over(w)).withColumn("c", F.lead("tag", 2).over(w)).where("c IS NOT NULL")
    return t.select("file_id", F.concat_ws(">", "tag", "b", "c").alias("shingle")).distinct()


def tag_shingles(spark: SparkSession, where: str) -> DataFrame:
    return _shingles(spark, where).groupBy("shingle").agg(F.count("*").alias("pages"))


def _sketch(spark: SparkSession, where: str) -> DataFrame:
    slot = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("slot")
    rows = _shingles(spark, where).select("file_id", "shingle", slot)
    return rows.groupBy("file_id", "slot").agg(F.min(F.substring(F.md5(F.concat_ws("|", "slot", "shingle").cast("binary")), 1, 8)).alias("mark"))


def minhash_sql(spark: SparkSession, where: str) -> DataFrame:
    return _sketch(spark, where)


def band_probe(spark: SparkSession, where: str) -> DataFrame:
    """Pages of a host that share a band of four slots with the first page that has it, and in how many bands; band_pairs has all pairs."""
    bands = _sketch(spark, where).groupBy("file_id", F.floor(F.col("slot") / 4).alias("band")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "mark"))), lambda x: x["mark"]), ",").alias("key"))
    hosts = _pages(spark, where).where("host IS NOT NULL").select("file_id", F.lower("host").alias("host")).distinct()
    b = bands.join(hosts, "file_id")
    first = b.groupBy("host", "band", "key").agg(F.min("file_id").alias("file_a"))
    return b.join(first, ["host", "band", "key"]).where("file_a < file_id").groupBy("host", "file_a", F.col("file_id").alias("file_b")).agg(F.count("*").alias("bands"))


def _sketched(spark: SparkSession, where: str) -> DataFrame:
    marks = _sketch(spark, where).groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "mark"))), lambda x: x["mark"]).alias("marks"))
    hosts = _pages(spark, where).where("host IS NOT NULL").select("file_id", F.lower("host").alias("host")).distinct()
    return marks.join(hosts, "file_id")


def band_classes(spark: SparkSession, where: str) -> DataFrame:
    """The class of every page with a sketch: the first page of its host with the very same sketch."""
    pages = _sketched(spark, where)
    first = pages.groupBy("host", "marks").agg(F.min("file_id").alias("class_id"))
    return pages.join(first, ["host", "marks"]).select("host", "file_id", "class_id")


def band_pairs(spark: SparkSession, where: str) -> DataFrame:
    """All pairs of classes of a host that share a band of four slots, with the share of equal slots; band_classes has the pages of a class."""
    classes = _sketched(spark, where).groupBy("host", "marks").agg(F.min("file_id").alias("page"))
    bands = classes.select("host", "page", "marks", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("marks", k * 4 + 1, 4))).alias("band", "key"))
    side = lambda x: bands.select("host", "band", "key", F.col("page").alias(f"file_{x}"), F.col("marks").alias(f"marks_{x}"))
    same = F.size(F.filter(F.zip_with("marks_a", "marks_b", lambda a, b: a == b), lambda x: x))
    both = side("a").join(side("b"), ["host", "band", "key"]).where("file_a < file_b").select("host", "file_a", "file_b", (same / F.lit(16)).alias("likeness"))
    return both.groupBy("host", "file_a", "file_b").agg(F.max("likeness").alias("likeness"))


def gram_cosine(spark: SparkSession, where: str) -> DataFrame:
    """The cosine of every page's tag counts with its host's first page."""
    counts = tag_events(spark, where).select("file_id", "tag", "n")
    hosts = _pages(spark, where).where("host IS NOT NULL").select("file_id", F.lower("host").alias("host")).distinct()
    first = hosts.groupBy("host").agg(F.min("file_id").alias("first_id"))
    rows = hosts.join(first, "host")
    a = rows.join(counts, "file_id")
    b = first.join(counts.select(F.col("file_id").alias("first_id"), "tag", F.col("n").alias("m")), "first_id").select("host", "tag", "m")
    dots = a.join(b, ["host", "tag"]).groupBy("host", "file_id", "first_id").agg(F.sum(F.col("n") * F.col("m")).cast("double").alias("dot"))
    norms = counts.groupBy("file_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return dots.join(norms, "file_id").join(norms.select(F.col("file_id").alias("first_id"), F.col("norm").alias("norm1")), "first_id").select("host", "file_id", F.round(F.col("dot") / (F.col("norm") * F.col("norm1")), 9).alias("cosine"))


def tag_entropy(spark: SparkSession, where: str) -> DataFrame:
    t = tag_events(spark, where)
    total = t.groupBy("file_id").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return t.join(total, "file_id").groupBy("file_id").agg(F.round(-F.sum(p * F.log2(p)), 9).alias("entropy"))


def page_title(spark: SparkSession, where: str) -> DataFrame:
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return _pages(spark, where).select("file_id", title.alias("title")).distinct()


def class_tokens(spark: SparkSession, where: str) -> DataFrame:
    """Class tokens of pages: whether each names something, and what is left of it without noise."""
    raw = F.explode(F.regexp_extract_all("html", F.lit(r'class="([^"]*)"'), F.lit(1)))
    tokens = _pages(spark, where).select(raw.alias("c")).select(F.explode(F.split("c", " ")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    return tokens.select("token", "n", stability.stable(F.col("token")).alias("stable"), F.array_join(stability.quiet(F.array("token")), " ").alias("quiet"))


def excerpt_escape(spark: SparkSession, where: str) -> DataFrame:
    d = _read(spark, where, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.md5(web.excerpt(F.col("text"), 200)).alias("excerpt"), F.md5(web.escape_markdown(F.col("text"))).alias("escaped"))


def word_counts(spark: SparkSession, where: str) -> DataFrame:
    return evaluate.word_bags(_read(spark, where, "documents").where("text IS NOT NULL"), "doc_id", "text").groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


def _scored(spark: SparkSession, where: str) -> DataFrame:
    fixtures = _read(spark, where, "fixtures").where("gold IS NOT NULL").select("id", "page_type", "html", "gold").distinct()
    return fixtures.withColumn("plain", F.regexp_replace("html", "<[^>]*>", " "))


def word_f1(spark: SparkSession, where: str) -> DataFrame:
    s = evaluate.word_f1(_scored(spark, where), "id", "plain", "gold")
    return s.select("id", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


def f1_rollup(spark: SparkSession, where: str) -> DataFrame:
    rows = _scored(spark, where)
    r = evaluate.f1_report(evaluate.word_f1(rows, "id", "plain", "gold").join(rows.select("id", "page_type"), "id"), "page_type")
    return r.select("page_type", "pages", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def excess_words(spark: SparkSession, where: str) -> DataFrame:
    return evaluate.excess_words(_scored(spark, where), "id", "plain", "gold")


def with_without(spark: SparkSession, where: str) -> DataFrame:
    rows = _scored(spark, where).withColumn("wanted", F.filter(F.split("gold", "\n"), lambda x: F.length(x) > 0)).withColumn("unwanted", F.array(F.lit("cookie"), F.lit("http://")))
    r = evaluate.with_without(rows, "id", "plain", "wanted", "unwanted")
    return r.select("id", F.round("with_recall", 9).alias("with_recall"), F.round("without_reject", 9).alias("without_reject"))


def value_percentiles(spark: SparkSession, where: str) -> DataFrame:
    return evaluate.nearest_rank(_read(spark, where, "events"), ["event_type"], "value")


def events_hourly(spark: SparkSession, where: str) -> DataFrame:
    return jobs.hourly(_read(spark, where, "events"), "ts", "event_type")


def observation_ring(spark: SparkSession, where: str) -> DataFrame:
    return stores.ring(_read(spark, where, "template_observations")).groupBy("template_id").agg(F.count("*").alias("kept"), F.min("observed_at").alias("oldest"), F.max("observed_at").alias("newest"))


def drift_average(spark: SparkSession, where: str) -> DataFrame:
    d = stores.drift_average(_read(spark, where, "template_observations"))
    return d.select("template_id", "n", F.round("ewma", 9).alias("ewma"))


def longest_drift(spark: SparkSession, where: str) -> DataFrame:
    return stores.longest_drift(_read(spark, where, "template_observations"), 0.85)


def true_likeness(spark: SparkSession, where: str) -> DataFrame:
    return stores.true_likeness(_read(spark, where, "template_observations"), _read(spark, where, "templates"))


def fence_versions(spark: SparkSession, where: str) -> DataFrame:
    return stores.fence_versions(_read(spark, where, "streaming_templates")).select("host", F.array_join(F.transform("versions", lambda v: v.cast("string")), ",").alias("versions"), "latest")


def fence_at_version(spark: SparkSession, where: str) -> DataFrame:
    return stores.fence_at(_read(spark, where, "streaming_templates"), 1)


def store_history(spark: SparkSession, where: str) -> DataFrame:
    return stores.history(_read(spark, where, "templates"), 2)


def store_changes(spark: SparkSession, where: str) -> DataFrame:
    return stores.file_changes(_read(spark, where, "templates"))


def latest_templates(spark: SparkSession, where: str) -> DataFrame:
    return stores.latest_rows(_read(spark, where, "templates")).select("store_id", "template_id", "file_seq", "version_number", "observation_count", F.md5("signature_minhash").alias("signature"))


def aging_score(spark: SparkSession, where: str) -> DataFrame:
    b = stores.best_template(_read(spark, where, "templates"), F.to_timestamp(F.lit(AS_OF)))
    return b.select("host_hash", "template_id", F.round("score", 6).alias("score"))


def status_report(spark: SparkSession, where: str) -> DataFrame:
    """Responses by status in one spelling, by host, with totals."""
    status = F.coalesce(F.regexp_replace(F.lower(F.trim("status")), "[^a-z]", ""), F.lit("unknown"))
    rows = _read(spark, where, "test_responses").distinct().select("response_id", status.alias("status"), F.lower("host").alias("host"), "block_count")
    return rows.groupBy("status").agg(F.countDistinct("response_id").alias("responses"), F.countDistinct("host").alias("hosts"), F.sum("block_count").alias("blocks"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    p4_found, p4_moves, p4_table, p4_template_table, flagship, learn_templates, template_events, match_frozen, dom_nodes, extract_blocks, extract_markdown, markdown_main_only, page_outlines, page_fingerprints, fast_probe, slow_probe,
    node_grams, node_shingles, element_features, gold_labels, extraction_scores, rule_observations, stable_chains, claim_frequency, cluster_medoids, cluster_outliers, emit_candidates, fence_scan, fence_store, fence_refits,
    site_links, site_map, queue_cooldown, bundle_export, bundle_roundtrip, pages_by_host, host_hash, keyed_host_hash, class_buckets, url_functions, accept_quality, tag_events, structural_tags, event_sessions, events_ndjson, tag_histogram, tag_shingles, minhash_sql, band_probe, band_classes, band_pairs,
    gram_cosine, tag_entropy, page_title, class_tokens, excerpt_escape, word_counts, word_f1, f1_rollup, excess_words, with_without, value_percentiles, events_hourly, observation_ring, drift_average,
    longest_drift, true_likeness, fence_versions, fence_at_version, store_history, store_changes, latest_templates, aging_score, status_report,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*QUERIES, *rendered_queries.QUERIES)}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return SQL | rendered_queries.SQL
