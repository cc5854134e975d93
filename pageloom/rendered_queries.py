"""Queries over pages rendered from relational rows, and the SQL that says from the rows what must come out.

They run the very kernels and operators of the page pipeline - tree, nodes, blocks, Markdown,
rules, learning, probes, fences, mining - on pages whose every part is known, so that SQL over
the customers and nations can state the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import stored
from .operators import evaluate, extract, features, fingerprint, learn, mining, skeleton, stores
from .sources import pages as page_sources
from .sources.rendered import FIRST, LAST, MORE, PAGE, customer_pages
from .sources.sinks import json_results
from .sources.tables import read, spread
from .streaming import jobs, tags

AS_OF = "2026-01-01 00:00:00"


def _cards(spark: SparkSession, where: str, extra: bool = False) -> DataFrame:
    return customer_pages(spread(read(spark, where, "customer")), read(spark, where, "nation"), extra)  # a short row makes a whole page


def card_pages(spark: SparkSession, where: str) -> DataFrame:
    return _cards(spark, where, True).select("page", "host", "url", F.unix_seconds("at").alias("at"), F.md5("html").alias("html"))


def card_nodes(spark: SparkSession, where: str) -> DataFrame:
    """Every element of every page with its interval, place, lengths and path."""
    n = extract.dom_nodes(_cards(spark, where, True), "page", "html")
    return n.select("page", "pre", "end", "parent", "depth", "tag", "nth", "sib_idx", "n_children", F.coalesce("id", F.lit("")).alias("id"), F.array_join("classes", " ").alias("classes"), F.md5("own_text").alias("own_text"), "text_len", "text_trim_len", "link_len", "prose_len", "xpath")


def card_inside(spark: SparkSession, where: str) -> DataFrame:
    """How many elements and characters of paragraphs lie inside every element, by intervals."""
    n = extract.dom_nodes(_cards(spark, where, True), "page", "html").select("page", "pre", "end", "tag", "text_len")
    inner = n.select("page", F.col("pre").alias("at"), F.col("tag").alias("inner"), F.col("text_len").alias("length"))
    both = n.join(inner, "page").where("at > pre AND at <= end")
    return both.groupBy("page", "pre", "tag").agg(F.count("*").alias("elements"), F.sum(F.when(F.col("inner") == "p", F.col("length")).otherwise(0)).alias("paragraphs"))


def card_blocks(spark: SparkSession, where: str) -> DataFrame:
    b = extract.blocks(_cards(spark, where, True), "page", "html")
    return b.select("page", "ord", "role", F.round("confidence", 4).alias("confidence"), "text", "xpath", "text_length", F.round("link_density", 6).alias("link_density"), F.size("links").alias("links"))


def card_markdown(spark: SparkSession, where: str) -> DataFrame:
    return extract.markdown(_cards(spark, where, True), "page", "html")


def card_renders(spark: SparkSession, where: str) -> DataFrame:
    """Every other page comes without its main element until a browser has rendered it."""
    pages = _cards(spark, where, True)
    sent = F.when(F.col("page").cast("bigint") % 2 == 1, F.regexp_replace("html", "<main.*</main>", "<main></main>")).otherwise(F.col("html"))
    return extract.best_render(pages.withColumn("sent", sent), "page", "sent", "html")


def card_registered(spark: SparkSession, where: str) -> DataFrame:
    """The rows a store takes for the hosts' templates, those of hosts with an even number being there already: one per band."""
    *_, templates = _prints(spark, where)
    there = templates.where(F.regexp_extract("host", "([0-9]+)", 1).cast("int") % 2 == 0)
    _, bands = stores.registered(templates, there)
    return bands.groupBy("host", "template_id").agg(F.count("*").alias("bands"), F.count_distinct("band").alias("numbers"))


def card_results(spark: SparkSession, where: str) -> DataFrame:
    """The results of extraction as JSON lines, as a sink takes them."""
    return json_results(extract.markdown(_cards(spark, where, True), "page", "html", "MainContentOnly").select("page", "title", "markdown"))


def card_outlines(spark: SparkSession, where: str) -> DataFrame:
    o = skeleton.outlines(_cards(spark, where, True), "page", "html")
    return o.select("page", "skeleton", F.to_json("selectors").alias("selectors"))


def card_features(spark: SparkSession, where: str) -> DataFrame:
    """Features of every element that SQL can say: kind, place, depth, neighbours and what is around it."""
    f = features.element_features(_cards(spark, where, True), "page", "html")
    at = {n: i for i, n in enumerate(features.NAMES)}
    columns = [F.get("features", F.lit(at[n])).cast("int").alias(n) for n in ("tag_main", "tag_nav", "tag_other", "depth", "siblings", "same_tag", "in_main", "in_nav")]
    return f.select("page", "xpath", "tag", "text_len", "text", F.round(F.get("features", F.lit(at["link_density"])), 4).cast("double").alias("link_density"), *columns)


def card_gold(spark: SparkSession, where: str) -> DataFrame:
    pages = _cards(spark, where, True)
    gold = pages.select("page", F.regexp_replace(F.regexp_extract("html", "<main.*</main>", 0), "<[^>]*>", " ").alias("gold"))
    return features.gold_labels(features.element_features(pages, "page", "html"), gold, "page", "gold")


def card_rules(spark: SparkSession, where: str) -> DataFrame:
    r = extract.induced_rules(_cards(spark, where), "page", "host", "html", "at")
    return r.select("page", "host", "role", F.array_join("selectors", ",").alias("selectors"), F.round("confidence", 4).alias("confidence"), F.size("claims").alias("claims"), F.element_at("claims", -1)["tag"].alias("leaf"), F.coalesce(F.element_at("claims", -1)["id"], F.lit("")).alias("leaf_id"))


def card_prints(spark: SparkSession, where: str) -> DataFrame:
    """Fingerprints tell layouts apart and nothing else: pages of one shape, whatever their text, and their likeness to the first of it."""
    p = fingerprint.fingerprints(_cards(spark, where, True), "page", "host", "html")
    first = p.groupBy("minhash").agg(F.min(F.col("page").cast("bigint")).alias("first"), F.count("*").alias("pages"), F.count_distinct("host").alias("hosts"), F.min("n_shingles").alias("shingles"), F.max("n_shingles").alias("most"))
    return first.drop("minhash")


def card_grams(spark: SparkSession, where: str) -> DataFrame:
    """pq-grams of every page from the node table, and from the kernel, where they agree."""
    nodes = fingerprint.node_grams(extract.dom_nodes(_cards(spark, where, True), "page", "html"))
    kernel = fingerprint.fingerprints(_cards(spark, where, True), "page", "host", "html").select("page", F.explode("grams").alias("gram", "weight"))
    return nodes.join(kernel, ["page", "gram"]).where(F.col("n") == F.col("weight")).groupBy("gram").agg(F.count("*").alias("pages"), F.sum("n").alias("n"))


def _learned(spark: SparkSession, where: str, **more) -> DataFrame:
    return learn.learned(_cards(spark, where), "page", "host", "html", "at", **more)


def card_learning(spark: SparkSession, where: str) -> DataFrame:
    """A host's first page teaches its layout, every later one hits it on the fast path."""
    return _learned(spark, where).select("host", "page", "status", "version", "similarity", "true_jaccard", "observations", "n_blocks", "title", "event", F.md5("markdown").alias("markdown"))


def card_frozen(spark: SparkSession, where: str) -> DataFrame:
    """Templates learned from the first three hundred customers, frozen then."""
    return _learned(spark, where, until=1_700_000_000.0 + 300 * 60).select("host", "page", "status", "observations")


def card_overrides(spark: SparkSession, where: str) -> DataFrame:
    """A hand-written template comes before what was learned; a snapshot only where asked for; one that finds nothing leaves the page to the rest."""
    template = lambda host, css, **more: {"host": host, "deterministic": False, "rules": [{"role": "MainContent", "selectors": [css], "confidence": 1.0, "chain": []}], **more}
    given = [template("nation-1.example", "#card"), template("nation-2.example", "#card", deterministic=True), template("nation-3.example", "#nowhere")]
    return _learned(spark, where, templates=given).select("host", "page", "status", F.when(F.col("status") == "OperatorOverride", F.col("template_id")).otherwise("").alias("template"), "n_blocks")


def card_events(spark: SparkSession, where: str) -> DataFrame:
    """New templates as event lines."""
    at = _cards(spark, where).select("page", "at")
    events = learn.events(_learned(spark, where)).select("kind", "host", "page", "new_version").join(at, "page")
    return jobs.envelope(events.select("kind", "at", "host", "page", "new_version"), "kind", "at")


def _prints(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The names of all pages with their classes, the classes' fingerprints, and the first page of every host as its template."""
    pages = stored(fingerprint.layouts(_cards(spark, where), "page", "host", "html", "at"))  # all three read it
    classes = stored(fingerprint.classes_of(pages))
    first = pages.groupBy("host").agg(F.min_by(F.struct("page", "klass", "at"), "at").alias("t"), F.count("*").alias("observation_count"))
    named = first.select(F.col("t.page").alias("template_id"), F.col("t.klass").alias("klass"), "observation_count", F.col("t.at").alias("last_seen"))
    return pages.select("page", "host", "klass"), classes, named.join(classes.hint("merge"), "klass").drop("klass")


def card_fast_probe(spark: SparkSession, where: str) -> DataFrame:
    p = fingerprint.fast_classes(*_prints(spark, where), F.to_timestamp(F.lit(AS_OF)))
    return p.select("page", "template_id", "similarity", F.round("score", 6).alias("score"))


def card_slow_probe(spark: SparkSession, where: str) -> DataFrame:
    p = fingerprint.slow_classes(*_prints(spark, where), F.to_timestamp(F.lit(AS_OF)))
    return p.select("page", "template_id", F.round("similarity", 9).alias("similarity"), F.round("score", 6).alias("score"))


def card_fences(spark: SparkSession, where: str) -> DataFrame:
    """Every page scanned with the fence made from its host's first page: the bytes from the main element's start tag to its end tag."""
    pages = _cards(spark, where, True)
    return jobs.scan_pages(pages, jobs.induced_fences(pages, "page", "host", "html", "at"), "page", "host", "html").withColumnRenamed("stream_id", "page")


def card_fence_refits(spark: SparkSession, where: str) -> DataFrame:
    """When a host's fence is made and looked at again: once, and at every tenth capture; pages of one layout never change it."""
    return jobs.refit_pages(_cards(spark, where), "page", "host", "html", "at").select("host", "page", "reason", "version", "changed")


def card_tags(spark: SparkSession, where: str) -> DataFrame:
    """The tags of every page with their bytes, by the incremental reader in chunks of 64 bytes, and whether a tripwire for main and h1 trips."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for page, source in zip(pdf["page"], pdf["html"]):
                wire = tags.Tripwire(("main", "h1"))
                for k, t in enumerate(tags.tags_of(source, 64)):
                    rows.append((page, k, t.name, t.closing, t.begin, t.end, ";".join(f"{a}={b}" for a, b in t.attrs), wire.see(t)))
            yield pd.DataFrame(rows, columns=["page", "k", "name", "closing", "begin", "end", "attrs", "tripped"])

    return _cards(spark, where, True).select("page", "html").mapInPandas(run, "page string, k int, name string, closing boolean, begin bigint, end bigint, attrs string, tripped boolean")


def card_links(spark: SparkSession, where: str) -> DataFrame:
    return page_sources.links(_cards(spark, where), "url", "html")


def card_site_maps(spark: SparkSession, where: str) -> DataFrame:
    """A crawl from every host's first page, as a nested list."""
    pages = _cards(spark, where)
    seeds = pages.groupBy("host").agg(F.min_by("url", "at").alias("url")).select("url")
    return skeleton.tree_markdown(skeleton.site_map(page_sources.links(pages, "url", "html"), seeds))


def _card_rules(spark: SparkSession, where: str) -> DataFrame:
    return mining.rule_observations(extract.induced_rules(_cards(spark, where), "page", "host", "html", "at"))


def card_candidates(spark: SparkSession, where: str) -> DataFrame:
    """What every host is offered from mining its own and the others' pages."""
    c = mining.candidates(_card_rules(spark, where))
    return c.select("host", "role", F.element_at("claims", -1)["tag"].alias("leaf"), F.coalesce(F.element_at("claims", -1)["id"], F.lit("")).alias("leaf_id"), F.size("claims").alias("claims"), "source_count")


def card_mining_totals(spark: SparkSession, where: str) -> DataFrame:
    """What a periodic mining pass reports."""
    observations = stored(_card_rules(spark, where))  # read again for candidates and totals
    return mining.totals(observations, mining.candidates(observations))


def card_outcomes(spark: SparkSession, where: str) -> DataFrame:
    """Every candidate tried on every page of its host, as reputations by role."""
    pages = _cards(spark, where)
    found = mining.candidates(_card_rules(spark, where))
    log = mining.evaluated(found, pages, "page", "host", "html", "at")
    r = mining.reputation(log).join(found.select("candidate_id", "host", "role"), "candidate_id")
    return r.select("host", "role", "reputation", *[F.coalesce(F.unix_seconds(f"last_{c}_at"), F.lit(0)).alias(f"last_{c}") for c in ("won", "lost")])


# ----------------------------------------------------------------- stored fingerprints and rules


def _stored(spark: SparkSession, where: str) -> DataFrame:
    from .functions.codecs import grams, slots, stored_bands

    t = stores.latest_rows(read(spark, where, "templates")).where("last_seen IS NOT NULL AND host_hash IS NOT NULL")
    sign = F.when(F.length("signature_minhash") == 512, F.col("signature_minhash"))
    name = F.concat_ws("/", "store_id", "template_id")
    return t.select(name.alias("template_id"), F.hex("host_hash").alias("host"), slots(sign).alias("minhash"), stored_bands(sign).alias("bands"), grams(F.col("pq_gram_vector")).alias("grams"), "observation_count", "last_seen")


def _seen(spark: SparkSession, where: str) -> DataFrame:
    """The fingerprints of logged matches, under the host of the template they were logged for."""
    from .functions.codecs import slots, stored_bands

    hosts = read(spark, where, "templates").where("host_hash IS NOT NULL").groupBy("template_id").agg(F.min(F.hex("host_hash")).alias("host"))
    seen = read(spark, where, "template_observations").where("length(signature_minhash) = 512")
    page = F.concat_ws("@", "template_id", F.unix_micros("observed_at").cast("string"), F.md5("signature_minhash"))
    return seen.join(hosts, "template_id").select(page.alias("page"), "host", slots(F.col("signature_minhash")).alias("minhash"), stored_bands(F.col("signature_minhash")).alias("bands")).dropDuplicates(["page"])


def stored_fast_probe(spark: SparkSession, where: str) -> DataFrame:
    """Logged matches matched again: the best stored template of their host that shares a band and reaches the likeness."""
    p = fingerprint.fast_probe(_seen(spark, where), _stored(spark, where).where("minhash IS NOT NULL"), F.to_timestamp(F.lit(AS_OF)))
    return p.select("page", "template_id", "similarity", F.round("score", 6).alias("score"))


def stored_slow_probe(spark: SparkSession, where: str) -> DataFrame:
    """Every stored template's nearest other template by pq-grams, all hosts being one."""
    t = _stored(spark, where).where(F.size("grams") > 0).withColumn("host", F.lit("*"))
    p = fingerprint.slow_probe(t.withColumnRenamed("template_id", "page"), t, F.to_timestamp(F.lit(AS_OF)))
    return p.select("page", "template_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


def stored_grams(spark: SparkSession, where: str) -> DataFrame:
    """Stored pq-gram vectors, decoded: their entries, weights and norms."""
    t = _stored(spark, where).where(F.size("grams") > 0).select("template_id", F.explode("grams").alias("gram", "weight"))
    return t.groupBy("template_id").agg(F.count("*").alias("n"), F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"), F.min("gram").alias("first"), F.max("gram").alias("last"))


_RULES = "struct<rules:array<struct<ruleId:string,role:int,meanConfidence:double,claims:array<struct<tag:string,id:string,classes:array<string>,data:map<string,string>>>>>,_corrupt_record:string>"


def _stored_rules(spark: SparkSession, where: str) -> DataFrame:
    """Observations from the rules of stored extractors that are written in the first form; a rule's store is its host, its role its cluster."""
    t = read(spark, where, "templates").select("store_id", "file_seq", "template_id", "extractor_blob").distinct().withColumn("e", F.from_json(F.regexp_replace(F.decode("extractor_blob", "UTF-8"), "^\ufeff", ""), _RULES)).where("e._corrupt_record IS NULL")
    r = t.select("store_id", "file_seq", "template_id", F.explode("e.rules").alias("r")).where("r.ruleId LIKE 'r%' AND r.role IS NOT NULL AND size(r.claims) > 0")
    claim = lambda c: F.struct(c["tag"].alias("tag"), c["id"].alias("id"), c["classes"].alias("classes"), c["data"].alias("data"), F.create_map().cast("map<string,string>").alias("aria"), F.lit(None).cast("string").alias("role"))
    return r.select(
        F.concat_ws("/", "store_id", "file_seq", "template_id", "r.ruleId").alias("obs_id"), F.col("store_id").alias("host"), F.lit(0).alias("bucket"), F.col("r.role").cast("string").alias("role"),
        F.transform("r.claims", claim).alias("claims"), F.lit(0).cast("bigint").alias("target"), F.lit(1).alias("cardinality"), F.col("r.meanConfidence").alias("confidence"), F.timestamp_seconds("file_seq").alias("induced_at"),
    ).dropDuplicates(["obs_id"])


def stored_claim_frequency(spark: SparkSession, where: str) -> DataFrame:
    return mining.claim_frequency(_stored_rules(spark, where)).drop("bucket")


def stored_clusters(spark: SparkSession, where: str) -> DataFrame:
    c = mining.clusters(_stored_rules(spark, where))
    return c.join(mining.cluster_hosts(_stored_rules(spark, where)).groupBy("bucket", "role").agg(F.max("n").alias("most")), ["bucket", "role"]).drop("bucket")


def stored_chains(spark: SparkSession, where: str) -> DataFrame:
    """What a tenth of a role's stored chains share."""
    c = mining.stable_chains(_stored_rules(spark, where), presence=0.1)
    return c.select("role", "n", F.size("claims").alias("claims"), F.element_at("claims", -1)["tag"].alias("leaf"))


def stored_medoid_distance(spark: SparkSession, where: str) -> DataFrame:
    """Roles whose newest rules have a medoid, and how many of them are no further than the limit from it."""
    rows = mining.newest(_stored_rules(spark, where), 40)
    m = mining.medoids(rows)
    far = mining.outliers(rows, -1.0)
    return m.join(far.groupBy("bucket", "role").agg(F.count("*").alias("rules"), F.sum(F.when(F.col("distance") < 1e-9, 1).otherwise(0)).alias("same")), ["bucket", "role"]).select("role", "rules", "same")


def order_report(spark: SparkSession, where: str) -> DataFrame:
    """A classification report: orders by status, told from whether they are dear."""
    o = read(spark, where, "orders").select("o_orderstatus", F.when(F.col("o_totalprice") > 150000, "F").when(F.col("o_totalprice") > 80000, "O").otherwise("P").alias("told"))
    r = evaluate.classification_report(o, "o_orderstatus", "told")
    return r.select("label", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def import_counts(spark: SparkSession, where: str) -> DataFrame:
    """What importing the exported bundle over the stores' first files would add and replace; a line of another schema version is refused."""
    t = read(spark, where, "templates")
    lines = stores.export_bundle(t)
    odd = lines.sparkSession.range(1).select(F.lit('{"schemaVersion":2,"store_id":"other","template_id":"x"}').alias("value"))
    return stores.import_report(lines.unionByName(odd), t.where("file_seq = 1"))


def store_formats(spark: SparkSession, where: str) -> DataFrame:
    """Rows written in the present format and in an older one: only the present is read again."""
    t = stores.latest_rows(read(spark, where, "templates")).select("store_id", "template_id", "version_number")
    rows = stores.stamped(t.where("version_number > 1")).unionByName(stores.stamped(t.where("version_number <= 1"), 3))
    return stores.usable_rows(rows)


def candidate_upserts(spark: SparkSession, where: str) -> DataFrame:
    """Candidates of the stores' last files that their first files do not have yet."""
    rules = _stored_rules(spark, where)
    side = lambda df: df.select("host", "role", F.element_at("claims", -1)["tag"].alias("target"))
    first = side(rules.where(F.unix_seconds("induced_at") == 1)).distinct()
    return stores.upsert_candidates(side(rules), first)


# --------------------------------------------------------------------------------------- SQL


def _sql(text: str, **fields: str) -> str:
    """A text with fields as SQL concatenation."""
    out, rest = [], text
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [f"'{before}'", fields[name]]
    return "(" + " || ".join([*out, f"'{rest}'"]) + ")"


_CARDS = f"""c0 AS (
  SELECT c_custkey AS k, c_custkey::VARCHAR AS page, c_name AS name, n_name AS nation, n_nationkey AS nk, c_mktsegment AS segment, floor(c_acctbal)::BIGINT::VARCHAR AS balance, (c_custkey % 3)::INTEGER AS e,
    regexp_replace(lower(n_name), '[^a-z0-9]', '-', 'g') || '.example' AS host, 1700000000 + c_custkey * 60 AS at_
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), cards AS (
  SELECT *, {_sql(FIRST, name='name', balance='balance')} AS first_p, {_sql(LAST, segment='segment')} AS last_p,
    list_transform(range(1, e + 1), lambda i: {_sql(MORE, n='i::VARCHAR')}) AS more FROM c0
), html AS (
  SELECT *, {_sql(PAGE, name='name', nation='nation', segment='segment', key='nk::VARCHAR', first='first_p', last='last_p', more="array_to_string(list_transform(more, lambda x: '<p>' || x || '</p>'), '')")} AS html,
    {_sql(PAGE, name='name', nation='nation', segment='segment', key='nk::VARCHAR', first='first_p', last='last_p', more="''")} AS plain FROM cards
)"""
_B = "/html[1]/body[1]"
_NODES = f"""nodes AS (
  SELECT page, k, e, host, u.* FROM (SELECT *, unnest([
    {{pre: 0, "end": 14 + e, parent: -1, depth: 1, tag: 'body', nth: 1, sib: 0, kids: 4, id: '', cls: 'desk', own: '', n: lh + ls + ln + lt + l1 + l2 + coalesce(lm, 0) + 34, link: ls + ln, xpath: '{_B}', txt: '', up: ''}},
    {{pre: 1, "end": 2, parent: 0, depth: 2, tag: 'header', nth: 1, sib: 0, kids: 1, id: '', cls: '', own: '', n: lh, link: 0, xpath: '{_B}/header[1]', txt: '', up: 'body'}},
    {{pre: 2, "end": 2, parent: 1, depth: 3, tag: 'p', nth: 1, sib: 0, kids: 0, id: '', cls: '', own: 'Customer desk of ' || nation, n: lh, link: 0, xpath: '{_B}/header[1]/p[1]', txt: '', up: 'header'}},
    {{pre: 3, "end": 8, parent: 0, depth: 2, tag: 'nav', nth: 1, sib: 1, kids: 1, id: '', cls: '', own: '', n: ls + ln, link: ls + ln, xpath: '{_B}/nav[1]', txt: '', up: 'body'}},
    {{pre: 4, "end": 8, parent: 3, depth: 3, tag: 'ul', nth: 1, sib: 0, kids: 2, id: '', cls: '', own: '', n: ls + ln, link: ls + ln, xpath: '{_B}/nav[1]/ul[1]', txt: '', up: 'nav'}},
    {{pre: 5, "end": 6, parent: 4, depth: 4, tag: 'li', nth: 1, sib: 0, kids: 1, id: '', cls: '', own: '', n: ls, link: ls, xpath: '{_B}/nav[1]/ul[1]/li[1]', txt: '', up: 'ul'}},
    {{pre: 6, "end": 6, parent: 5, depth: 5, tag: 'a', nth: 1, sib: 0, kids: 0, id: '', cls: '', own: segment, n: ls, link: ls, xpath: '{_B}/nav[1]/ul[1]/li[1]/a[1]', txt: '', up: 'li'}},
    {{pre: 7, "end": 8, parent: 4, depth: 4, tag: 'li', nth: 2, sib: 1, kids: 1, id: '', cls: '', own: '', n: ln, link: ln, xpath: '{_B}/nav[1]/ul[1]/li[2]', txt: '', up: 'ul'}},
    {{pre: 8, "end": 8, parent: 7, depth: 5, tag: 'a', nth: 1, sib: 0, kids: 0, id: '', cls: '', own: nation, n: ln, link: ln, xpath: '{_B}/nav[1]/ul[1]/li[2]/a[1]', txt: '', up: 'li'}},
    {{pre: 9, "end": 12 + e, parent: 0, depth: 2, tag: 'main', nth: 1, sib: 2, kids: 3 + e, id: 'card', cls: '', own: '', n: lt + l1 + l2 + coalesce(lm, 0), link: 0, xpath: '{_B}/main[1]', txt: '', up: 'body'}},
    {{pre: 10, "end": 10, parent: 9, depth: 3, tag: 'h1', nth: 1, sib: 0, kids: 0, id: '', cls: '', own: name, n: lt, link: 0, xpath: '{_B}/main[1]/h1[1]', txt: '', up: 'main'}},
    {{pre: 11, "end": 11, parent: 9, depth: 3, tag: 'p', nth: 1, sib: 1, kids: 0, id: '', cls: '', own: first_p, n: l1, link: 0, xpath: '{_B}/main[1]/p[1]', txt: '', up: 'main'}},
    {{pre: 12 + e, "end": 12 + e, parent: 9, depth: 3, tag: 'p', nth: 2 + e, sib: 2 + e, kids: 0, id: '', cls: '', own: last_p, n: l2, link: 0, xpath: '{_B}/main[1]/p[' || (2 + e)::VARCHAR || ']', txt: '', up: 'main'}},
    {{pre: 13 + e, "end": 14 + e, parent: 0, depth: 2, tag: 'footer', nth: 1, sib: 3, kids: 1, id: '', cls: '', own: '', n: 34, link: 0, xpath: '{_B}/footer[1]', txt: '', up: 'body'}},
    {{pre: 14 + e, "end": 14 + e, parent: 13 + e, depth: 3, tag: 'p', nth: 1, sib: 0, kids: 0, id: '', cls: '', own: 'Customer desk, all rights reserved', n: 34, link: 0, xpath: '{_B}/footer[1]/p[1]', txt: '', up: 'footer'}}
  ]) AS u FROM (SELECT *, length('Customer desk of ' || nation) AS lh, length(segment) AS ls, length(nation) AS ln, length(name) AS lt, length(first_p) AS l1, length(last_p) AS l2, list_sum(list_transform(more, lambda x: length(x))) AS lm FROM cards))
  UNION ALL
  SELECT page, k, e, host, 11 + i, 11 + i, 9, 3, 'p', 1 + i, 1 + i, 0, '', '', more[i], length(more[i]), 0, '{_B}/main[1]/p[' || (1 + i)::VARCHAR || ']', '', 'main' FROM cards, unnest(range(1, e + 1)) AS t(i)
)"""
_ALL = "array_to_string(list_concat(list_concat([name, first_p], more), [last_p]), '{}')"
_MAIN_MD = "('# ' || name || chr(10) || chr(10) || array_to_string(list_concat(list_concat([first_p], more), [last_p]), chr(10) || chr(10)))"
_BLOCKS = f"""blocks AS (
  SELECT page, host, u.* FROM (SELECT *, unnest([
    {{ord: 0, role: 'Title', confidence: 0.95, txt: name, xpath: '{_B}/main[1]/h1[1]', density: 0.0, links: 0}},
    {{ord: 1, role: 'Header', confidence: 0.7, txt: 'Customer desk of ' || nation, xpath: '{_B}/header[1]', density: 0.0, links: 0}},
    {{ord: 2, role: 'PrimaryNavigation', confidence: 0.85, txt: segment || nation, xpath: '{_B}/nav[1]', density: 1.0, links: 2}},
    {{ord: 3, role: 'MainContent', confidence: 0.92, txt: {_ALL.format('')}, xpath: '{_B}/main[1]', density: 0.0, links: 0}},
    {{ord: 4, role: 'Footer', confidence: 0.9, txt: 'Customer desk, all rights reserved', xpath: '{_B}/footer[1]', density: 0.0, links: 0}}
  ]) AS u FROM cards)
)"""
_MARKED = f"marked AS (SELECT *, {_MAIN_MD} AS body, '# ' || name || chr(10) || chr(10) || {_MAIN_MD} || chr(10) AS md FROM cards)"
_ORDER = "ordered AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY k) AS nr, count(*) OVER (PARTITION BY host) AS total, min(k) OVER (PARTITION BY host) AS first_k FROM html)"
_ROLES = [("Title", "h1", "", 0.95, "h1"), ("Header", "header", "", 0.7, "header"), ("PrimaryNavigation", "nav", "", 0.85, "nav"), ("MainContent", "main", "card", 0.92, "main#card"), ("Footer", "footer", "", 0.9, "footer")]
_RULE_ROWS = "rule_rows AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}, '{e}')" for a, b, c, d, e in _ROLES) + ") AS t(role, leaf, leaf_id, confidence, css))"
_DAYS = "(epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') - {}) / 86400000000.0"
_LATEST = """latest AS (
  SELECT * FROM (SELECT *, store_id || '/' || template_id AS name, row_number() OVER (PARTITION BY store_id, template_id ORDER BY file_seq DESC, version_number DESC, last_seen DESC NULLS LAST) AS r FROM templates WHERE template_id IS NOT NULL)
  WHERE r = 1 AND last_seen IS NOT NULL AND host_hash IS NOT NULL
)"""
_HEXNUM = "('0x' || {})::UBIGINT"
_LE32 = "(('0x' || substr(h, {0} + 6, 2) || substr(h, {0} + 4, 2) || substr(h, {0} + 2, 2) || substr(h, {0}, 2))::BIGINT)"
_LE64 = "('0x' || " + " || ".join(f"substr(h, off_ + 8 + 2 * size + {k}, 2)" for k in range(14, -2, -2)) + ")::UBIGINT"
_VECTORS = f"""raw AS (SELECT name, '*' AS host, hex(pq_gram_vector) AS h, observation_count, last_seen FROM latest WHERE octet_length(pq_gram_vector) > 4),
walk AS (
  SELECT name, h, {_LE32.format('1')} AS n, 0 AS i, 9 AS off_, {_LE32.format('9')} AS size FROM raw
  UNION ALL
  SELECT name, h, n, i + 1, off_ + 8 + 2 * size + 16, CASE WHEN i + 1 < n THEN {_LE32.format('(off_ + 8 + 2 * size + 16)')} END FROM walk WHERE i + 1 < n
),
bits AS (SELECT name, decode(unhex(substr(h, off_ + 8, 2 * size))) AS gram, {_LE64} AS v FROM walk WHERE size IS NOT NULL AND n > 0),
grams AS (
  SELECT name, gram, CASE WHEN v >> 63 = 1 THEN -1.0 ELSE 1.0 END * (1.0::DOUBLE + (v & 4503599627370495)::DOUBLE / 4503599627370496.0) * pow(2.0::DOUBLE, ((v >> 52) & 2047)::INTEGER - 1023) AS w FROM bits
)"""
_STORED_RULES = """blobs AS (SELECT DISTINCT store_id, file_seq, template_id, ltrim(decode(extractor_blob), chr(65279)) AS j FROM templates WHERE extractor_blob IS NOT NULL AND json_valid(ltrim(decode(extractor_blob), chr(65279)))),
rules AS (SELECT DISTINCT ON (obs_id) * FROM (
  SELECT store_id || '/' || file_seq::VARCHAR || '/' || template_id || '/' || json_extract_string(r, '$.ruleId') AS obs_id, store_id AS host, file_seq, json_extract_string(r, '$.role') AS role, json_extract(r, '$.claims') AS claims
  FROM (SELECT *, unnest(CASE WHEN json_type(j, '$.rules') = 'ARRAY' THEN json_extract(j, '$.rules[*]') ELSE [] END) AS r FROM blobs)
  WHERE json_type(r, '$.ruleId') = 'VARCHAR' AND starts_with(json_extract_string(r, '$.ruleId'), 'r') AND json_type(r, '$.role') IN ('UBIGINT', 'BIGINT') AND json_type(r, '$.claims') = 'ARRAY' AND json_array_length(r, '$.claims') > 0)),
positions AS (SELECT obs_id, host, role, json_array_length(claims)::INTEGER - 1 - i::INTEGER AS pos, json_extract(claims, '$[' || i::VARCHAR || ']') AS c FROM rules, unnest(range(json_array_length(claims)::BIGINT)) AS t(i)),
features AS (
  SELECT role, pos, 'tag' AS feature, '' AS name, json_extract_string(c, '$.tag') AS value FROM positions
  UNION ALL SELECT role, pos, 'id', '', json_extract_string(c, '$.id') FROM positions
  UNION ALL SELECT role, pos, 'class', '', value FROM (SELECT DISTINCT obs_id, role, pos, unnest(CASE WHEN json_type(c, '$.classes') = 'ARRAY' THEN json_extract_string(c, '$.classes[*]') ELSE [] END) AS value FROM positions)
  UNION ALL SELECT role, pos, 'data', key, json_extract_string(c, '$.data."' || key || '"') FROM (SELECT role, pos, c, unnest(CASE WHEN json_type(c, '$.data') = 'OBJECT' THEN json_keys(c, '$.data') ELSE [] END) AS key FROM positions)
),
frequency AS (SELECT role, pos, feature, name, value, count(*) AS n FROM features WHERE value IS NOT NULL GROUP BY ALL)"""

SQL: dict[str, str] = {
    "card_pages": f"""WITH {_CARDS} SELECT page, host, 'https://' || host || '/customers/' || page AS url, at_ AS "at", md5(html) AS html FROM html""",
    "card_nodes": f"""WITH {_CARDS}, {_NODES}
SELECT page, pre::INTEGER AS pre, "end"::INTEGER AS "end", parent::INTEGER AS parent, depth::INTEGER AS depth, tag, nth::INTEGER AS nth, sib::INTEGER AS sib_idx, kids::INTEGER AS n_children, id, cls AS classes, md5(own) AS own_text,
  n::INTEGER AS text_len, n::INTEGER AS text_trim_len, link::INTEGER AS link_len, (n - link)::INTEGER AS prose_len, xpath FROM nodes""",
    "card_inside": f"""WITH {_CARDS}, {_NODES}
SELECT a.page, a.pre::INTEGER AS pre, a.tag, count(*) AS elements, sum(CASE WHEN b.tag = 'p' THEN b.n ELSE 0 END)::BIGINT AS paragraphs FROM nodes a JOIN nodes b ON a.page = b.page AND b.pre > a.pre AND b.pre <= a."end" GROUP BY ALL""",
    "card_blocks": f"WITH {_CARDS}, {_BLOCKS} SELECT page, ord::INTEGER AS ord, role, confidence::DOUBLE AS confidence, txt AS text, xpath, length(txt)::INTEGER AS text_length, density::DOUBLE AS link_density, links::INTEGER AS links FROM blocks",
    "card_markdown": f"WITH {_CARDS}, {_MARKED} SELECT page, 5::INTEGER AS n_blocks, name AS title, md AS markdown FROM marked",
    "card_renders": f"""WITH {_CARDS}, {_MARKED} SELECT page, CASE WHEN k % 2 = 1 THEN 'rendered' ELSE 'static' END AS used, md AS markdown FROM marked""",
    "card_registered": f"""WITH {_CARDS}, {_ORDER} SELECT host, page AS template_id, 16::BIGINT AS bands, 16::BIGINT AS numbers FROM ordered WHERE nr = 1 AND regexp_extract(host, '([0-9]+)', 1)::INTEGER % 2 = 1""",
    "card_results": f"""WITH {_CARDS}, {_MARKED} SELECT '{{"page":"' || page || '","title":"' || name || '","markdown":"' || replace(md, chr(10), '\\n') || '"}}' AS value FROM marked""",
    "card_features": f"""WITH {_CARDS}, {_NODES}, kids AS (SELECT page, parent, count(*) AS m FROM nodes GROUP BY ALL), same AS (SELECT page, parent, tag, count(*) AS s FROM nodes GROUP BY ALL),
texts AS (SELECT a.page, a.pre, string_agg(b.own, '' ORDER BY b.pre) AS txt FROM nodes a JOIN nodes b ON a.page = b.page AND b.pre >= a.pre AND b.pre <= a."end" GROUP BY ALL)
SELECT page, xpath, tag, n::INTEGER AS text_len, txt AS text, round(link::DOUBLE / n, 4) AS link_density, (tag = 'main')::INTEGER AS tag_main, (tag = 'nav')::INTEGER AS tag_nav, (tag NOT IN ('main', 'nav', 'header', 'footer'))::INTEGER AS tag_other, depth::INTEGER AS depth,
  m::INTEGER AS siblings, (s - 1)::INTEGER AS same_tag, (xpath LIKE '%/main[1]/%')::INTEGER AS in_main, (xpath LIKE '%/nav[1]/%')::INTEGER AS in_nav
FROM (SELECT nodes.*, t.txt AS txt_ FROM nodes JOIN texts t USING (page, pre)) x JOIN kids USING (page, parent) JOIN same USING (page, parent, tag) WHERE pre > 0""".replace("txt AS text,", "txt_ AS text,"),
    "card_gold": f"""WITH {_CARDS}, {_NODES} SELECT page, xpath, xpath LIKE '%/main[1]/%' AND n >= 20 AS in_gold FROM nodes WHERE pre > 0""",
    "card_rules": f"WITH {_CARDS}, {_RULE_ROWS} SELECT page, host, role, css AS selectors, confidence::DOUBLE AS confidence, 1::INTEGER AS claims, leaf, leaf_id FROM cards, rule_rows",
    "card_prints": f"WITH {_CARDS} SELECT min(k) AS first, count(*) AS pages, count(DISTINCT host) AS hosts, (13 + e)::INTEGER AS shingles, (13 + e)::INTEGER AS most FROM cards GROUP BY e",
    "card_grams": f"""WITH {_CARDS}, {_NODES},
lists AS (SELECT page, parent, list(tag ORDER BY sib) AS tags FROM nodes GROUP BY ALL),
rows_ AS (SELECT a.page, coalesce(u.tag, '*') || ',' || a.tag AS stem, list_concat(list_concat(['*', '*'], coalesce(l.tags, [])), ['*', '*']) AS r FROM nodes a LEFT JOIN lists l ON l.page = a.page AND l.parent = a.pre LEFT JOIN nodes u ON u.page = a.page AND u.pre = a.parent),
g AS (SELECT page, stem || ',' || r[i] || ',' || r[i + 1] || ',' || r[i + 2] AS gram FROM rows_, unnest(range(1, len(r) - 1)) AS t(i))
SELECT gram, count(DISTINCT page) AS pages, count(*) AS n FROM g GROUP BY gram""",
    "card_learning": f"""WITH {_CARDS}, {_ORDER}, {_MARKED.replace('FROM cards', 'FROM ordered').replace('more)', '[])')}
SELECT host, page, CASE WHEN nr = 1 THEN 'Novel' ELSE 'FastPathHit' END AS status, 1::INTEGER AS version, CASE WHEN nr = 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS similarity, CASE WHEN nr > 1 THEN 1.0::DOUBLE END AS true_jaccard, nr::INTEGER AS observations, 5::INTEGER AS n_blocks, name AS title,
  CASE WHEN nr = 1 THEN 'new-template' END AS event, md5(CASE WHEN nr = 1 THEN md ELSE body || chr(10) || chr(10) || '# ' || name || chr(10) END) AS markdown
FROM marked""",
    "card_frozen": f"""WITH {_CARDS}, {_ORDER}, early AS (SELECT host, count(*) AS n FROM cards WHERE k < 300 GROUP BY host)
SELECT o.host, page, CASE WHEN nr = 1 AND k < 300 THEN 'Novel' WHEN e2.n IS NULL THEN 'NovelEphemeral' ELSE 'FastPathHit' END AS status, least(nr, coalesce(e2.n, 0))::INTEGER AS observations FROM ordered o LEFT JOIN early e2 USING (host)""",
    "card_overrides": f"""WITH {_CARDS}, {_ORDER}
SELECT host, page, CASE WHEN host = 'nation-1.example' THEN 'OperatorOverride' WHEN nr = 1 THEN 'Novel' ELSE 'FastPathHit' END AS status, CASE WHEN host = 'nation-1.example' THEN 'operator:' || host ELSE '' END AS template, CASE WHEN host = 'nation-1.example' THEN 2 ELSE 5 END::INTEGER AS n_blocks FROM ordered""",
    "card_events": f"""WITH {_CARDS}, {_ORDER}
SELECT '{{"Kind":"new-template","EmittedAt":"' || strftime(make_timestamp(at_ * 1000000), '%Y-%m-%dT%H:%M:%S.%f') || 'Z","Payload":{{"host":"' || host || '","page":"' || page || '","new_version":1}}}}' AS value FROM ordered WHERE nr = 1""",
    "card_fast_probe": f"""WITH {_CARDS}, {_ORDER}
SELECT page, first_k::VARCHAR AS template_id, 1.0::DOUBLE AS similarity, round(1.0 + 0.02 * ln(1 + total::DOUBLE) + 0.05 * exp(-({_DAYS.format('(1700000000 + first_k * 60) * 1000000')}) / 30.0), 6) AS score FROM ordered WHERE k <> first_k""",
    "card_slow_probe": f"""WITH {_CARDS}, {_ORDER}
SELECT page, first_k::VARCHAR AS template_id, 1.0::DOUBLE AS similarity, round(1.0 + 0.02 * ln(1 + total::DOUBLE) + 0.05 * exp(-({_DAYS.format('(1700000000 + first_k * 60) * 1000000')}) / 30.0), 6) AS score FROM ordered WHERE k <> first_k""",
    "card_fences": f"""WITH {_CARDS} SELECT page, host, 'Captured' AS verdict, (strpos(html, '<main') - 1)::BIGINT AS capture_start, (strpos(html, '</main>') + 6)::BIGINT AS capture_end FROM html""",
    "card_fence_refits": f"""WITH {_CARDS}, {_ORDER}
SELECT host, page, CASE WHEN nr = 1 THEN 'first' ELSE 'cadence' END AS reason, 1::INTEGER AS version, nr = 1 AS changed FROM ordered WHERE nr = 1 OR (nr - 1) % 10 = 0""",
    "card_links": f"""WITH {_CARDS} SELECT 'https://' || host || '/customers/' || page AS source, 'https://' || host || lower('/segments/' || segment) AS target FROM cards
UNION SELECT 'https://' || host || '/customers/' || page, 'https://' || host || '/nations/' || nk::VARCHAR FROM cards""",
    "card_site_maps": f"""WITH {_CARDS}, {_ORDER}
SELECT 'https://' || host || '/customers/' || page AS root, 3::INTEGER AS pages, '- https://' || host || '/customers/' || page || chr(10) || '  - https://' || host || '/nations/' || nk::VARCHAR || chr(10) || '  - https://' || host || lower('/segments/' || segment) AS markdown FROM ordered WHERE nr = 1""",
    "card_candidates": f"""WITH {_CARDS}, {_RULE_ROWS} SELECT DISTINCT host, role, leaf, leaf_id, 1::INTEGER AS claims, least(1000, (SELECT count(*) FROM cards))::BIGINT AS source_count FROM (SELECT host FROM cards ORDER BY at_ DESC LIMIT 1000), rule_rows""",
    "card_mining_totals": f"""WITH {_CARDS} SELECT 5::BIGINT AS clusters, 5::BIGINT AS mined, count(DISTINCT host) AS hosts, 5 * (SELECT count(DISTINCT host) FROM (SELECT host FROM cards ORDER BY at_ DESC LIMIT 1000))::BIGINT AS candidates FROM cards""",
    "card_outcomes": f"""WITH {_CARDS}, {_RULE_ROWS}, offered AS (SELECT DISTINCT host FROM (SELECT host FROM cards ORDER BY at_ DESC LIMIT 1000))
SELECT host, role, sum(CASE WHEN role = 'MainContent' THEN 1 ELSE -1 END)::BIGINT AS reputation, max(CASE WHEN role = 'MainContent' THEN at_ ELSE 0 END)::BIGINT AS last_won, max(CASE WHEN role <> 'MainContent' THEN at_ ELSE 0 END)::BIGINT AS last_lost FROM cards JOIN offered USING (host), rule_rows GROUP BY ALL""",
    "stored_fast_probe": f"""WITH {_LATEST}, hosts AS (SELECT template_id, min(hex(host_hash)) AS host FROM templates WHERE host_hash IS NOT NULL GROUP BY template_id),
t AS (SELECT name, hex(host_hash) AS host, hex(signature_minhash) AS h, observation_count, last_seen FROM latest WHERE octet_length(signature_minhash) = 512),
o AS (SELECT DISTINCT template_id || '@' || epoch_us(observed_at)::VARCHAR || '@' || md5(signature_minhash) AS page, host, hex(signature_minhash) AS h FROM template_observations JOIN hosts USING (template_id) WHERE octet_length(signature_minhash) = 512),
met AS (SELECT DISTINCT page, name FROM (SELECT page, host, b, substr(h, b * 64 + 1, 64) AS key FROM o, range(16) AS r(b)) x JOIN (SELECT name, host, b, substr(h, b * 64 + 1, 64) AS key FROM t, range(16) AS r(b)) y USING (host, b, key)),
s AS (SELECT page, name, len(list_filter(range(128), lambda i: substr(o.h, i * 8 + 1, 8) = substr(t.h, i * 8 + 1, 8))) / 128.0::DOUBLE AS similarity, observation_count, last_seen FROM met JOIN o USING (page) JOIN t USING (name)),
f AS (SELECT page, name, similarity, similarity + 0.02 * ln(1 + observation_count::DOUBLE) + 0.05 * exp(-({_DAYS.format('epoch_us(last_seen)')}) / 30.0) AS score FROM s WHERE similarity >= 0.85)
SELECT page, name AS template_id, similarity, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round(score, 9) DESC, name) AS r FROM f) WHERE r = 1""",
    "stored_grams": f"WITH RECURSIVE {_LATEST}, {_VECTORS} SELECT name AS template_id, count(*) AS n, round(sqrt(sum(w * w)), 6) AS norm, min(gram) AS first, max(gram) AS last FROM grams WHERE w <> 0 GROUP BY name",
    "stored_slow_probe": f"""WITH RECURSIVE {_LATEST}, {_VECTORS}, norms AS (SELECT name, sqrt(sum(w * w)) AS norm FROM grams GROUP BY name), named AS (SELECT g.*, r.host FROM grams g JOIN raw r USING (name)),
dots AS (SELECT a.name AS page, b.name, sum(a.w * b.w) AS dot FROM named a JOIN named b ON a.host = b.host AND a.gram = b.gram AND a.name <> b.name GROUP BY ALL),
s AS (SELECT page, d.name, dot / (x.norm * y.norm) AS similarity, observation_count, last_seen FROM dots d JOIN norms x ON x.name = page JOIN norms y ON y.name = d.name JOIN raw r ON r.name = d.name),
f AS (SELECT page, name, similarity, similarity + 0.02 * ln(1 + observation_count::DOUBLE) + 0.05 * exp(-({_DAYS.format('epoch_us(last_seen)')}) / 30.0) AS score FROM s WHERE similarity >= 0.75)
SELECT page, name AS template_id, round(similarity, 6) AS similarity, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round(score, 9) DESC, name) AS r FROM f) WHERE r = 1""",
    "stored_claim_frequency": f"WITH {_STORED_RULES} SELECT role, pos::INTEGER AS pos, feature, name, value, n FROM frequency",
    "stored_clusters": f"WITH {_STORED_RULES} SELECT role, sum(n)::BIGINT AS n, count(*) AS hosts, max(n) AS most FROM (SELECT role, host, count(*) AS n FROM rules GROUP BY ALL) GROUP BY role",
    "stored_chains": f"""WITH {_STORED_RULES}, total AS (SELECT role, count(*) AS total FROM rules GROUP BY role HAVING count(*) >= 3),
kept AS (SELECT f.*, total FROM frequency f JOIN total USING (role) WHERE n >= ceil(total * 0.1 - 1e-9) AND feature = 'tag'),
best AS (SELECT role, total, pos, arg_max(value, (lpad(n::VARCHAR, 12, '0') || value)) AS tag FROM kept GROUP BY ALL),
run AS (SELECT role, total, pos, tag, row_number() OVER (PARTITION BY role ORDER BY pos) - 1 AS i FROM best)
SELECT role, total AS n, count(*)::INTEGER AS claims, max(CASE WHEN pos = 0 THEN tag END) AS leaf FROM run WHERE pos = i GROUP BY role, total""",
    "order_report": """
WITH o AS (SELECT o_orderstatus AS w, CASE WHEN o_totalprice > 150000 THEN 'F' WHEN o_totalprice > 80000 THEN 'O' ELSE 'P' END AS g FROM orders),
l AS (SELECT w AS label FROM o UNION SELECT g FROM o),
c AS (SELECT label, (SELECT count(*) FROM o WHERE w = label) AS support, (SELECT count(*) FROM o WHERE g = label) AS given, (SELECT count(*) FROM o WHERE w = label AND g = label) AS hit FROM l)
SELECT label, support::BIGINT AS support, round(hit / given::DOUBLE, 9) AS precision, round(hit / support::DOUBLE, 9) AS recall, round(2.0 * hit / (given + support), 9) AS f1 FROM c""",
    "import_counts": """
WITH new AS (SELECT DISTINCT store_id, template_id FROM templates WHERE template_id IS NOT NULL), old AS (SELECT DISTINCT store_id, template_id, true AS there FROM templates WHERE file_seq = 1)
SELECT store_id, sum(CASE WHEN there THEN 0 ELSE 1 END)::BIGINT AS imported, sum(CASE WHEN there THEN 1 ELSE 0 END)::BIGINT AS replaced, 0::BIGINT AS refused FROM new LEFT JOIN old USING (store_id, template_id) GROUP BY store_id
UNION ALL SELECT 'other', 0, 0, 1""",
    "store_formats": """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY store_id, template_id ORDER BY file_seq DESC, version_number DESC, last_seen DESC NULLS LAST) AS k FROM templates WHERE template_id IS NOT NULL)
SELECT store_id, template_id, version_number FROM l WHERE k = 1 AND version_number > 1""",
    "candidate_upserts": f"""WITH {_STORED_RULES}, side AS (SELECT host, file_seq, role, json_extract_string(claims, '$[#-1].tag') AS target FROM rules)
SELECT DISTINCT host, role, target FROM side s WHERE NOT EXISTS (SELECT 1 FROM side f WHERE f.file_seq = 1 AND f.host = s.host AND f.role = s.role AND f.target = s.target)""",
}
SQL["card_outlines"] = f"""WITH {_CARDS},
s AS (SELECT *, unnest([
  {{s: 'body.desk', w: length('Customer desk of ' || nation) + length(segment) + length(nation) + length({_ALL.format('')}) + 34 - 40}}, {{s: '#card', w: length({_ALL.format('')})}}, {{s: 'main', w: length({_ALL.format('')})}},
  {{s: 'header', w: length('Customer desk of ' || nation)}}, {{s: 'nav', w: length(segment) + length(nation) - 40}}, {{s: 'footer', w: 34}}]) AS u FROM cards)
SELECT page, array_to_string(list_concat(list_concat(['body.desk', '  header', '    p: Customer desk of ' || nation, '  nav', '    ul', '      li', '        a: ' || segment, '      li', '        a: ' || nation, '  main#card', '    h1: ' || name, '    p: ' || left(first_p, 120)],
    list_transform(more, lambda x: '    p: ' || x)), ['    p: ' || left(last_p, 120), '  footer', '    p: Customer desk, all rights reserved']), chr(10)) AS skeleton,
  '[' || string_agg('{{"selector":"' || u.s || '","n":1,"weight":' || u.w::VARCHAR || '.0}}', ',' ORDER BY u.w DESC, u.s) || ']' AS selectors
FROM s GROUP BY page, nation, segment, name, first_p, more, last_p"""
SQL["card_tags"] = f"""WITH {_CARDS},
t AS (SELECT page, regexp_extract_all(html, '</?[a-z][a-z0-9]*[^>]*>') AS tag, regexp_split_to_array(html, '</?[a-z][a-z0-9]*[^>]*>') AS gap FROM html),
u AS (SELECT page, i, tag[i] AS tag, length(gap[i]) AS gap FROM t, unnest(range(1, len(tag) + 1)) AS r(i)),
p AS (SELECT *, sum(gap + length(tag)) OVER (PARTITION BY page ORDER BY i) AS stop FROM u)
SELECT page, (i - 1)::INTEGER AS k, regexp_extract(tag, '^</?([a-z0-9]+)', 1) AS name, starts_with(tag, '</') AS closing, (stop - length(tag))::BIGINT AS "begin", stop::BIGINT AS "end",
  CASE WHEN strpos(tag, '="') > 0 THEN replace(regexp_extract(tag, ' (.*)>$', 1), '"', '') ELSE '' END AS attrs, bool_or(tag = '<h1>') OVER (PARTITION BY page ORDER BY i) AS tripped FROM p"""

QUERIES = (
    card_pages, card_nodes, card_inside, card_blocks, card_markdown, card_renders, card_registered, card_results, card_outlines, card_features, card_gold, card_rules, card_prints, card_grams, card_learning, card_frozen, card_overrides, card_events,
    card_fast_probe, card_slow_probe, card_fences, card_fence_refits, card_tags, card_links, card_site_maps, card_candidates, card_mining_totals, card_outcomes, stored_fast_probe, stored_slow_probe, stored_grams,
    stored_claim_frequency, stored_clusters, stored_chains, stored_medoid_distance, order_report, import_counts, store_formats, candidate_upserts,
)
