"""Core operators on Spark: small tables, awkward rows, brute force, and agreement between formulations."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pageloom import queries
from pageloom.html.shred import Dom
from pageloom.operators import evaluate, extract, fingerprint, learn, mining, skeleton, stores
from pageloom.operators.fingerprint import gram_counts
from pageloom.plans import schema_drift
from pageloom.sources import pages as sources
from pageloom.streaming import jobs
from pageloom.streaming.fence import scan

WORDS = "some words of a longer text that goes on " * 12
PAGE = f"<header><nav class=main-nav><a href=/a>A</a><a href=/b>B</a><a href=/c>C</a></nav></header><main><article><h1>Title</h1><p>{WORDS}</p><p>{WORDS}</p></article></main><footer>© 2026 X. All rights reserved</footer>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    data = [(f"p{k}", "H.test" if k < 4 else None, PAGE.replace("longer", f"longer{k}"), f"2025-01-0{k + 1} 00:00:00") for k in range(6)] + [("e", "h.test", None, "2025-02-01 00:00:00"), ("s", "h.test", "", None), (None, "h.test", PAGE, None)]
    return spark.createDataFrame([(*d, "clash") for d in data], "id string, host string, html string, at string, page string").withColumn("at", F.to_timestamp("at"))


def test_learning_in_batch(spark, pages):
    got = {r["page"]: r for r in learn.learned(pages.unionByName(pages), "id", "host", "html", "at").collect()}
    assert len(got) == 8 and got["p0"]["status"] == "Novel" and [got[f"p{k}"]["status"] for k in (1, 2, 3)] == ["FastPathHit"] * 3
    assert got["p0"]["template_id"] == got["p3"]["template_id"] and got["p4"]["status"] == "Novel" and got["p0"]["title"] == "Title"
    again = {r["page"]: tuple(r) for r in learn.learned(pages.repartition(7), "id", "host", "html", "at").collect()}
    assert again == {k: tuple(v) for k, v in got.items()}
    assert learn.learned(pages.limit(0), "id", "host", "html", "at").count() == 0
    assert {r["status"] for r in learn.learned(pages, "id", "host", "html", "at", learn=False).collect()} == {"NovelEphemeral"}
    assert learn.events(learn.learned(pages, "id", "host", "html", "at")).where("kind = 'new-template'").count() >= 2


def test_stream_equals_batch(spark, pages, tmp_path):
    source = pages.where("id LIKE 'p%' AND host IS NOT NULL").select(F.lower("host").alias("host"), F.col("id").alias("page"), "at", F.col("html").alias("source"))
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = jobs.learn_stream(stream).writeStream.format("memory").queryName("learned").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination(120)
    batch = learn.learned(pages.where("id LIKE 'p%' AND host IS NOT NULL"), "id", "host", "html", "at")
    columns = ["host", "page", "status", "template_id", "version", "observations"]
    assert rows(spark.table("learned").select(*columns)) == rows(batch.select(*columns))


def test_scan_stream_with_chunks_out_of_order(spark, tmp_path):
    blob = json.dumps({"Host": "h", "PrefixPattern": {"TagName": "header"}, "ContentStartPattern": {"TagName": "div", "RequiredAttributes": [{"Name": "id", "Value": "c"}]}, "ContentEndPattern": {"TagName": "div", "IsClose": True}})
    data = b"<header></header><p>x</p><div id='c'>hello <div>in</div> out</div><footer>"
    chunks = [("s", "h", blob, k, data[k * 7 : k * 7 + 7], k * 7 + 7 >= len(data)) for k in range(-(-len(data) // 7))][::-1] + [("n", "h", None, 0, b"x", True)]
    df = spark.createDataFrame(chunks, "stream_id string, host string, template string, seq int, chunk binary, is_last boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.scan_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("scanned").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    verdict, a, b = scan(jobs.template_of(json.loads(blob)), data)
    assert verdict == "Captured" and rows(spark.table("scanned")) == [("n", "h", "NoTemplate", -1, -1), ("s", "h", verdict, a, b)]


def test_blocks_profiles_and_functions(spark, pages):
    blocks = extract.blocks(pages, "id", "html")
    assert {r["role"] for r in blocks.where("page = 'p0'").collect()} == {"Title", "PrimaryNavigation", "MainContent", "Footer"}
    text = {p: extract.markdown(pages, "id", "html", p).where("page = 'p0'").first()["markdown"] for p in ("RagFull", "MainContentOnly", "AgentNavigation", "DebugFull", "Sitemap", "Wcxb")}
    assert text["RagFull"].startswith("# Title") and "All rights" not in text["RagFull"] and "- [A](/a)" in text["AgentNavigation"] and "<!-- Footer -->" in text["DebugFull"] and all(t.endswith("\n") for t in text.values())
    with pytest.raises(ValueError):
        extract.markdown(pages, "id", "html", "Nope")
    extract.register(spark)
    assert spark.sql("SELECT html_title('<h1>T') AS t, is_stable_class('p-4') AS s, html_to_markdown('<h2>x') AS m").first()[:] == ("T", False, "## x\n")
    assert spark.sql("SELECT role FROM html_blocks('<h1>T</h1>')").first()[0] == "Title"
    own = extract.overridden(pages, "id", "host", "html", [{"host": "h.TEST", "deterministic": False, "rules": [{"role": "Footer", "selectors": ["footer"], "confidence": 1.0, "chain": []}]}])
    assert {r["role"] for r in own.where("page = 'p0'").select(F.explode("blocks").alias("b")).select("b.*").collect()} == {"Footer", "Title"}


def test_catalyst_grams_equal_the_kernel(spark, pages):
    nodes = extract.dom_nodes(pages.where("id = 'p0'"), "id", "html")
    got = {r["gram"]: r["n"] for r in fingerprint.node_grams(nodes).collect()}
    assert got == dict(gram_counts(Dom.of(PAGE.replace("longer", "longer0"))))
    inside = nodes.alias("d").join(nodes.alias("a"), F.col("d.page") == F.col("a.page")).where("d.pre > a.pre AND d.pre <= a.end AND a.tag = 'article'")
    assert inside.count() == 3


def test_probes(spark, pages):
    prints = fingerprint.fingerprints(pages.where("host IS NOT NULL"), "id", "host", "html").dropDuplicates(["page"])
    templates = prints.where("page IN ('p0', 'e')").select(F.col("page").alias("template_id"), "host", "minhash", "bands", "grams", F.lit(3).alias("observation_count"), F.to_timestamp(F.lit("2025-01-01")).alias("last_seen"))
    as_of = F.to_timestamp(F.lit("2025-01-31"))
    fast = {r["page"]: r for r in fingerprint.fast_probe(prints, templates, as_of).collect()}
    slow = {r["page"]: r for r in fingerprint.slow_probe(prints, templates, as_of).collect()}
    assert fast["p3"]["template_id"] == slow["p3"]["template_id"] == "p0" and fast["p3"]["similarity"] == 1.0 and slow["p3"]["similarity"] == pytest.approx(1.0)
    both = prints.alias("a").crossJoin(prints.alias("b")).where("a.page = 'p0' AND b.page = 'e'").select(fingerprint.cosine(F.col("a.grams"), F.col("b.grams")).alias("c")).first()
    assert both["c"] < 0.75
    one = spark.createDataFrame([(0.85, 2, 0.0, 0.07), (0.85, 50, 7.0, 0.12), (0.85, 10000, 180.0, 0.19), (0.85, 3, 180.0, 0.03)], "s double, n int, d double, want double")
    assert all(abs(r["v"] - r["want"]) < 0.015 for r in one.select((fingerprint.aging(F.col("s"), F.col("n"), F.col("d")) - F.col("s")).alias("v"), "want").collect())


def claims(*items):
    return [{"tag": t, "id": i, "classes": c, "data": {}, "aria": {}, "role": None} for t, i, c in items]


def test_mining(spark):
    schema = f"obs_id string, host string, bucket int, role string, claims array<{mining.CLAIM}>, target long, cardinality int, confidence double, induced_at timestamp"
    when = datetime(2025, 1, 1)
    data = [(f"o{k}", f"h{k}", 1, "MainContent", claims(("body", None, []), ("main", "x" if k < 4 else None, ["entry", f"c{k}"])), 1, 1, 0.9, when) for k in range(5)]
    data += [("far", "h9", 1, "MainContent", claims(("div", "zzz", [])), 1, 1, 0.9, when), ("two", "h0", 2, "Footer", claims(("footer", None, [])), 1, 1, 0.9, when)]
    obs = spark.createDataFrame(data, schema)
    stable = mining.stable_chains(obs).collect()
    assert len(stable) == 1 and stable[0]["claims"][-1]["tag"] == "main" and stable[0]["claims"][-1]["classes"] == ["entry"] and stable[0]["claims"][-1]["id"] is None
    assert mining.medoids(obs).first()["obs_id"] in {f"o{k}" for k in range(5)} and rows(mining.outliers(obs).select("obs_id")) == [("far",)]
    made = mining.candidates(obs)
    assert made.count() == 6 and mining.candidates(obs, made).count() == 0 and mining.candidates(obs.limit(0)).count() == 0
    log = spark.createDataFrame([("c", True, when), ("c", True, when), ("c", False, when)], "candidate_id string, won boolean, at timestamp")
    assert mining.reputation(log).first()["reputation"] == 1


def blob(**k):
    return json.dumps(k).encode()


def test_edit_scripts():
    old = {"a": "number", "b": "object", "b.c": "string", "b.d": "string", "l": "array", "l[].x": "number"}
    new = {"a": "string", "b2": "object", "b2.c": "string", "b2.d": "string", "l": "array", "l[].y": "number", "l[].z": "number"}
    same = {("b", "b2"): 1.0, ("l[].x", "l[].y"): 0.95, ("l[].x", "l[].z"): 0.91}
    assert sorted(schema_drift.edit_script(old, new, same)) == [("added", "", "l[].z"), ("renamed", "b", "b2"), ("renamed", "l[].x", "l[].y"), ("type_changed", "a", "a")]
    assert sorted(schema_drift.edit_script(old, new, {("l[].x", "l[].y"): 0.5})) == [("added", "", "b2"), ("added", "", "l[].y"), ("added", "", "l[].z"), ("removed", "b", ""), ("removed", "l[].x", ""), ("type_changed", "a", "a")]
    assert schema_drift.edit_script({}, {}) == [] and schema_drift.assign([[4, 1], [2, 8]]) == [1, 0]


def test_schema_changes(spark):
    data = []
    for k in range(20):
        data += [("s", 1, f"t{k}", blob(Host=f"h{k}", N=k, Notes="x" if k < 2 else None, Budget={"v": k}))] * (1 + k % 3)
        data.append(("s", 2, f"t{k}", b"\xef\xbb\xbf" + blob(Budget={"v": k}, HostName=f"h{k}", N=str(k), Few="y" if k < 1 else None)))
        data.append(("s", 4, f"t{k}", blob(Other=1)))
    data += [("s", 1, "bad", b'{"Host": "cut'), ("s", 1, "nan", b'{"Q": NaN}'), ("s", 2, "none", None), ("s", 1, None, blob(Z=1)), (None, 1, "t", blob(Z=1)), ("only", 1, "t", blob(A=1)), ("list", 1, "t", b"[]"), ("list", 2, "t", b'"x"')]
    df = spark.createDataFrame([(*d, "clash") for d in data], "store_id string, file_seq int, template_id string, template_blob binary, path string")
    blobs = schema_drift.blobs_of(df, "streaming_templates", "template_blob")
    changes = schema_drift.schema_changes(blobs)
    assert rows(changes) == [("streaming_templates", "s", 2, "removed", "Notes", ""), ("streaming_templates", "s", 2, "renamed", "Host", "HostName"), ("streaming_templates", "s", 2, "type_changed", "N", "N")]
    assert schema_drift.schema_changes(blobs.limit(0)).count() == 0
    table = {(r["file_seq"], r["template_id"]): r for r in schema_drift.unify(blobs, changes, ["Host", "N"]).where("store_id = 's'").collect()}
    assert table[1, "t3"]["Host"] == table[2, "t3"]["Host"] == '"h3"' and json.loads(table[2, "t3"]["rest"]) == {"Budget": {"v": 3}, "Few": None} and table[1, "bad"]["Host"] is None
    assert schema_drift.rewrite({"r": [{"b": 1}, {"b": 2}]}, [("r[].a", "r[].b")]) == {"r": [{"a": 1}, {"a": 2}]}


def test_template_table_undoes_nested_renames(spark, tmp_path):
    """p4_template_table: renames under arrays and maps are undone in the query over templates.extractor_blob."""
    data = []
    for k in range(20):
        data.append(("s", 1, f"t{k}", blob(templateId=f"t{k}", version=1, rules=[{"role": k, "cssSelectors": ["a"]}], centroid={"byRole": {"Footer": {"meanDepth": k + 0.5}}}, notes="n")))
        data.append(("s", 2, f"t{k}", blob(templateId=f"t{k}", version=1, rules=[{"blockRole": k, "cssSelectors": ["a"]}], centroid={"byRole": {"Footer": {"depth": k + 0.5}}}, notes="n", quality=k)))
    data.append(("s", 2, "bad", b"{"))
    columns = "store_id string, file_seq int, template_id string, "
    spark.createDataFrame(data, columns + "extractor_blob binary").write.parquet(f"{tmp_path}/templates.parquet")
    spark.createDataFrame([], columns + "template_blob binary").write.parquet(f"{tmp_path}/streaming_templates.parquet")
    table = {(r["file_seq"], r["template_id"]): r for r in queries.queries()["p4_template_table"](spark, str(tmp_path)).collect()}
    assert len(table) == 41 and table[2, "bad"]["rules"] is None and table[2, "t3"]["rest"] == '{"quality":3}'
    assert table[1, "t3"]["rules"] == table[2, "t3"]["rules"] and json.loads(table[2, "t3"]["rules"]) == [{"role": 3, "cssSelectors": ["a"]}]
    assert table[1, "t3"]["centroid"] == table[2, "t3"]["centroid"] == '{"byRole":{"Footer":{"meanDepth":3.5}}}'


def test_paths():
    got = [p for p, _ in schema_drift.walk({"centroid": {"byRole": {"Footer": {"n": 1}}}, "rules": [{"claims": [{"data": {"k": "v"}, "tag": "a"}], "role": None}], "l": [1]})]
    assert got == ["centroid", "centroid.byRole", "centroid.byRole{}.n", "rules", "rules[].claims", "rules[].claims[].data", "rules[].claims[].tag", "l"]
    assert schema_drift.parent_of("rules[].claims[].tag") == "rules[].claims" and schema_drift.canonical({"b": 1.0, "a": [2.5]}) == '{"a":[2.5],"b":1}'


def test_evaluation(spark):
    df = spark.createDataFrame([(1, "a b b c", "b b c d"), (2, None, None), (3, "x", None), (4, "", "y")], "id int, p string, g string")
    got = {r["id"]: (r["precision"], r["recall"], r["f1"]) for r in evaluate.word_f1(df, "id", "p", "g").collect()}
    assert got == {1: (0.75, 0.75, 0.75), 2: (1.0, 1.0, 1.0), 3: (0.0, 0.0, 0.0), 4: (0.0, 0.0, 0.0)}
    values = spark.createDataFrame([(v,) for v in range(1, 11)], "v int")
    assert evaluate.nearest_rank(values, [], "v").first()[:] == (5, 9, 10, 10)


def test_stores(spark, data):
    t = spark.read.parquet(f"{data}/templates.parquet")
    out = stores.import_bundle(stores.export_bundle(t))
    assert out.count() == t.select("template_id").distinct().count()
    assert stores.import_bundle(stores.export_bundle(t), out).count() == out.count()
    assert stores.import_bundle(spark.createDataFrame([('{"schemaVersion":2,"template_id":"x"}',)], "value string")).count() == 0
    jobs_ = spark.createDataFrame([("h", "Induce", "2025-01-01 00:10:00"), ("h", "Induce", "2025-01-01 00:20:00"), ("h", "Repair", "2025-01-01 00:20:00"), ("h", "Induce", "2025-01-01 01:20:00")], "host string, kind string, at string").withColumn("at", F.to_timestamp("at"))
    assert stores.cooled(jobs_, ["host", "kind"], "at").count() == 3
    seen = spark.createDataFrame([("t", f"2025-01-0{1 + k // 3} 00:00:0{k}", "2025-01-01", s) for k, s in enumerate([0.5, 0.9, 0.5, 0.5, 0.5, 0.5, 0.9])], "template_id string, observed_at string, loaded_at string, similarity_at_match double").withColumn("observed_at", F.to_timestamp("observed_at")).withColumn("loaded_at", F.to_timestamp("loaded_at"))
    assert stores.longest_drift(seen, 0.85).first()["longest"] == 4
    want = 0.5
    for s in [0.9, 0.5, 0.5, 0.5, 0.5, 0.9]:
        want = 0.2 * (1 - s) + 0.8 * want
    assert stores.drift_average(seen).first()["ewma"] == pytest.approx(want)


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x")
    (tmp_path / "list.txt").write_text("# no\n\nhttp://a.test/\n")
    assert rows(sources.from_folder(spark, str(tmp_path / "a.html")).select("host", "html")) == [("file:a", "<p>x")]
    assert rows(sources.addresses(spark, str(tmp_path / "list.txt"))) == [("http://a.test/",)]
    for name in ("ground-truth", "html"):
        (tmp_path / "dev" / name).mkdir(parents=True)
    (tmp_path / "dev/ground-truth/1.json").write_text(json.dumps({"file_id": "1", "url": "u", "_internal": {"page_type": {"primary": "article"}}, "ground_truth": {"main_content": "m", "with": ["a"], "without": []}}))
    (tmp_path / "dev/html/1.html").write_text("<p>m")
    assert sources.labelled_corpus(spark, str(tmp_path), "dev", "article").first()["html"] == "<p>m"
    spark.dataSource.register(sources.fetching_source("fixture_pages", ["http://a/", "http://b/"], {"http://a/": "<p>1"}.get, 2))
    assert rows(spark.read.format("fixture_pages").load()) == [("http://a/", "<p>1"), ("http://b/", None)]
    two = spark.createDataFrame([("short", "<main><p>x</p></main>", PAGE, "clash"), ("long", PAGE, "<p>y", "clash"), ("none", None, "", "clash"), ("worse", "<main><p>some few words</p></main>", "<p>z", "clash"), (None, PAGE, PAGE, "clash")], "id string, a string, b string, rendered string")
    got = {r["page"]: r for r in extract.best_render(two, "id", "a", "b").collect()}
    assert {k: r["used"] for k, r in got.items()} == {"short": "rendered", "long": "static", "none": "static", "worse": "static"} and got["short"]["markdown"] == got["long"]["markdown"] and got["none"]["markdown"] == "\n"


def test_site_map(spark):
    links = spark.createDataFrame([("http://a/", "http://a/1"), ("http://a/1", "http://a/2"), ("http://a/1", "http://b/"), ("http://a/2", "http://a/"), ("http://a/2", "http://a/3")], "source string, target string")
    seeds = spark.createDataFrame([("http://a/",)], "url string")
    assert rows(skeleton.site_map(links, seeds, 2)) == [("http://a/", "http://a/", 0), ("http://a/", "http://a/1", 1), ("http://a/", "http://a/2", 2)]


def test_band_pairs_against_brute_force(spark, tmp_path):
    """band_probe's whole job: every pair of pages that share a band, also those of which neither is the first of its bucket."""
    pages = []
    for k in range(9):
        own = "".join(f"<{t}><b></b><i></i></{t}>" for t in ("ul", "ol", "dl", "nav", "pre", "em", "dfn", "kbd", "sup")[: 1 + k % 6])
        pages.append((f"p{k}", "H.test" if k < 8 else None, "<div><p><a></a></p></div><table><tr><td><h1></h1></td></tr></table><main><section><h2></h2></section></main>" + own))
    spark.createDataFrame(pages, "file_id string, host string, html string").write.parquet(f"{tmp_path}/wcxb_samples.parquet")
    q, marks = queries.queries(), {}
    for r in q["minhash_sql"](spark, str(tmp_path)).collect():
        marks.setdefault(r["file_id"], {})[r["slot"]] = r["mark"]
    del marks["p8"]
    slots = {k: [m[i] for i in range(16)] for k, m in marks.items()}
    band = lambda a, b: any(slots[a][i : i + 4] == slots[b][i : i + 4] for i in (0, 4, 8, 12))
    want = {(a, b): sum(x == y for x, y in zip(slots[a], slots[b])) / 16 for a in slots for b in slots if a < b and band(a, b)}
    first = {r["file_id"]: r["class_id"] for r in q["band_classes"](spark, str(tmp_path)).collect()}
    pairs = {(r["file_a"], r["file_b"]): r["likeness"] for r in q["band_pairs"](spark, str(tmp_path)).collect()}
    assert first == {a: min(b for b in slots if slots[b] == slots[a]) for a in slots} and len(set(first.values())) < len(first)
    got = {(a, b): 1.0 if first[a] == first[b] else pairs.get(tuple(sorted((first[a], first[b])))) for a in slots for b in slots if a < b}
    assert {k: v for k, v in got.items() if v is not None} == want
    probed = {(r["file_a"], r["file_b"]) for r in q["band_probe"](spark, str(tmp_path)).collect()}
    assert set(want) - probed


def test_probe_templates_are_whole_fingerprints(spark, monkeypatch):
    """fast_probe, slow_probe: pages alike in the four slots of ``hex`` but not in the rest are templates of their own."""
    prints = spark.createDataFrame([(p, "h.test", "same", [1, 2, 3, 4, n], [n], {"g": 1.0}, 1.0) for p, n in (("a", 5), ("b", 6), ("c", 5))], "page string, host string, hex string, minhash array<int>, bands array<int>, grams map<string,double>, norm double")
    seen = spark.createDataFrame([(p, datetime(2025, 1, k)) for k, p in enumerate("abc", 1)], "file_id string, crawled_at timestamp")
    monkeypatch.setattr(queries, "page_fingerprints", lambda *_: prints)
    monkeypatch.setattr(queries, "_pages", lambda *_: seen)
    assert rows(queries._probe_sides(spark, "")[1].select("template_id", "observation_count")) == [("a", 2), ("b", 1)]


def test_every_query_is_registered_and_has_its_columns(spark, data):
    q, sql = queries.queries(), queries.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60
    assert queries.flagship(spark, data).count() > 0
