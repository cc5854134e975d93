"""Readers, codecs, sinks, fences, queues and enrichment: awkward input, brute force and round trips."""

import json
import random
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom import queries, rendered_queries
from pageloom.checkpoints import counted
from pageloom.functions.codecs import grams, read_vector, slots, stored_bands, write_signature, write_vector
from pageloom.operators import enrich, evaluate, fingerprint, learn, mining, skeleton, stores
from pageloom.plans import schema_drift
from pageloom.sources import sinks
from pageloom.sources.rendered import customer_pages
from pageloom.streaming import jobs
from pageloom.streaming.fence import induce_fence
from pageloom.streaming.tags import TagReader, Tripwire, attributes, tags_of

WORDS = "some words of a longer text that goes on " * 12
PAGE = f"<header><nav><a href=/a>A</a></nav></header><main id=body><h1>Title</h1><p>{WORDS}</p><p>{WORDS}</p></main><footer>© 2026</footer>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ------------------------------------------------------------------------------------- tags


def test_tags_do_not_depend_on_chunks():
    page = '<!-- <b> --><HTML lang="de"><![CDATA[<i>]]><script>if (a<b) "<p>"</script><p class="a>b" data-x=\'1\' hidden>5 < 6<br/><img src=x alt="ü"></p><style>p>a{}</style><a href'
    whole = [(t.name, t.closing, t.empty, t.attrs, t.begin, t.end) for t in tags_of(page)]
    for size in (1, 2, 3, 7, 64):
        assert [(t.name, t.closing, t.empty, t.attrs, t.begin, t.end) for t in tags_of(page, size)] == whole
    assert [n for n, *_ in whole] == ["html", "script", "script", "p", "br", "img", "p", "style", "style"]
    raw = page.encode()
    assert all(raw[a:b].startswith(b"<") and raw[a:b].endswith(b">") for *_, a, b in whole)
    assert whole[3][3] == (("class", "a>b"), ("data-x", "1"), ("hidden", "")) and whole[4][2] and whole[5][3][1] == ("alt", "ü")
    assert list(tags_of(None)) == list(tags_of("")) == [] and attributes(b' A=1 a=2 /') == (("a", "1"),)
    reader = TagReader()
    with pytest.raises(ValueError):
        list(reader.feed(b'<p title="' + b"x" * (1 << 21)))


def test_tripwire():
    see = lambda wire, page: any([wire.see(t) for t in tags_of(page)])
    assert see(Tripwire(("main", "h1")), "<main><h1>x") and not see(Tripwire(("main", "h1")), "<main></h1>") and see(Tripwire(("main", "H1"), every=False), "<h1>")
    for names in ((), ("a", "b", "c", "d")):
        with pytest.raises(ValueError):
            Tripwire(names)


# ------------------------------------------------------------------------------------ codecs


def test_codecs(spark):
    vector = {"body,p": 2.0, "ü": -1.5, "": 3.0}
    assert read_vector(write_vector(vector)) == vector and read_vector(None) == read_vector(b"") == read_vector(b"\x05\0\0\0") == {}
    assert read_vector(struct.pack("<I", 1) + struct.pack("<I", 1) + b"a" + struct.pack("<d", float("nan"))) == {}
    sign = np.arange(128, dtype=np.uint32)
    row = spark.createDataFrame([(write_signature(sign), write_vector(vector)), (None, None)], "s binary, v binary").select(slots(F.col("s")).alias("x"), stored_bands(F.col("s")).alias("b"), grams(F.col("v")).alias("g")).collect()
    assert row[0]["x"][1] == "01000000" and len(row[0]["x"]) == 128 and len(row[0]["b"]) == 16 and row[0]["b"][0] == "".join(row[0]["x"][:8]) and row[0]["g"] == vector
    assert row[1]["g"] == {} and row[1]["x"] in (None, [None] * 128)


# ------------------------------------------------------------------------------------ probes


def test_probes_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**32, (4, 128))
    pages, templates, vectors = [], [], {}
    for k in range(40):
        s = base[k % 4].copy()
        s[rng.choice(128, k % 23, replace=False)] = 7 + k
        bands = [hash(tuple(s[8 * i : 8 * i + 8].tolist())) for i in range(16)]
        vector = {f"g{k % 4}.{i}": float(rng.integers(1, 9)) for i in range(10)} | {"html": 20.0 * (k % 3 == 0) + 1}
        vectors[f"p{k:02d}"] = vector
        row = (f"p{k:02d}", ["h", "g"][k % 5 == 0], s.tolist(), bands, vector)
        pages.append(row)
        if k % 3 == 0:
            templates.append((*row, k, datetime(2025, 1, 1) + timedelta(days=k)))
    p = spark.createDataFrame(pages, "page string, host string, minhash array<bigint>, bands array<bigint>, grams map<string,double>")
    t = spark.createDataFrame(templates, "template_id string, host string, minhash array<bigint>, bands array<bigint>, grams map<string,double>, observation_count int, last_seen timestamp")
    as_of = datetime(2026, 1, 1)
    score = lambda sim, n, seen: sim + 0.02 * np.log1p(n) + 0.05 * np.exp(-(as_of - seen).total_seconds() / 86400 / 30)

    def best(likeness, least, candidate):
        out = {}
        for page, host, s, b, _ in pages:
            options = [(-round(score(sim, n, seen), 9), i, sim) for i, h, s2, b2, _, n, seen in templates if h == host and i != page and candidate(b, b2) and (sim := likeness(page, i, s, s2)) >= least]
            if options:
                _, i, sim = min(options)
                out[page] = (i, round(sim, 6))
        return out

    equal = lambda page, i, s, s2: float(np.mean(np.array(s) == np.array(s2)))
    fast = {r["page"]: (r["template_id"], round(r["similarity"], 6)) for r in fingerprint.fast_probe(p, t, F.lit(as_of)).collect()}
    assert fast == best(equal, 0.85, lambda a, b: any(x == y for x, y in zip(a, b))) and len(fast) > 10

    def cosine(page, i, *_):
        a, b = vectors[page], vectors[i]
        return sum(v * b.get(k, 0) for k, v in a.items()) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5

    slow = {r["page"]: (r["template_id"], round(r["similarity"], 6)) for r in fingerprint.slow_probe(p, t, F.lit(as_of)).collect()}
    assert slow == best(cosine, 0.75, lambda a, b: True) and len(slow) > 10
    assert fingerprint.fast_probe(p.limit(0), t, F.lit(as_of)).count() == fingerprint.slow_probe(p, t.limit(0), F.lit(as_of)).count() == 0


def test_alike_pages_are_not_broadcast(spark, tmp_path):
    """card_fast_probe: equal fingerprints make small files of wide rows; a page is a narrow row, a layout a single one, and no side of the probe goes through the driver."""
    customers = spark.range(3000).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "CAST(id % 2 AS int) AS c_nationkey", "1.0D AS c_acctbal", "'AUTO' AS c_mktsegment")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "nation-0"), (1, "nation-1")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    found = rendered_queries.card_fast_probe(spark, str(tmp_path))
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["page"], r["template_id"], r["similarity"]) for r in found.collect()) == sorted((str(k), str(k % 2), 1.0) for k in range(2, 3000))
    named, classes, templates = rendered_queries._prints(spark, str(tmp_path))
    assert (named.count(), classes.count(), templates.count()) == (3000, 2, 2) and "minhash" not in named.columns


def test_slow_probe_takes_alike_pages_as_one(spark, tmp_path):
    """card_slow_probe: no pages with their grams go through the driver, and a page that is a template gets the next best one."""
    customers = spark.range(3000).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "CAST(id % 2 AS int) AS c_nationkey", "1.0D AS c_acctbal", "'AUTO' AS c_mktsegment")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "nation-0"), (1, "nation-1")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    found = rendered_queries.card_slow_probe(spark, str(tmp_path))
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["page"], r["template_id"], r["similarity"]) for r in found.collect()) == sorted((str(k), str(k % 2), 1.0) for k in range(2, 3000))
    when = datetime(2025, 1, 1)
    pages = spark.createDataFrame([(p, "", {"a": 1.0}) for p in ("x", "y", "z", "w")] + [("v", "h", {"a": 1.0})], "page string, host string, grams map<string,double>")
    templates = spark.createDataFrame([("x", "", {"a": 2.0}, 1, when), ("y", "", {"a": 3.0}, 1, when), ("z", "", {"b": 3.0}, 9, when)], "template_id string, host string, grams map<string,double>, observation_count int, last_seen timestamp")
    assert {r["page"]: r["template_id"] for r in fingerprint.slow_probe(pages, templates, F.lit(datetime(2026, 1, 1))).collect()} == {"x": "y", "y": "x", "z": "x", "w": "x"}


def test_slow_probe_of_a_host_of_alike_pages(spark, monkeypatch, tmp_path):
    """slow_probe: pairs of pages are no rows, a host of several blocks gives what brute force gives, and a file of one row group is many tasks."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 4, (90, 12)).astype(float) + np.array([9.0] + [0.0] * 11)
    prints = [(f"p{k:02d}", "" if k < 60 else f"h{k % 4}", {f"g{i}": float(v) for i, v in enumerate(row) if v}) for k, row in enumerate(x)]
    pages = spark.createDataFrame(prints, "page string, host string, grams map<string,double>")
    when = datetime(2025, 1, 1)
    templates = spark.createDataFrame([(*p, k % 5, when + timedelta(days=k)) for k, p in enumerate(prints)], "template_id string, host string, grams map<string,double>, observation_count int, last_seen timestamp")
    as_of = datetime(2026, 1, 1)
    monkeypatch.setattr(fingerprint, "BLOCK", 7)
    found = fingerprint.slow_probe(pages, templates, F.lit(as_of), 0.9)
    assert "map_zip_with" not in found._jdf.queryExecution().executedPlan().toString()
    score = lambda sim, k: round(sim + 0.02 * np.log1p(k % 5) + 0.05 * np.exp(-(as_of - when - timedelta(days=k)).total_seconds() / 86400 / 30), 9)
    cosine, want = x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)), {}
    for k, (page, host, _) in enumerate(prints):
        if options := [(-score(cosine[k, i], i), other) for i, (other, h, _) in enumerate(prints) if h == host and i != k and cosine[k, i] >= 0.9]:
            want[page] = min(options)[1]
    assert {r["page"]: r["template_id"] for r in found.collect()} == want and len(want) > 40
    side = lambda v: list(zip(*[(r, c, w) for r, row in enumerate(v) for c, w in enumerate(row) if w]))
    v, w = rng.integers(0, 2, (40, 30)) * 2.0, np.where(rng.random((50, 30)) < 0.01, 3.0, 0.0) + np.eye(50, 30)
    for limit in (3, 4096):
        monkeypatch.setattr(fingerprint, "BLOCK", limit)
        monkeypatch.setattr(fingerprint, "ROWS", 16)
        monkeypatch.setattr(fingerprint, "FULL", 0)
        a, b = ([np.array(c) for c in side(m)] for m in (v, w))
        assert (np.vstack([d for _, d in fingerprint._products(a, b, 40, 50)]) == v @ w.T).all()
    one = spark.range(64, numPartitions=1).selectExpr("id AS file_id", "'h' AS host", "'<p>' AS html")
    monkeypatch.setattr(queries, "_pages", lambda *_: one)
    assert queries.page_fingerprints(spark, "", True).rdd.glom().map(len).filter(bool).count() > 1


def test_mining_totals_parse_every_page_once(spark, tmp_path):
    """card_mining_totals: the plan of the totals reads stored observations and no longer the pages, each of which was parsed again for every count."""
    customers = spark.range(40).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "CAST(id % 2 AS int) AS c_nationkey", "1.0D AS c_acctbal", "'AUTO' AS c_mktsegment")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "nation-0"), (1, "nation-1")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    found = rendered_queries.card_mining_totals(spark, str(tmp_path))
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert tuple(found.first()) == (5, 5, 2, 10)


# ------------------------------------------------------------------------------------ stores


def test_cooldown_rolls_from_the_last_one_taken(spark):
    start = datetime(2025, 1, 1, 10, 59)
    at = lambda minutes: start + timedelta(minutes=minutes)
    data = [("h", "k", at(0)), ("h", "k", at(2)), ("h", "k", at(59)), ("h", "k", at(60)), ("h", "k", at(60)), ("h", "k", at(119)), ("h", "k", at(121)), ("h", "x", at(2)), (None, "k", at(5)), (None, "k", at(6)), ("h", "k", None)]
    df = spark.createDataFrame(data, "host string, kind string, at timestamp")
    assert rows(stores.cooled(df, ["host", "kind"], "at")) == sorted([("h", "k", at(0)), ("h", "k", at(60)), ("h", "k", at(121)), ("h", "x", at(2)), (None, "k", at(5))], key=repr)
    rng = random.Random(2)
    many = [(f"h{rng.randrange(3)}", "k", start + timedelta(seconds=rng.randrange(90_000))) for _ in range(700)]
    want, last = [], {}
    for h, k, t in sorted(set(many), key=lambda r: r[2]):
        if h not in last or t >= last[h] + timedelta(hours=1):
            last[h] = t
            want.append((h, k, t))
    assert rows(stores.cooled(spark.createDataFrame(many, "host string, kind string, at timestamp").repartition(5), ["host", "kind"], "at")) == sorted(want, key=repr)
    late = df.withColumn("taken", F.lit(at(61)))
    assert rows(stores.cooled(late.where("host = 'h' AND kind = 'k'"), ["host", "kind"], "at", taken="taken")) == [("h", "k", at(59)), ("h", "k", at(119))]
    assert stores.cooled(df.limit(0), ["host", "kind"], "at").count() == 0


def test_drift_average_counts_everything(spark):
    rng = random.Random(5)
    data = [("t", datetime(2025, 1, 1) + timedelta(minutes=k), datetime(2025, 6, 1), rng.random()) for k in range(900)] + [("u", datetime(2025, 1, 1), datetime(2025, 1, 1), 0.5), ("u", datetime(2025, 1, 2), datetime(2025, 1, 2), None)]
    got = {r["template_id"]: r for r in stores.drift_average(spark.createDataFrame(data, "template_id string, observed_at timestamp, loaded_at timestamp, similarity_at_match double")).collect()}
    ewma = None
    for _, _, _, x in data[:900]:
        ewma = 1 - x if ewma is None else 0.2 * (1 - x) + 0.8 * ewma
    assert got["t"]["n"] == 900 and got["t"]["ewma"] == pytest.approx(ewma, abs=1e-12) and (got["u"]["n"], got["u"]["ewma"]) == (1, 0.5)


def test_store_rows(spark):
    new = spark.createDataFrame([("a", "h", [1], [5, 6]), ("a", "h", [1], [5, 6]), ("b", "h", [2], [7])], "template_id string, host string, minhash array<int>, bands array<int>")
    templates, bands = stores.registered(new, spark.createDataFrame([("b",)], "template_id string"))
    assert rows(templates.select("template_id")) == [("a",)] and rows(bands) == [("h", 0, 5, "a"), ("h", 1, 6, "a")]
    old = stores.stamped(new, 3).unionByName(stores.stamped(new.limit(1)))
    assert stores.usable_rows(old).count() == 1 and stores.usable_rows(new).count() == 0 and "format_version" not in stores.usable_rows(old).columns
    assert counted(new, 3).count() == counted(new, 1).count() == 3


def test_import_counts_by_store(spark):
    t = spark.createDataFrame(
        [("s1", 1, "a", b"h", 1, b"m", b"g", b"e", 1, datetime(2025, 1, 1), datetime(2025, 1, 1)), ("s2", 1, "a", b"h", 2, b"m", b"g", b"e", 1, datetime(2025, 1, 1), datetime(2025, 1, 1))],
        "store_id string, file_seq int, template_id string, host_hash binary, version_number int, signature_minhash binary, pq_gram_vector binary, extractor_blob binary, observation_count int, created_at timestamp, last_seen timestamp",
    )
    lines = stores.export_bundle(t)
    back = stores.import_bundle(lines.unionByName(lines))
    assert rows(back.select("store_id", "template_id", "version_number")) == [("s1", "a", 1), ("s2", "a", 2)]
    assert stores.import_bundle(lines, t.where("store_id = 's1'")).count() == 2
    bad = spark.createDataFrame([("not json",), ('{"schemaVersion":2,"store_id":"s1","template_id":"z"}',), (None,)], "value string")
    assert rows(stores.import_report(lines.unionByName(bad), t.where("store_id = 's1'"))) == sorted([("s1", 0, 1, 1), ("s2", 1, 0, 0), (None, 0, 0, 2)], key=repr)


# ------------------------------------------------------------------------------------ drift


def test_types_come_back_where_nothing_is_lost():
    as_kind = schema_drift.as_kind
    assert as_kind("7", "number") == 7 and as_kind("x7", "number") == "x7" and as_kind(["a"], "string") == "a" and as_kind(["a", "b"], "string") == ["a", "b"] and as_kind("[1, 2]", "array") == [1, 2]
    assert as_kind("a", "array") == ["a"] or as_kind("a", "array") == "a"
    assert as_kind("TRUE", "boolean") is True and as_kind(1, "boolean") is True and as_kind(2, "boolean") == 2 and as_kind(5, "string") == "5" and as_kind(None, "number") is None
    value = {"rules": [{"role": "5", "n": ["3"]}, {"role": 6}], "map": {"a": {"x": "1"}, "b": 4}}
    assert schema_drift.retype(value, {"rules[].role": "number", "rules[].n": "number", "map{}.x": "number", "no.such": "string"}) == {"rules": [{"role": 5, "n": 3}, {"role": 6}], "map": {"a": {"x": 1}, "b": 4}}


def test_moves(spark):
    blob = lambda k, moved: json.dumps({"a": {"x": k, "y": 1}, "b": {"z": 2}} if not moved else {"a": {"y": 1}, "b": {"z": 2, "x": k}}).encode()
    data = [("s", seq, f"t{k}", blob(k, seq == 2)) for seq in (1, 2) for k in range(6)]
    blobs = schema_drift.blobs_of(spark.createDataFrame(data, "store_id string, file_seq int, template_id string, blob binary"), "t", "blob")
    changes = schema_drift.schema_changes(blobs, moves=True)
    assert rows(changes) == [("t", "s", 2, "moved", "a.x", "b.x")]
    assert rows(schema_drift.schema_changes(blobs)) == [("t", "s", 2, "added", "", "b.x"), ("t", "s", 2, "removed", "a.x", "")]
    table = schema_drift.unify(blobs, changes, ["a", "b"]).where("file_seq = 2 AND template_id = 't3'").first()
    assert json.loads(table["a"]) == {"x": 3, "y": 1} and json.loads(table["b"]) == {"z": 2}


# ------------------------------------------------------------------------------------ mining


def test_candidates_are_tried_on_pages(spark):
    claim = lambda tag, ident=None: {"tag": tag, "id": ident, "classes": [], "data": {}, "aria": {}, "role": None}
    schema = "candidate_id string, host string, role string, claims array<struct<tag:string,id:string,classes:array<string>,data:map<string,string>,aria:map<string,string>,role:string>>, source_count int, created_at timestamp"
    c = spark.createDataFrame(
        [("c1", "h", "MainContent", [claim("main", "body")], 3, datetime(2025, 1, 2)), ("c2", "h", "Footer", [claim("footer")], 3, datetime(2025, 1, 1)), ("c3", "g", "MainContent", [claim("main")], 3, datetime(2025, 1, 1)), ("c4", "h", "X", [], 1, datetime(2025, 1, 3))], schema
    )
    pages = spark.createDataFrame([("p1", "H", PAGE, datetime(2025, 1, 1)), ("p2", "h", None, datetime(2025, 1, 2)), ("p3", "z", PAGE, datetime(2025, 1, 3)), (None, "h", PAGE, None)], "id string, host string, html string, at timestamp")
    log = mining.evaluated(c, pages, "id", "host", "html", "at")
    assert {(r["candidate_id"], r["page"]): r["won"] for r in log.collect()} == {("c1", "p1"): True, ("c2", "p1"): False, ("c4", "p1"): False, ("c1", "p2"): False, ("c2", "p2"): False, ("c4", "p2"): False}
    assert {r["candidate_id"]: r["reputation"] for r in mining.reputation(log).collect()} == {"c1": 0, "c2": -2, "c4": -2}
    assert [r["candidate_id"] for r in mining.scan_candidates(c, "H").collect()] == ["c4", "c1", "c2"] and [r["candidate_id"] for r in mining.scan_candidates(c, "h", "Footer", 1).collect()] == ["c2"]
    assert mining.evaluated(c.limit(0), pages, "id", "host", "html", "at").count() == 0


def test_classification_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "a"), ("c", "a")], "want string, got string")
    r = {x["label"]: tuple(x)[1:] for x in evaluate.classification_report(df, "want", "got").collect()}
    assert r["a"] == (2, pytest.approx(1 / 3), 0.5, pytest.approx(0.4)) and r["b"] == (1, 0.5, 1.0, pytest.approx(2 / 3)) and r["c"] == (1, 0.0, 0.0, 0.0) and r[""][0] == 1


# ---------------------------------------------------------------------------------- site maps


def test_site_map_stops_at_its_limit(spark):
    links = [("http://h/0", f"http://h/{k:03d}") for k in range(1, 80)] + [("http://h/001", "http://h/deep"), ("http://h/0", "http://other/x"), ("http://h/079", "http://h/far")]
    seeds = spark.createDataFrame([("http://h/0",), ("http://h/079",)], "url string")
    got = {}
    for r in skeleton.site_map(spark.createDataFrame(links, "source string, target string"), seeds).collect():
        got.setdefault(r["root"], []).append((r["depth"], r["url"]))
    assert sorted(got["http://h/0"]) == [(0, "http://h/0")] + [(1, f"http://h/{k:03d}") for k in range(1, 50)] and sorted(got["http://h/079"]) == [(0, "http://h/079"), (1, "http://h/far")]
    text = skeleton.tree_markdown(skeleton.site_map(spark.createDataFrame(links, "source string, target string"), seeds)).where("root LIKE '%079'").first()
    assert text["markdown"] == "- http://h/079\n  - http://h/far" and text["pages"] == 2


# ------------------------------------------------------------------------------------ fences


def test_fences_of_stores_and_pages(spark):
    good = jobs.as_json(induce_fence("h", PAGE))
    assert jobs.template_of(json.loads(good)) == induce_fence("h", PAGE) and jobs.usable(good) and not any(map(jobs.usable, (None, b"x", b"[]", b"{}", b'{"Host":1}')))
    fences = spark.createDataFrame([("H", 1, 1, datetime(2025, 1, 1), "a", good.encode()), ("h", 2, 1, datetime(2025, 1, 1), "b", b"broken"), ("g", 1, 1, datetime(2025, 1, 1), "c", b"broken"), (None, 1, 1, None, "d", good.encode())], "host string, version int, file_seq int, created_at timestamp, template_id string, blob binary")
    assert rows(jobs.latest_usable(fences).select("host")) == [("h",)]
    pages = spark.createDataFrame([("p1", "h", PAGE), ("p2", "h", "<p>no fence"), ("p3", "z", PAGE), ("p4", "h", None)], "id string, host string, html string")
    got = {r["stream_id"]: r for r in jobs.scan_pages(pages, jobs.latest_usable(fences), "id", "host", "html").collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {"p1": "Captured", "p2": "Bailout", "p3": "NoTemplate", "p4": "Bailout"}
    assert PAGE.encode()[got["p1"]["capture_start"] : got["p1"]["capture_end"]].startswith(b"<main") and PAGE.encode()[: got["p1"]["capture_end"]].endswith(b"</main>")


def test_refits_make_new_versions(spark, tmp_path):
    other = PAGE.replace("<main id=body>", "<article>").replace("</main>", "</article>")
    data = [("h", datetime(2025, 1, 1, 0, k), f"p{k:02d}", PAGE if k < 5 else other) for k in range(8)] + [("e", datetime(2025, 1, 1), "e", None)]
    df = spark.createDataFrame(data, "host string, at timestamp, page string, source string")
    batch = jobs.refit_pages(df, "page", "host", "source", "at")
    assert [(r["page"], r["reason"], r["version"], r["changed"]) for r in batch.orderBy("page").collect()] == [("p00", "first", 1, True), ("p05", "miss", 2, True)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.refit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("refits").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    for _ in range(60):  # a stream with timeouts does not end by itself
        if spark.table("refits").count() == batch.count():
            break
        query.awaitTermination(1)
    query.stop()
    assert rows(spark.table("refits")) == rows(batch)
    with pytest.raises(ValueError):
        jobs.every(stream, print, str(tmp_path / "d"), "10 seconds")


# ------------------------------------------------------------------------------------- sinks


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("p", "/a", [1.0, 2.5], True)], "page string, xpath string, features array<float>, in_gold boolean")
    sinks.write_tsv(f, str(tmp_path / "t"), ["x", "y"])
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "t")).first().asDict() == {"page": "p", "xpath": "/a", "label": "1", "x": "1.0", "y": "2.5"}
    sinks.write_jsonl(f, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["features"] == [1.0, 2.5]
    sinks.write_markdown(spark.createDataFrame([("a/b", "# x\n\ny"), ("e", ""), ("n", None)], "page string, markdown string"), str(tmp_path / "m"))
    assert rows(spark.read.text(str(tmp_path / "m"), wholetext=True).select("page")) == [("a/b",)]
    extractor = json.dumps({"rules": [{"role": "MainContent", "css": ["main"], "confidence": 0.9}]})
    made = sinks.write_templates(spark.createDataFrame([("H.test", extractor), ("H.test", extractor), ("", extractor), (None, extractor)], "host string, extractor string"), str(tmp_path / "y"))
    assert rows(made) == [("H.test", "h.test-deterministic.yaml")] and (tmp_path / "y" / "h.test-deterministic.yaml").read_text().startswith("host: H.test")
    lines = spark.createDataFrame([("one",), ("two",)], "value string")
    sinks.write_events(lines, str(tmp_path / "e"))
    sinks.write_events(lines, str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).count() == 4
    out = str(tmp_path / "posted")

    def send(line: str) -> None:
        if line == "one":
            raise OSError("down")
        with open(out, "a") as f:
            f.write(line)

    sinks.posting(send)(lines, 0)
    assert open(out).read() == "two"
    assert json.loads(sinks.json_results(spark.createDataFrame([("p", None)], "page string, title string")).first()["value"]) == {"page": "p", "title": None}


# ---------------------------------------------------------------------------------- learning


def test_frozen_and_hand_written_templates(spark):
    data = [(f"p{k}", "h", PAGE.replace("longer", f"longer{k}"), datetime(2025, 1, 1 + k)) for k in range(4)] + [("q", "g", PAGE, datetime(2025, 1, 4))]
    pages = spark.createDataFrame(data, "id string, host string, html string, at timestamp")
    until = data[2][3].timestamp()
    got = {r["page"]: (r["status"], r["observations"]) for r in learn.learned(pages, "id", "host", "html", "at", until=until).collect()}
    assert got == {"p0": ("Novel", 1), "p1": ("FastPathHit", 2), "p2": ("FastPathHit", 2), "p3": ("FastPathHit", 2), "q": ("NovelEphemeral", 0)}
    template = {"host": "G", "version": 3, "deterministic": False, "rules": [{"role": "MainContent", "selectors": ["#body"], "confidence": 1.0, "chain": []}]}
    r = {x["page"]: x for x in learn.learned(pages, "id", "host", "html", "at", templates=[template]).collect()}["q"]
    assert (r["status"], r["version"], r["template_id"]) == ("OperatorOverride", 3, "operator:g") and "longer" in r["markdown"]


# --------------------------------------------------------------------------------- enrichment


def test_enrichment(spark):
    good = "```yaml\nhost: wrong.test\nrules:\n  - role: MainContent\n    selectors:\n      - '#body'\n  - role: Footer\n    selectors:\n      - footer\n```"
    answers = iter(["nonsense: [", good])
    template, used = enrich.induce_or_mend(lambda prompt: next(answers), "h.test", PAGE)
    assert used == 2 and template["host"] == "h.test" and [r["role"] for r in template["rules"]] == ["MainContent", "Footer"]
    assert enrich.induce_or_mend(lambda prompt: "no", "h.test", PAGE) == (None, 2)
    asked = []
    assert enrich.mend(lambda prompt: asked.append(prompt) or good, template, PAGE) == (template, 0) and not asked
    assert enrich.mend(lambda prompt: good, template | {"rules": [{"role": "MainContent", "selectors": ["#gone"], "confidence": 1.0, "chain": []}]}, PAGE)[0]["rules"][0]["selectors"] == ["#body"]

    def provider(prompt: str) -> str:
        if "down.test" in prompt:
            raise OSError("down")
        return good if "h.test" in prompt else "no"

    queue = spark.createDataFrame([("H.test", PAGE), ("h.test", "<p>x"), ("hand.test", PAGE), ("empty.test", None), ("down.test", PAGE), ("bad.test", PAGE), (None, PAGE)], "host string, html string")
    made = {r["host"]: r for r in enrich.enriched(queue, provider, ["Hand.test"]).collect()}
    assert {h: r["status"] for h, r in made.items()} == {"h.test": "made", "hand.test": "hand-written", "empty.test": "empty", "down.test": "failed", "bad.test": "failed"} and "host: h.test" in made["h.test"]["template"]


def test_rendered_pages(spark):
    c = spark.createDataFrame([(5, "Ann", 1, -3.5, "A"), (6, "Bob", 9, 1.0, "B")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    n = spark.createDataFrame([(1, "Far Land")], "n_nationkey int, n_name string")
    r = customer_pages(c, n, True).collect()
    assert [x["page"] for x in r] == ["5"] and r[0]["host"] == "far-land.example" and "stood at -4 when" in r[0]["html"] and r[0]["html"].count("Parcel") == 2
