"""The dealt operators on small tables: brute force where there is one, and awkward rows."""

import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import furniture, leakage, lookalikes, markup, mixing, queries, residue, sentences, sitelines

PROSE = (
    "The early parser counted the rows near the old quay, and nobody asked why it had taken so long to finish. Two lanterns stood beside the door of the workshop until the "
    "evening train had left for the coast. A letter about the garden arrived on Monday with three stamps and no address on its back. "
)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ------------------------------------------------------------------------------------- pages


@pytest.fixture(scope="module")
def pages(spark):
    nav = "<nav><ul><li><a href=/a>Home</a></ul></nav>"
    error = "<div><h1>Gateway timeout</h1><p>Nobody at {} picked up after {} ms while the long queue of patient visitors was waiting at the door.</p></div>"
    data = [
        ("1", f"{nav}<main><p>{PROSE}</p><p>with **marks** &lt;i&gt;</p></main>", f"{PROSE.strip()}\nHome"), ("1", f"{nav}<main><p>{PROSE}</p><p>with **marks** &lt;i&gt;</p></main>", f"{PROSE.strip()}\nHome"),
        ("2", f"{nav}<main><p>{PROSE}</p></main>", None), ("3", None, "x"), ("4", "", ""), (None, f"<p>{PROSE}</p>", "x"), ("5", error.format("Aaa", 7), None), ("6", "<p>" + "long words here " * 20000, "a\n\nb"),
        ("7", f"<main><h1>Hi {{{{ name }}}}</h1><p>{PROSE}</p></main>" + nav, "Home"),
    ]
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in data], "file_id string, html string, main_content_text string, record string, text string, trusted int")


def test_markup(spark, pages):
    answers = spark.createDataFrame([(1, "a <b>c</b>"), (1, "a <b>c</b>"), (2, None), (3, ""), (None, "<b>"), (4, "plain **own**"), (5, "[[x]]\r\n\\emph{y}")], "response_id long, markdown string")
    assert rows(markup.found(pages, answers)) == [("test_responses", "1", "html"), ("test_responses", "5", "latex"), ("test_responses", "5", "wiki"), ("wcxb_samples", "1", "html"), ("wcxb_samples", "1", "markdown")]
    assert markup.found(pages.limit(0), answers.limit(0)).count() == 0
    texts = {r["record_key"]: r["clean_text"] for r in markup.markup_residue(pages, "file_id", "html", "html").collect()}
    assert "marks" in texts["1"] and "**" not in texts["1"] and texts["3"] == texts["4"] == "" and len(texts["6"]) > 200_000
    with pytest.raises(ValueError):
        markup.markup_residue(pages, "file_id", "html", "bbcode")


def test_markup_kinds_are_the_same_with_and_without_text(spark):
    """p1_found: what the JVM leaves out holds nothing that the patterns find."""
    texts = [
        "{{cite web|title=Lumedin}}", "{{Infobox|name=Lumedin}}", "{{Citation needed|date=May}}", "[[x]]", "a\n== b ==", "'''x'''", "''x''", "{| class=a", "a\r|- b", "__TOC__", "[http://a.test/ b]", "<ref name=a>", "#REDIRECT x", "&nbsp;",
        "<b>", "<!-- x -->", "\\emph{x}", "\\alpha", "\\(x\\)", "$x^2$", "$$x$$", "plain", "# Head", "| a | b |", "{{ name }}", "{{main}}",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "response_id long, markdown string")
    mode = lambda with_text: {r["record_key"]: r["kinds"] for r in markup.markup_residue(df, "response_id", "markdown", "markdown", with_text).collect() if r["kinds"]}
    assert mode(False) == mode(True) and [k for k in ("0", "1", "2") if mode(False).get(k) == ["wiki"]] == ["0", "1", "2"] and len(mode(False)) == 21
    clean = {r["record_key"]: r["clean_text"] for r in markup.markup_residue(df, "response_id", "markdown", "markdown").collect()}
    assert clean["0"] == clean["1"] == "" and clean["24"] == "{{ name }}"


def test_residue(spark, pages):
    assert rows(residue.find_residue(pages, "file_id", "html")) == [("5",), ("7",)]
    assert residue.find_residue(pages.limit(0), "file_id", "html").count() == 0
    assert residue.without_residue(pages, "file_id", "html").where("file_id IN ('5', '7')").count() == 0


def test_residue_spreads_to_similar_texts(spark):
    """p2_found: labels spread over near-duplicates and over those of near-duplicates, against brute force; with the spread switched off only seeds are left."""
    rng = np.random.default_rng(3)
    vocabulary = [a + b + c for a in "bdgkl" for b in "aeiou" for c in "mnrs"]
    texts, data = {}, []
    for k in range(60):
        own = ["bad", "gateway", *(str(x) for x in rng.choice(vocabulary, 94))]
        for v in range(5):
            if v == 1:
                own[:2] = ["quay", "lantern"]
            elif v:  # every version differs from the one before by a word or two, so that the last is far from the first
                for at in rng.choice(np.arange(8, 90), 1 + (k + v) % 2, replace=False):
                    own[at] = f"z{'abcdefgh'[v]}{'abcdefgh'[at % 8]}"
            texts[f"{k:02d}{v}"] = residue.mask(" ".join(own), "")
            data.append((f"{k:02d}{v}", f"<div><p>{' '.join(own)}</p></div>"))
    seeds = {i for i in texts if i.endswith("0")}
    sets = {i: set(residue.shingles(x)) for i, x in texts.items()}
    like = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= residue.SIMILARITY
    want = set(seeds)
    while more := {y for x in want for y in texts if y not in want and like(x, y)}:
        want |= more
    df = spark.createDataFrame(data, "file_id string, html string")
    found = {r["record"]: r["trusted"] for r in residue.labelled_records(residue.residue_units(df, "file_id", "html")).collect()}
    assert set(found) <= want and {k for k, t in found.items() if t} == seeds  # nothing besides, and the seeds stay seeds
    gained, possible = len(set(found) - seeds), len(want - seeds)
    print(f"recall of the spread: {gained} of {possible}")
    assert possible > 150 and gained >= 0.9 * possible
    assert any(not like(y[:2] + "0", y) for y in found)  # some came in a later round
    assert {r[0] for r in residue.find_residue(df, "file_id", "html").collect()} == set(found)


def test_surge_and_dive_points_decide_the_body(monkeypatch):
    """p3_found: the body is where the window sums say; with them switched off other lines are listed."""
    from pageloom.llm import mainbody

    teasers = "".join(f"<p>Teaser {k} of many on this site</p><ul><li><a href=/>x</a><li><a href=/>y</a><li><a href=/>z</a></ul>" for k in range(30))
    page = f"<div class=a><p>{PROSE}</p><p>{PROSE}</p><div class=x><p>Join our letter today</p></div></div><div class=b>{teasers}</div>"
    content = "\n".join([PROSE.strip(), "Join our letter today", "Teaser 3 of many on this site"])
    assert mainbody.stray_lines(mainbody.Page(page), content) == [2, 3]
    monkeypatch.setattr(mainbody, "stretches", lambda weights, window=3: [(0, len(weights))])
    assert mainbody.stray_lines(mainbody.Page(page), content) == [1, 2]
    monkeypatch.undo()
    monkeypatch.setattr(mainbody, "_dives", lambda parent, boxes, held: [])
    assert mainbody.stray_lines(mainbody.Page(page), content) == [3]


def test_furniture(spark, pages):
    assert rows(furniture.furniture_lines(pages, "file_id", "html", "main_content_text")) == [("1", 2)]
    assert furniture.furniture_lines(pages.limit(0), "file_id", "html", "main_content_text").count() == 0
    bodies = {r["record"]: r["main_body"] for r in furniture.main_bodies(pages, "file_id", "html").collect()}
    assert bodies["2"] == PROSE.strip() and bodies["3"] == bodies["4"] == ""


# --------------------------------------------------------------------------------- templates


def vector(weights):
    return struct.pack("<I", len(weights)) + b"".join(struct.pack("<I", len(k)) + k.encode() + struct.pack("<d", w) for k, w in weights.items())


def test_lookalikes_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**32, (40, 128), dtype=np.uint32)
    data, slots, vectors = [], {}, {}
    for k in range(120):
        s = base[k % 40].copy()
        s[rng.choice(128, [0, 19, 20, 5][k % 4], replace=False)] ^= 1
        w = {f"g{k % 40}.{i}": float(rng.integers(1, 9)) for i in range(12)} | {"html": 3.0}
        if k >= 40:
            w = dict(vectors[f"t{k % 40:03d}"])
            w[f"g{k % 40}.{k % 12}"] += [0.0, 30.0, 1.0][k % 3]
        ident = f"t{k:03d}"
        slots[ident], vectors[ident] = s, w
        data += [(ident, s.tobytes(), vector(w), "x")] * (1 + k % 2)
    data += [("n1", None, None, "x"), ("n2", b"short", b"", "x"), ("n3", b"\x07\x00\x00\x00" * 128, b"\0\0\0\0", "x"), ("n4", b"\x07\x00\x00\x00" * 128, b"\x05", "x"), (None, base[0].tobytes(), None, "x")]
    df = spark.createDataFrame(data, "template_id string, signature_minhash binary, pq_gram_vector binary, data string")
    ids = sorted(slots)

    def cosine(a, b):
        return sum(v * b.get(k, 0) for k, v in a.items()) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5

    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (slots[a] == slots[b]).sum() >= 109 or cosine(vectors[a], vectors[b]) >= 0.9}
    got = rows(lookalikes.lookalike_pairs(df))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    assert lookalikes.lookalike_pairs(df.limit(0)).count() == 0
    group = {i: i for i in ids}
    for a, b in sorted(want):
        low, high = sorted((group[a], group[b]))
        group = {i: low if g == high else g for i, g in group.items()}
    linked = {i for pair in want for i in pair}
    groups = rows(lookalikes.lookalike_groups(df))
    assert {(i, g) for i, g, _ in groups} == {(i, group[i]) for i in linked} and all(n > 0 for _, _, n in groups) and lookalikes.lookalike_groups(df.limit(0)).count() == 0
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "y")], "a string, b string")
    assert rows(lookalikes.components(edges)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")]


def test_bit_set(spark):
    numbers = [0, 1, 63, 64, 4095, 64, 2**12 - 65]
    bits = lookalikes.bit_set(spark.createDataFrame([(n,) for n in numbers], "slot long"), 12)
    assert [k for k in range(2**12) if bits[k >> 3] >> (k & 7) & 1] == sorted(set(numbers))
    assert not lookalikes.bit_set(spark.createDataFrame([], "slot long"), 12).any()


def test_wandering_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**32, 128, dtype=np.uint32)
    signs = {}
    for k in range(6):
        s = base.copy()
        s[k * 6 : k * 6 + 6] ^= 1
        signs[f"t{k}"] = s
    signs["t6"] = signs["t5"]  # a copy is no rival of its own
    signs["far"] = rng.integers(0, 2**32, 128, dtype=np.uint32)
    templates = spark.createDataFrame([(i, s.tobytes(), None) for i, s in signs.items()] + [("none", None, None)], "template_id string, signature_minhash binary, pq_gram_vector binary")
    data, want = [], set()
    for k in range(60):
        own, page = f"t{k % 7}", signs[f"t{(k * 5) % 7}"].copy()
        page[rng.choice(128, k % 4, replace=False)] ^= 7
        data += [(own, k, page.tobytes(), 1.0)] * (1 + k % 2)
        mine = int((page == signs[own]).sum())
        rivals = [(-int((page == s).sum()), i) for i, s in signs.items() if i != own and (s == signs[own]).sum() >= 109 and not (s == signs[own]).all()]
        score, near = min((n, "t5" if i == "t6" else i) for n, i in rivals)
        if -score > mine:
            want.add((own, k, near, mine, -score))
    data += [("far", 99, signs["t0"].tobytes(), 1.0), ("none", 98, signs["t0"].tobytes(), 1.0), ("t0", 97, b"short", 1.0), ("t0", 96, None, None), (None, 95, signs["t0"].tobytes(), 1.0)]
    seen = spark.createDataFrame(data, "template_id string, observed_at int, signature_minhash binary, similarity_at_match double")
    assert set(rows(lookalikes.wandering_observations(seen, templates))) == want and len(want) > 20
    assert lookalikes.wandering_observations(seen.limit(0), templates).count() == lookalikes.wandering_observations(seen, templates.limit(0)).count() == 0


def test_lookalike_copies_larger_than_a_node(spark):
    same = np.arange(128, dtype=np.uint32).tobytes()
    near = np.arange(128, dtype=np.uint32)
    near[:3] = 999
    df = spark.createDataFrame([(f"t{k:02d}", same if k < 50 else near.tobytes(), None) for k in range(52)], "template_id string, signature_minhash binary, pq_gram_vector binary")
    assert lookalikes.lookalike_pairs(df).count() == 52 * 51 // 2


# -------------------------------------------------------------------------------- site lines


def test_repeated_lines_against_brute_force(spark):
    data = []
    for k in range(40):
        host = ["www.Big.test", "big.test", "small.test", None][k % 4] if k < 36 else "big.test"
        body = "".join(f"<p>{x}</p>" for x in ["Menu", f"Page {k}", f"own {chr(97 + k % 26)}{chr(97 + k // 26)}", "99", *(["Rare note"] if k % 8 == 0 else [])])
        data += [(f"f{k}", host, body, "clash")] * (1 + (k % 5 == 0))
    data += [("e1", "big.test", None, "x"), ("e2", "big.test", "", "x"), (None, "big.test", "<p>Menu", "x")]
    df = spark.createDataFrame(data, "id string, host string, html string, lines string")
    lines, n = {}, {}
    for i, h, s, _ in set(data):
        if i is None or h is None:
            continue
        site = re.sub(r"^www\.", "", h.lower())
        lines[i] = (site, set(sitelines.page_lines(s)))
    for site, _ in lines.values():
        n[site] = n.get(site, 0) + 1
    count = {}
    for site, ls in lines.values():
        for x in ls:
            count[site, x] = count.get((site, x), 0) + 1
    want = sorted((i, x) for i, (site, ls) in lines.items() for x in ls if count[site, x] >= 5 and count[site, x] * 5 >= n[site])
    found = sitelines.repeated_lines(df, "id", "host", "html")
    assert rows(found.select("id", "line")) == want and len(want) > 50
    blocks = {(r["site"], r["text"]) for r in sitelines.boilerplate_blocks(df, "id", "host", "html").collect()}
    assert ("big.test", "menu\npage #") in blocks and ("small.test", "menu\npage #") in blocks
    clean = {r["id"]: r["text"] for r in sitelines.without_repeated(df, "id", "host", "html").collect()}
    assert clean["f1"] == "own ba" and clean["e1"] == clean["e2"] == ""
    assert sitelines.repeated_lines(df.limit(0), "id", "host", "html").count() == 0


def test_blocks_are_components_of_supported_nodes_and_edges():
    node, edge = lambda a, n: {"a": a, "b": None, "weight": n}, lambda a, b, n: {"a": a, "b": b, "weight": n}
    graph = [node(1, 50), node(2, 50), node(3, 40), node(4, 50), node(5, 9), edge(1, 2, 50), edge(2, 3, 30), edge(3, 4, 7), edge(4, 6, 50), edge(2, 1, 1)]
    assert sitelines.components_of(graph) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}  # 3-4 is too weak, 6 is not kept, 5 stands alone
    assert sitelines.components_of([e for e in graph if e["b"] is None]) == {k: k for k in range(1, 6)}  # without edges every line is a block


# ---------------------------------------------------------------------------------- leakage


def test_leakage_against_brute_force(spark):
    item = "Which workshop did Ann Lee assign to unit seven after the wooden index near the quay had failed twice?"
    words = item.split()
    han = "根据规程那座安静的图书馆在夜里把三千个样本交给了第七号岗位而且没有通知任何读者或编辑部"
    docs = [
        (1, "x " + " ".join(words[2:14]) + " y"), (2, " ".join(words[2:13])), (3, "…".join(words).upper().replace("ANN", "A­NN")), (4, " ".join(w if k != 6 else "other" for k, w in enumerate(words))),
        (5, "前言：" + han[3:28].replace("的", "的，") + "。后"), (6, han[3:27]), (7, None), (8, ""), (None, item), (9, item), (9, item), (10, "word " * 50_000), (11, " ".join(words[:9] + ["gap"] + words[9:])),
    ]
    documents = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, key string")
    items = spark.createDataFrame([(1, "EN", item), (1, "EN", item), (2, "zh-x1", han), (3, None, han), (4, "en", None), (5, "en", "short one")], "item_id long, lang string, text string")
    assert len(words) - 7 >= 12  # document 4 holds that many after its one other word; 11 is cut into 9 and 10
    assert rows(leakage.found(documents, items)) == [(1, 1), (3, 1), (4, 1), (5, 2), (5, 3), (9, 1)]
    near = {(r["doc_id"], r["item_id"]): r["equal_share"] for r in leakage.leaked(documents, items).collect()}
    assert near[4, 1] > 0.8
    assert leakage.found(documents.limit(0), items).count() == 0 and leakage.found(documents, items.limit(0)).count() == 0


# ------------------------------------------------------------------------------------ mixing


def test_mixing(spark):
    docs = [(k, "some words about a quay " * (1 + k % 7), ["Big ", "small", "mid-size"][0 if k % 10 < 7 else 1 if k % 10 == 7 else 2]) for k in range(3000)] + [(9001, None, "small"), (9002, "x", None), (None, "x", "small"), (0, "again", "big")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.3, 3), ("m", "mid_size", 0.2, 2), ("gone", "nowhere", 1.0, 2), ("part", "big", 0.5, 1), ("part", "nowhere", 0.5, 4), (None, "big", 1.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    chosen = mixing.mix(documents, targets).cache()
    assert chosen.join(targets.where("mix_id = 'm'"), ["mix_id", "source"]).where("copies > max_repeats OR copies < 1").count() == 0
    assert chosen.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    got = {(r["mix_id"], r["source"]): r for r in mixing.shares(chosen, targets).collect()}
    for source, share in (("big", 0.5), ("small", 0.3), ("mid_size", 0.2)):
        assert got["m", source]["actual_share"] == pytest.approx(share, abs=0.01)
    assert got["gone", "nowhere"]["tokens"] == 0 and got["part", "big"]["actual_share"] == 1.0
    assert mixing.mix(documents.limit(0), targets).count() == 0
    small = mixing.mix(documents, targets.where("mix_id = 'm'"), total=5000.0)
    assert small.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] == pytest.approx(5000, rel=0.05)
    with pytest.raises(ArithmeticError):  # a dual that is not solved gives no mix
        sizes = spark.createDataFrame([("a", 3, 10), ("a", 7, 5)], "source string, n_tokens int, n long")
        goals = spark.createDataFrame([("m", "a", 2, 90.0, 7, 65)], "mix_id string, source string, max_repeats int, goal double, scale int, have long")
        mixing.multipliers(sizes, goals, rounds=2)
    chosen.unpersist()


# --------------------------------------------------------------------------------- sentences


def test_sentence_units(spark):
    df = spark.createDataFrame([(1, "One. Two!", 5), (2, None, 5), (3, " \n ", 5), (None, "x.", 5), (4, "😀 Ja? Nein.", 5), (5, "No end " * 30_000, 5), (6, "Mr. A. B. " * 5_000 + "end.", 5)], "doc_id long, text string, start_pos int")
    got = rows(sentences.sentence_units(df))
    assert [r for r in got if r[0] in (1, 2, 3, 4)] == [(1, 0, 4), (1, 5, 9), (4, 0, 5), (4, 6, 11)]
    assert [r for r in got if r[0] == 5] == [(5, 0, 209_999)] and {r[0] for r in got} == {1, 4, 5, 6}
    assert sentences.sentence_units(df.limit(0)).count() == 0


def test_found_queries_have_the_asked_columns(spark, data):
    want = {
        "p1_found": "source_table string, record_key string, markup string", "p2_found": "file_id string", "p3_found": "file_id string, line_no int", "p5_found": "template_id_a string, template_id_b string",
        "p6_found": "id string, line string", "p7_found": "doc_id bigint, item_id bigint", "p9_found": "doc_id bigint, start_pos int, end_pos int",
    }
    for name, columns in want.items():
        df = queries.queries()[name](spark, data)
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == columns
        assert df.count() == df.distinct().count() > 0


def test_texts_of_problems_1_to_3_are_queries(spark, data):
    """p1_clean, p2_clean, p3_bodies: every record of the tables comes back."""
    q = queries.queries()
    pages, answers = spark.read.parquet(f"{data}/wcxb_samples.parquet"), spark.read.parquet(f"{data}/test_responses.parquet")
    keys = {r[0] for r in pages.select("file_id").where("file_id IS NOT NULL").collect()}
    clean = q["p1_clean"](spark, data).collect()
    assert {r["record_key"] for r in clean if r["source_table"] == "wcxb_samples"} == keys and {int(r["record_key"]) for r in clean if r["source_table"] == "test_responses"} == {r[0] for r in answers.select("response_id").where("response_id IS NOT NULL").collect()}
    assert {(r["source_table"], r["record_key"], k) for r in clean for k in r["kinds"]} == set(rows(q["p1_found"](spark, data))) and sum(bool(r["clean_text"]) for r in clean) > len(clean) // 2
    found = {r[0] for r in q["p2_found"](spark, data).collect()}
    kept = q["p2_clean"](spark, data)
    assert kept.columns == pages.columns and {r[0] for r in kept.select("file_id").where("file_id IS NOT NULL").collect()} == keys - found
    bodies = q["p3_bodies"](spark, data)
    assert bodies.columns == ["file_id", "main_body"] and {r["file_id"] for r in bodies.collect() if r["file_id"]} == keys
