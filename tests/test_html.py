from pageloom.html.css import BadSelector, compile_selector, select
from pageloom.html.shred import Dom, node_rows
from pageloom.html.tree import MAX_DEPTH, body_of, leaf_blocks, lines_of, parse, squeeze

import pytest


def tags(source):
    return [x.tag for x in body_of(parse(source)).iter()]


def test_unclosed_paragraphs_and_items():
    assert tags("<p>a<p>b<ul><li>x<li>y</ul>") == ["body", "p", "p", "ul", "li", "li"]
    assert body_of(parse("<p>a<div>b</div>")).elements()[0].text() == "a"


def test_formatting_left_open_is_opened_again():
    body = body_of(parse("<p><b>lead<p>next"))
    assert [x.tag for x in body.iter()] == ["body", "p", "b", "p", "b"]
    assert body.text() == "leadnext"


def test_tables_get_bodies_and_foster_parents():
    body = body_of(parse("<table><tr><td>a<td>b<tr><td>c</table>"))
    assert [x.tag for x in body.iter()] == ["body", "table", "tbody", "tr", "td", "td", "tr", "td"]
    stray = body_of(parse("<table>lost<tr><td>a</table>"))
    assert stray.children[0] == "lost"


def test_raw_text_comments_and_entities():
    body = body_of(parse("<script>var a='</p>';</script><!-- <p>no --><p>a &amp; b&nbsp;c &lt;x&gt;</p>"))
    assert squeeze(body.find("p").text()) == "a & b c <x>"
    assert [x.text for x in lines_of(body)] == ["a & b c <x>"]


def test_null_empty_and_junk_pages():
    for source in (None, "", "   ", "<", "<<<>>>", "</p></div>", "<a href='unclosed"):
        body = body_of(parse(source))
        assert body.tag == "body"
        lines_of(body), leaf_blocks(body), node_rows(source)


def test_deep_nesting_does_not_exhaust_the_stack():
    body = body_of(parse("<div>" * 5000 + "x"))
    assert max(len(list(n.ancestors())) for n in body.iter()) <= MAX_DEPTH + 1
    assert [x.text for x in lines_of(body)] == ["x"]


def test_leaf_blocks_are_elements_without_blocks():
    body = body_of(parse("<ul><li>a <b>b</b><li>c<ul><li>d</ul></ul><td>z"))
    assert leaf_blocks(body) == ["a b", "d"]
    assert leaf_blocks(body_of(parse("<div>x<p>y</p></div><pre>a\n  b</pre>"))) == ["y", "a b"]


def test_inline_code_is_known():
    line = lines_of(body_of(parse("<p>use <code>&lt;b&gt;</code> here")))[0]
    assert line.text == "use <b> here" and "<b>" not in line.outside_code()
    assert lines_of(body_of(parse("<pre>x</pre>")))[0].outside_code() == ""


def test_intervals_and_link_lengths():
    dom = Dom.of("<div><a>one <a>two</a></a><p>three</p></div><aside>x</aside>")
    div = next(i for i, x in enumerate(dom.nodes) if x.tag == "div")
    assert all(dom.inside(k, div) for k in range(div + 1, dom.end[div] + 1))
    assert dom.link[div] == len("one ") + len("two") and dom.prose[div] == len("three")


@pytest.mark.parametrize(
    "selector, want",
    [
        ("p", ["a", "b", "c"]), ("#x > p", ["a", "b"]), ("div p.k", ["b"]), ("p + p", ["b"]), ("p ~ p", ["b"]), ("[data-k]", ["c"]), ("[data-k=v1]", ["c"]), ("[data-k^='v']", ["c"]),
        ("[data-k*=\"1\"]", ["c"]), ("[data-k$='1']", ["c"]), ("p.k, section p", ["b", "c"]), ("*[data-k]", ["c"]), ("p:first-child", ["a", "c"]), ("p:nth-child(2)", ["b"]),
    ],
)
def test_selectors(selector, want):
    dom = Dom.of("<div id=x><p>a</p><p class='k l'>b</p></div><section><p data-k=v1>c</p></section>")
    assert [dom.text_of(i) for i in select(dom, selector)] == want


@pytest.mark.parametrize("bad", ["", "p >", "p::before", "a:hover", "[x", "p,,q"])
def test_bad_selectors(bad):
    with pytest.raises(BadSelector):
        compile_selector(bad)
