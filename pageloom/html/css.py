"""CSS selectors over a ``Dom``: compound selectors, attribute tests, the four combinators, lists.

A selector outside this subset raises ``BadSelector``; callers skip it and count a miss.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .shred import Dom
from .tree import Node


class BadSelector(ValueError):
    pass


_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_PART = re.compile(
    rf"(?P<tag>\*|{_NAME})|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|{_NAME})\s*(?P<flag>[iI])?\s*)?\]"
    r"|:(?P<pseudo>first-child|last-child|nth-child\(\s*\d+\s*\)|nth-of-type\(\s*\d+\s*\))"
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


@lru_cache(maxsize=4096)
def compile_selector(selector: str) -> tuple:
    """A selector list as tuples of (combinator, tests), the rightmost compound last."""
    out = []
    text = selector.strip()
    if not text:
        raise BadSelector("empty selector")
    at, steps, link = 0, [], None
    while True:
        tests = []
        while at < len(text) and (m := _PART.match(text, at)) and not (m["tag"] and tests):
            kind = m.lastgroup if m.lastgroup not in ("op", "val", "flag") else "attr"
            if m["attr"]:
                value = m["val"]
                if value is not None:
                    value = value[1:-1] if value[0] in "\"'" else _plain(value)
                tests.append(("attr", m["attr"].lower(), m["op"], value, bool(m["flag"])))
            elif kind == "tag":
                if m["tag"] != "*":
                    tests.append(("tag", _plain(m["tag"]).lower()))
                else:
                    tests.append(("any",))
            elif kind == "pseudo":
                tests.append(("pseudo", m["pseudo"]))
            else:
                tests.append((kind, _plain(m[kind])))
            at = m.end()
        if not tests:
            raise BadSelector(f"cannot read {selector!r} at {at}")
        steps.append((link, tuple(tests)))
        rest = text[at:]
        if not rest.strip() or rest.lstrip().startswith(","):
            out.append(tuple(steps))
            if not rest.strip():
                return tuple(out)
            at += rest.index(",") + 1
            while at < len(text) and text[at].isspace():
                at += 1
            steps, link = [], None
            continue
        m = _COMBINATOR.match(text, at)
        if not m:
            raise BadSelector(f"cannot read {selector!r} at {at}")
        link, at = m[1] or " ", m.end()


def _holds(dom: Dom, i: int, tests: tuple) -> bool:
    x: Node = dom.nodes[i]
    for t in tests:
        kind = t[0]
        if kind == "tag" and x.tag != t[1]:
            return False
        if kind == "id" and x.attrs.get("id") != t[1]:
            return False
        if kind == "cls" and t[1] not in x.classes:
            return False
        if kind == "attr":
            have = x.attrs.get(t[1])
            if have is None:
                return False
            if t[2]:
                value = t[3]
                if t[4]:
                    have, value = have.lower(), value.lower()
                if not {"=": have == value, "~=": value in have.split(), "|=": have == value or have.startswith(value + "-"), "^=": bool(value) and have.startswith(value), "$=": bool(value) and have.endswith(value), "*=": bool(value) and value in have}[t[2]]:
                    return False
        if kind == "pseudo":
            up = dom.parent[i]
            kids = dom.kids[up] if up >= 0 else [i]
            want = t[1]
            if want == "first-child" and kids[0] != i or want == "last-child" and kids[-1] != i:
                return False
            number = re.search(r"\d+", want)
            if number:
                place = dom.nth[i] if "of-type" in want else kids.index(i) + 1
                if place != int(number[0]):
                    return False
    return True


def _fits(dom: Dom, i: int, steps: tuple, k: int) -> bool:
    if not _holds(dom, i, steps[k][1]):
        return False
    if k == 0:
        return True
    link = steps[k][0]
    up = dom.parent[i]
    if link == ">":
        return up >= 0 and _fits(dom, up, steps, k - 1)
    if link == " ":
        return any(_fits(dom, a, steps, k - 1) for a in dom.ancestors(i))
    if up < 0:
        return False
    kids = dom.kids[up]
    before = kids[: kids.index(i)]
    return any(_fits(dom, b, steps, k - 1) for b in (before[-1:] if link == "+" else before))


def select(dom: Dom, selector: str) -> list[int]:
    """Numbers of the elements a selector list matches, in document order."""
    chains = compile_selector(selector)
    return [i for i in range(len(dom)) if any(_fits(dom, i, c, len(c) - 1) for c in chains)]
