"""Text of pages whose body is empty until scripts run: structured data, framework state, forum state, bare text."""

from __future__ import annotations

import html as _html
import json
import re

from ..html.tree import Node, body_of

ENOUGH, PROSE, DEEPEST, MOST = 200, 80, 32, 5000
# Fields that carry text, by type of a structured-data object; fields that lead to further objects.
_ARTICLE, _QUESTION, _POST = ["name", "headline", "description", "articleBody"], ["name", "text", "description"], ["name", "headline", "articleBody", "text"]
_FIELDS = {
    **dict.fromkeys(["Article", "BlogPosting", "NewsArticle", "TechArticle", "Report"], _ARTICLE),
    **dict.fromkeys(["QAPage", "Question"], _QUESTION),
    **dict.fromkeys(["DiscussionForumPosting", "SocialMediaPosting"], _POST),
    "Answer": ["text"], "Comment": ["text"], "FAQPage": ["name"], "ItemList": ["name", "description"], "ListItem": ["name", "description"],
    "WebPage": ["name", "description", "text"], "Recipe": ["name", "description", "recipeInstructions"], "Event": ["name", "description"], "Product": [],
}
_LEADS = {
    **dict.fromkeys(["QAPage", "Question"], ["mainEntity", "acceptedAnswer", "suggestedAnswer"]),
    **dict.fromkeys(["DiscussionForumPosting", "SocialMediaPosting"], ["comment", "comments"]),
    "FAQPage": ["mainEntity"], "ItemList": ["itemListElement"], "ListItem": ["item"], "WebPage": ["mainEntity"],
}
# Keys of framework state that never hold prose.
_NO_PROSE = frozenset(
    "url href src image imageUrl _id id key slug handle className style css html scripts stylesheets buildId assetPrefix publicRuntimeConfig __N_SSP "
    "__N_SSG createdAt updatedAt modifiedAt".split()
)
_TAGS = re.compile(r"<[^>]*>?")
_COMMENT = re.compile(r"\"(?:\\.|[^\"\\])*\"|(/\*.*?\*/|//[^\n]*)", re.S)
_TRAILING = re.compile(r"\"(?:\\.|[^\"\\])*\"|(,)(?=\s*[}\]])", re.S)


def loose_json(text: str):
    """JSON with comments and trailing commas allowed; None when it cannot be read."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        pass
    try:
        text = _COMMENT.sub(lambda m: "" if m[1] else m[0], text)
        return json.loads(_TRAILING.sub(lambda m: "" if m[1] else m[0], text))
    except (ValueError, RecursionError):
        return None


def _flat(text: str) -> str:
    return " ".join(_TAGS.sub(" ", text).split()) if "<" in text else text.strip()


def _texts(value, out: list[str]) -> None:
    if isinstance(value, str):
        if value.strip():
            out.append(_flat(value))
    elif isinstance(value, list):
        for x in value:
            if isinstance(x, str):
                _texts(x, out)
            elif isinstance(x, dict):
                _texts(x.get("text"), out)
                _texts(x.get("name"), out)


def _structured(value, out: list[str], depth: int = 0) -> None:
    if depth > DEEPEST:
        return
    if isinstance(value, list):
        for x in value:
            _structured(x, out, depth + 1)
    elif isinstance(value, dict):
        kind = value.get("@type")
        if isinstance(kind, list):
            kind = next((k for k in kind if isinstance(k, str)), None)
        known = isinstance(kind, str) and kind in _FIELDS
        for name in _FIELDS[kind] if known else ["articleBody", "description"]:
            _texts(value.get(name), out)
        for name in _LEADS.get(kind, []) if known else []:
            _structured(value.get(name), out, depth + 1)


def structured_text(root: Node) -> str:
    """Text of all ``application/ld+json`` scripts, blank lines between the parts."""
    out: list[str] = []
    for x in root.iter():
        if x.tag == "script" and x.attrs.get("type", "").lower() == "application/ld+json":
            _structured(loose_json(x.text().strip()), out)
    return "\n\n".join(p for p in out if p.strip())


def is_prose(text: str) -> bool:
    low = text[:8].lower()
    return len(text) >= PROSE and " " in text and not low.startswith(("http://", "https://", "data:", "//", "{", "[", "--"))


def framework_text(root: Node) -> str:
    """Prose in a framework's page state, each string once, in order."""
    script = next((x for x in root.iter() if x.tag == "script" and x.attrs.get("id") == "__NEXT_DATA__"), None)
    state = loose_json(script.text()) if script is not None else None
    if state is None:
        return ""
    if isinstance(state, dict) and isinstance(state.get("props"), dict) and "pageProps" in state["props"]:
        state = state["props"]["pageProps"]
    out: dict[str, None] = {}
    stack = [(state, 0)]
    while stack and len(out) < MOST:
        value, depth = stack.pop()
        if isinstance(value, str):
            if is_prose(value):
                out.setdefault(value)
        elif depth < DEEPEST and isinstance(value, dict):
            stack += [(v, depth + 1) for k, v in reversed(value.items()) if k not in _NO_PROSE]
        elif depth < DEEPEST and isinstance(value, list):
            stack += [(v, depth + 1) for v in reversed(value)]
    return "\n\n".join(out)


def forum_text(root: Node) -> str:
    """Title and posts of a topic kept as doubly encoded JSON in ``data-preloaded``."""
    for x in root.iter():
        if "data-preloaded" not in x.attrs:
            continue
        outer = loose_json(x.attrs["data-preloaded"])
        for name, inner in outer.items() if isinstance(outer, dict) else []:
            topic = loose_json(inner) if name.startswith("topic_") and isinstance(inner, str) else None
            if not isinstance(topic, dict):
                continue
            stream = topic.get("post_stream")
            posts = stream.get("posts", []) if isinstance(stream, dict) else []
            cooked = [_html.unescape(_flat(p["cooked"])) for p in posts if isinstance(p, dict) and isinstance(p.get("cooked"), str)]
            title = topic.get("title")
            return "\n\n".join([title] * isinstance(title, str) + [c for c in cooked if c])
    return ""


def bare_text(root: Node) -> str:
    """Text of the body outside navigation, header, footer and aside, in document order."""
    out: list[str] = []
    stack: list = [body_of(root)]
    while stack:
        x = stack.pop()
        if type(x) is str:
            if x.strip():
                out.append(" ".join(x.split()))
        elif x.tag not in ("nav", "header", "footer", "aside", "script", "style", "noscript", "template", "svg", "select"):
            stack.extend(reversed(x.children))
    return "\n".join(out)


_WAYS = (("json_ld", structured_text, 0.7), ("next", framework_text, 0.65), ("discourse", forum_text, 0.7), ("body", bare_text, 0.5))


def rescue(root: Node, least: int = ENOUGH) -> tuple[str, float, str] | None:
    """(way, confidence, text) of the first way that gives at least ``least`` characters."""
    for name, way, confidence in _WAYS:
        text = way(root)
        if len(text) >= least:
            return name, confidence, text
    return None
