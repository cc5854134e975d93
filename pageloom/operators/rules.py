"""Identity claims, ancestor chains, and the rules learned from a page's blocks.

A claim says what identifies an element: tag, stable id, stable classes, data and aria
attributes, role.  A chain is a list of claims from an ancestor down to the element, each
the parent of the next.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..functions.stability import is_stable
from ..html.css import BadSelector, select
from ..html.shred import Dom
from .classify import Block, furnish, links_of, pruned, title_of
from .markdown import to_markdown

MAX_ANCESTORS = 8
# Costs of the selector distance.
TAG_COST, ID_COST, ATTR_COST, ONE_SIDED, PAD, DECAY = 10.0, 5.0, 1.0, 0.5, 1.0, 0.5
# Roles of which a page can have several blocks.
MANY = frozenset("RepeatedItem Heading Table CodeBlock Form RelatedLinks Sidebar SecondaryNavigation Advertisement Boilerplate Unknown Article".split())
CONTENT = frozenset("MainContent Article Title Heading Summary Table CodeBlock RepeatedItem".split())


def claim_of(dom: Dom, i: int) -> dict:
    x = dom.nodes[i]
    ident = x.attrs.get("id")
    return {
        "tag": x.tag,
        "id": ident if ident and is_stable(ident) else None,
        "classes": sorted({c for c in x.classes if is_stable(c)}),
        "data": {k: v for k, v in x.attrs.items() if k.startswith("data-") and len(v) <= 64},
        "aria": {k: v for k, v in x.attrs.items() if k.startswith("aria-") and len(v) <= 64},
        "role": x.attrs.get("role"),
    }


def claims_match(dom: Dom, i: int, claim: dict) -> bool:
    """Whether everything a claim says is true of an element."""
    x = dom.nodes[i]
    attrs = x.attrs
    return (
        x.tag == claim["tag"]
        and (claim.get("id") is None or attrs.get("id") == claim["id"])
        and set(claim.get("classes") or ()) <= set(x.classes)
        and all(attrs.get(k) == v for part in ("data", "aria") for k, v in (claim.get(part) or {}).items())
        and (claim.get("role") is None or attrs.get("role", "").lower() == claim["role"].lower())
    )


def match_chain(dom: Dom, chain: list[dict]) -> list[int]:
    """Elements that fit a chain: the last claim, and each parent the claim before. Empty chains and tags match nothing."""
    if not chain or any(not c.get("tag") for c in chain):
        return []
    out = []
    for i in range(len(dom)):
        at = i
        for claim in reversed(chain):
            if at < 0 or not claims_match(dom, at, claim):
                break
            at = dom.parent[at]
        else:
            out.append(i)
    return out


def _weaker(claim: dict) -> Iterable[dict]:
    """Single-feature claims of an element, the most telling first: id, classes, data, aria, role, tag alone."""
    bare = {"tag": claim["tag"], "id": None, "classes": [], "data": {}, "aria": {}, "role": None}
    if claim["id"]:
        yield bare | {"id": claim["id"]}
    for c in claim["classes"]:
        yield bare | {"classes": [c]}
    for part in ("data", "aria"):
        for k, v in sorted(claim[part].items()):
            yield bare | {part: {k: v}}
    if claim["role"]:
        yield bare | {"role": claim["role"]}
    yield bare


def chain_for(dom: Dom, i: int) -> tuple[list[dict], bool]:
    """The shortest chain of simple claims that only ``i`` fits, and whether it does."""
    chain: list[dict] = []
    at, left = i, None
    for _ in range(MAX_ANCESTORS + 1):
        best, fewest = None, None
        for claim in _weaker(claim_of(dom, at)):
            hits = match_chain(dom, [claim, *chain])
            if i in hits and (fewest is None or len(hits) < fewest):
                best, fewest = claim, len(hits)
            if fewest == 1:
                break
        chain.insert(0, best)
        left = fewest
        if left == 1 or dom.parent[at] < 0:
            break
        at = dom.parent[at]
    return chain, left == 1


def shared_chain(dom: Dom, targets: list[int]) -> tuple[list[dict], bool]:
    """A chain that fits exactly the targets: what their claims have in common, then common ancestors."""
    claims = [claim_of(dom, i) for i in targets]
    first = claims[0]
    if any(c["tag"] != first["tag"] for c in claims):
        return [], False
    leaf = {
        "tag": first["tag"],
        "id": None,
        "classes": sorted(set.intersection(*(set(c["classes"]) for c in claims))),
        "data": {k: v for k, v in first["data"].items() if all(c["data"].get(k) == v for c in claims)},
        "aria": {k: v for k, v in first["aria"].items() if all(c["aria"].get(k) == v for c in claims)},
        "role": first["role"] if all(c["role"] == first["role"] for c in claims) else None,
    }
    chain, want = [leaf], set(targets)
    ups = {dom.parent[i] for i in targets}
    for _ in range(MAX_ANCESTORS):
        if set(match_chain(dom, chain)) == want:
            return chain, True
        if len(ups) != 1 or (up := ups.pop()) < 0:
            break
        chain.insert(0, next(_weaker(claim_of(dom, up))))
        ups = {dom.parent[up]}
    return chain, set(match_chain(dom, chain)) == want


def chain_css(chain: list[dict]) -> str:
    """A chain as a selector with child combinators."""

    def quote(name: str) -> str:
        return "".join(c if c.isalnum() or c in "-_" or ord(c) > 127 else "\\" + c for c in name)

    steps = []
    for c in chain:
        step = c["tag"] + (f"#{quote(c['id'])}" if c.get("id") else "") + "".join(f".{quote(x)}" for x in c.get("classes") or [])
        for part in ("data", "aria"):
            step += "".join(f'[{k}="{v}"]' for k, v in sorted((c.get(part) or {}).items()))
        steps.append(step + (f'[role="{c["role"]}"]' if c.get("role") else ""))
    return " > ".join(steps)


def css_of_xpath(xpath: str) -> str:
    """An element path without positions, as child combinators, from body down."""
    steps = [step.split("[")[0].lower() for step in xpath.strip("/").split("/")]
    return " > ".join(steps[1:] if steps[0] == "html" and len(steps) > 1 else steps)


def position_cost(a: dict | None, b: dict | None) -> float:
    if a is None or b is None:
        return PAD
    if a["tag"] != b["tag"]:
        return TAG_COST
    if a.get("id") and b.get("id"):
        return 0.0 if a["id"] == b["id"] else ID_COST
    cost = ONE_SIDED * (bool(a.get("id")) != bool(b.get("id")))
    p, q = list(a.get("classes") or []), list(b.get("classes") or [])
    apart = sum(c not in q for c in p) + sum(c not in p for c in q)
    if apart:
        cost += apart / (sum(c in q for c in p) + apart + 1)
    for part in ("data", "aria"):
        x, y = a.get(part) or {}, b.get(part) or {}
        for k in x.keys() | y.keys():
            cost += 0.0 if x.get(k) == y.get(k) and k in x and k in y else ATTR_COST if k in x and k in y else ONE_SIDED
    r, s = a.get("role"), b.get("role")
    if r is None and s is None:
        return cost
    return cost + (ONE_SIDED if r is None or s is None else 0.0 if r.lower() == s.lower() else ATTR_COST)


def selector_distance(a: list[dict] | None, b: list[dict] | None) -> float:
    """Distance of two chains, compared from the leaf up, each step counting half the one before."""
    a, b = list(a or []), list(b or [])
    return sum(
        DECAY**k * position_cost(a[-1 - k] if k < len(a) else None, b[-1 - k] if k < len(b) else None) for k in range(max(len(a), len(b)))
    )


def induce(dom: Dom | None, blocks: list[Block]) -> dict:
    """An extractor - rules and centroid - from a page's blocks. Without the page its rules are generalised paths."""
    groups: dict[str, list[Block]] = {}
    for b in blocks:
        groups.setdefault(b.role, []).append(b)
    rules = []
    for role, members in groups.items():
        confidence = sum(b.confidence for b in members) / len(members)
        at = [dom.where[id(b.node)] for b in members if dom is not None and b.node is not None and id(b.node) in dom.where]
        chains: list[tuple[list[dict], bool]] = []
        if at:
            if role in MANY and len(at) > 1:
                chain, exact = shared_chain(dom, at)
                chains = [(chain, True)] if exact else [chain_for(dom, i) for i in at]
            else:
                chains = [chain_for(dom, i) for i in at]
        if chains:
            for chain, sure in chains:
                rules.append({"role": role, "css": [chain_css(chain)], "confidence": confidence if sure else 0.0, "claims": chain})
        else:
            rules.append({"role": role, "css": list(dict.fromkeys(css_of_xpath(b.xpath) for b in members)), "confidence": confidence, "claims": None})
    for k, r in enumerate(rules):
        r["rule_id"] = f"r{k:04d}"
    centroid = {
        role: {
            "n": len(m),
            "link_density": sum(b.link_density for b in m) / len(m),
            "text_length": sum(b.text_length for b in m) / len(m),
            "depth": sum(b.xpath.count("/") for b in m) / len(m),
        }
        for role, m in groups.items()
    }
    return {"rules": rules, "centroid": centroid, "drift": 0.0}


def apply_rules(dom: Dom, extractor: dict) -> tuple[list[Block], int, int]:
    """(blocks in document order, rules that hit, rules that missed). Bad selectors are misses."""
    picked: dict[int, tuple[str, float]] = {}
    hit = missed = 0
    for rule in extractor["rules"]:
        found: list[int] = []
        if rule.get("claims"):
            found = match_chain(dom, rule["claims"])
        else:
            for css in rule.get("css") or []:
                try:
                    found += select(dom, css)
                except BadSelector:
                    continue
        if found:
            hit += 1
            for i in found:
                picked.setdefault(i, (rule["role"], rule.get("confidence", 1.0)))
        else:
            missed += 1
    out: list[Block] = []
    if not any(r["role"] == "Title" for r in extractor["rules"]):
        title = title_of(dom)
        if title is not None:
            out.append(title)
    for i in sorted(picked):
        role, confidence = picked[i]
        node = pruned(dom, i, furnish(dom, i)) if role in ("MainContent", "Article", "RepeatedItem") else dom.nodes[i]
        text = node.text()
        if not text.strip():
            continue
        density = sum(len(x.text()) for x in node.iter() if x.tag == "a") / len(text)
        out.append(Block(role, confidence, text.strip(), to_markdown(node), dom.xpath(i), len(text), density, links_of(node), dom.nodes[i]))
    for k, b in enumerate(out):
        b.ord = k
    return out, hit, missed


def is_broken(blocks: list[Block], hit: int, missed: int) -> bool:
    """Whether applied rules gave too little text, too little content, too many misses, or link-ridden content."""
    total = sum(len(b.text) for b in blocks)
    content = sum(len(b.text) for b in blocks if b.role in CONTENT)
    if total < 200 or (total >= 1000 and content < 100):
        return True
    if hit + missed >= 3 and missed / (hit + missed) >= 0.7:
        return True
    return any(
        b.role in ("MainContent", "Article") and len(b.text) >= 400 and (b.link_density >= 0.5 or sum(len(t) <= 8 for t, _, _ in b.links) >= 10) for b in blocks
    )


def drift_of(extractor: dict, blocks: list[Block]) -> float:
    """0 to 1: the part of rules without a block, plus half the mean change of density and length."""
    rules = extractor["rules"]
    if not rules:
        return 0.0
    by_role: dict[str, list[Block]] = {}
    for b in blocks:
        by_role.setdefault(b.role, []).append(b)
    matched, changes = 0, []
    for r in rules:
        hits = by_role.get(r["role"])
        if not hits:
            continue
        matched += 1
        c = extractor["centroid"].get(r["role"])
        if c:
            density = abs(sum(b.link_density for b in hits) / len(hits) - c["link_density"])
            length = abs(sum(b.text_length for b in hits) / len(hits) - c["text_length"]) / max(1.0, c["text_length"])
            changes.append((min(1.0, density) + min(1.0, length)) / 2)
    change = sum(changes) / len(changes) if changes else 0.0
    return min(1.0, max(0.0, 1 - matched / len(rules) + 0.5 * change))
