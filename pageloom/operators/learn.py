"""Matching pages to their host's templates and learning from them, in order.

Fingerprints are made in one Arrow pass before the shuffle.  The fold itself runs per host over rows sorted by time and page;
partitions are streamed, so a host's pages are never held together, only its templates are.
The same ``HostState.step`` serves batch and Structured Streaming.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..html.shred import Dom
from .classify import Block, blocks_of
from .fingerprint import BY_AGE, BY_COUNT, DAYS, FAST, SLOW, fingerprint
from .rescue import rescue
from .rules import CONTENT, apply_rules, drift_of, induce, is_broken

REFIT, MIN_OBSERVATIONS, HISTORY, RING, ALPHA, RESCUE_BELOW, GATE = 0.35, 5, 3, 100, 0.2, 200, 0.7
RESULT = (
    "host string, page string, status string, template_id string, version int, similarity double, true_jaccard double, observations int, n_blocks int, "
    "title string, markdown string, event string, old_version int, diff string"
)


@dataclass
class Template:
    template_id: str
    print: dict
    extractor: dict
    version: int = 1
    observations: int = 0
    first_seen: float = 0.0
    last_seen: float = 0.0
    bands: set = field(default_factory=set)
    ring: list = field(default_factory=list)
    retired: list = field(default_factory=list)


def likeness(a: dict, b: dict) -> float:
    return float(np.mean(np.asarray(a["minhash"]) == np.asarray(b["minhash"])))


def gram_cosine(a: dict, b: dict) -> float:
    dot = sum(v * b["grams"].get(k, 0.0) for k, v in a["grams"].items())
    return dot / (a["norm"] * b["norm"]) if a["norm"] and b["norm"] else 0.0


def diff_of(old: Template, extractor: dict, print_: dict) -> dict:
    """What a new version changes: roles added and removed, selectors changed, the ten gram counts that moved most."""
    def by_role(e: dict) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for r in e["rules"]:
            out.setdefault(r["role"], []).extend(c for c in r["css"] if c not in out.get(r["role"], []))
        return out

    a, b = by_role(old.extractor), by_role(extractor)
    p, q = old.print["grams"], print_["grams"]
    moved = sorted(((abs(q.get(k, 0) - p.get(k, 0)), k) for k in p.keys() | q.keys()), key=lambda x: (-x[0], x[1]))[:10]
    return {
        "added": sorted(b.keys() - a.keys()),
        "removed": sorted(a.keys() - b.keys()),
        "changed": sorted(r for r in a.keys() & b.keys() if a[r] != b[r]),
        "grams": [[k, p.get(k, 0.0), q.get(k, 0.0)] for d, k in moved if d],
        "jaccard_delta": 1 - likeness(old.print, print_),
    }


class HostState:
    """A host's templates. ``step`` takes the next page and gives its result row (RESULT without host and page)."""

    def __init__(self, host: str, learn: bool = True, stale_bands: bool = False, override: dict | None = None):
        self.host, self.learn, self.stale_bands, self.override = host, learn, stale_bands, override
        self.templates: list[Template] = []

    def _score(self, t: Template, sim: float, now: float) -> tuple:
        age = max(0.0, now - t.last_seen) / 86400.0
        return (-(sim + BY_COUNT * math.log1p(t.observations) + BY_AGE * math.exp(-age / DAYS)), t.template_id)

    def match(self, print_: dict, now: float) -> tuple[str, Template | None, float]:
        probe = set(enumerate(print_["bands"]))
        near = [(t, likeness(t.print, print_)) for t in self.templates if t.bands & probe]
        near = [(t, s) for t, s in near if s >= FAST]
        if near:
            t, _ = min(near, key=lambda x: self._score(x[0], x[1], now))
            return "FastPathHit", t, 1.0
        close = [(t, gram_cosine(t.print, print_)) for t in self.templates]
        close = [(t, s) for t, s in close if s >= SLOW]
        if close:
            t, s = min(close, key=lambda x: self._score(x[0], x[1], now))
            return "SlowPathMatch", t, s
        return "NovelEphemeral", None, 0.0

    def step(self, dom: Dom, print_: dict, now: float, profile_markdown, classify: Callable[[Dom], list[Block]] = blocks_of) -> dict:
        """The page is only classified anew where its template's rules do not serve: for a first page, a broken template, or one that has drifted."""
        if self.override is not None:
            applied, hit, _ = apply_rules(dom, self.override)
            if hit:  # a hand-written template that finds nothing leaves the page to the learned ones
                return self._row("OperatorOverride", None, 1.0, None, dom, applied, profile_markdown, None, None, None) | {"template_id": f"operator:{self.host}", "version": self.override.get("version", 1)}
        status, t, similarity = self.match(print_, now)
        made: list[list[Block]] = []

        def fresh() -> list[Block]:
            if not made:
                made.append(classify(dom))
            return made[0]

        event, old_version, diff = None, None, None
        true = likeness(t.print, print_) if t else None
        if t is not None:
            applied, hit, missed = apply_rules(dom, t.extractor)
            broken = is_broken(applied, hit, missed)
            blocks = fresh() if broken else applied
            if self.learn:
                t.observations += 1
                t.last_seen = max(t.last_seen, now)
                t.ring = (t.ring + [(now, similarity)])[-RING:]
                force = broken
                accumulated = t.extractor["drift"]
                basis = fresh() if broken or accumulated >= GATE * REFIT else blocks
                if force or t.observations >= MIN_OBSERVATIONS:
                    drift = ALPHA * drift_of(t.extractor, basis) + (1 - ALPHA) * accumulated
                    t.extractor["drift"] = drift
                    if force or drift >= REFIT:
                        new = induce(None, fresh())
                        diff, old_version = diff_of(t, new, print_), t.version
                        t.retired = ([(t.version, t.extractor, now, "signal-loss" if force else "drift")] + t.retired)[:HISTORY]
                        t.extractor, t.print, t.version = new, print_, t.version + 1
                        if not self.stale_bands:
                            t.bands = set(enumerate(print_["bands"]))
                        status, event, blocks = "Refit", "version-change", fresh()
        else:
            blocks = fresh()
        if t is None and self.learn:
            status, event = "Novel", "new-template"
            ident = hashlib.sha256(f"{self.host}|{print_['hex']}|{len(self.templates)}".encode()).hexdigest()[:32]
            t = Template(ident, print_, induce(dom, blocks), 1, 1, now, now, set(enumerate(print_["bands"])))
            self.templates.append(t)
        return self._row(status, t, similarity, true, dom, blocks, profile_markdown, event, old_version, diff)

    def _row(self, status: str, t: Template | None, similarity: float, true: float | None, dom: Dom, blocks: list[Block], profile_markdown, event: str | None, old_version: int | None, diff: dict | None) -> dict:
        content = sum(len(b.text) for b in blocks if b.role in CONTENT)
        if content < RESCUE_BELOW:
            saved = rescue(dom.root)
            if saved:
                blocks = [Block("MainContent", saved[1], saved[2], saved[2], "", len(saved[2]), 0.0), *blocks]
        title = next((b.text for b in blocks if b.role == "Title"), None)
        return {
            "status": status, "template_id": t.template_id if t else None, "version": t.version if t else None, "similarity": similarity, "true_jaccard": true,
            "observations": t.observations if t else 0, "n_blocks": len(blocks), "title": title, "markdown": profile_markdown(blocks), "event": event,
            "old_version": old_version, "diff": json.dumps(diff, sort_keys=True) if diff else None,
        }


def plain_markdown(blocks: list[Block]) -> str:
    """The default profile's Markdown of kernel blocks."""
    from ..model import PROFILES
    from .markdown import SHORT

    keep = PROFILES["RagFull"]
    parts = [
        (b.markdown.strip() or b.text) for b in blocks if b.role in keep and (b.role in ("Title", "Heading") or len(b.text.strip()) >= SHORT or b.links)
    ]
    return "\n\n".join(p for p in parts if p).strip() + "\n"


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fingerprints, as JSON, next to the page: what the fold needs without doing it again."""
    for pdf in batches:
        yield pdf.assign(print=[json.dumps(fingerprint(x)) for x in pdf["source"]])


def _fold(learn: bool, until: float | None, overrides: dict[str, dict]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: HostState | None = None
        for pdf in batches:
            rows = []
            for host, page, at, source, print_ in zip(pdf["host"], pdf["page"], pdf["at"], pdf["source"], pdf["print"]):
                if state is None or state.host != host:
                    state = HostState(host, learn, override=overrides.get(host))
                now = at.timestamp() if at is not None and at is not pd.NaT else 0.0
                state.learn = learn and (until is None or now < until)
                mark = json.loads(print_)
                mark["minhash"] = np.array(mark["minhash"])
                rows.append({"host": host, "page": page} | state.step(Dom.of(source), mark, now, plain_markdown))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield out

    return run


def learned(pages: DataFrame, key: str, host: str, html: str, at: str, learn: bool = True, until: float | None = None, templates: list[dict] | None = None, snapshots: bool = False) -> DataFrame:
    """One result row (RESULT) per page, its host's templates learned in order of ``at`` and key.

    Exact repeats of a key count once; null keys are left out; null hosts form the host ''; null
    pages are empty pages.  With ``learn`` false nothing is remembered and unmatched pages are
    NovelEphemeral; with ``until`` (seconds) the templates learned before it are frozen then.
    Hand-written ``templates`` come before all matching (OperatorOverride), deterministic
    snapshots among them only when asked for.
    """
    from ..sources.operator_templates import as_extractor

    overrides = {t["host"].lower(): as_extractor(t) | {"version": t.get("version", 1)} for t in templates or [] if snapshots or not t.get("deterministic")}
    rows = pages.where(F.col(key).isNotNull()).select(
        F.lower(F.coalesce(F.col(host), F.lit(""))).alias("host"), F.col(key).cast("string").alias("page"), F.coalesce(F.col(at), F.timestamp_seconds(F.lit(0))).alias("at"), F.coalesce(F.col(html), F.lit("")).alias("source")
    )
    ready = rows.mapInPandas(_prepare, "host string, page string, at timestamp, source string, print string")
    # One shuffle: the number is given, so that hosts are not gathered into fewer tasks, and repeated pages go inside it.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hosts = ready.repartition(parts, "host").dropDuplicates(["host", "page"])
    return hosts.sortWithinPartitions("host", "at", "page").mapInPandas(_fold(learn, until, overrides), RESULT)


def events(results: DataFrame) -> DataFrame:
    """``kind, host, page, template_id, old_version, new_version, diff`` of results that made a template or a version."""
    return results.where("event IS NOT NULL").select(F.col("event").alias("kind"), "host", "page", "template_id", "old_version", F.col("version").alias("new_version"), "diff")
