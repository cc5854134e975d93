"""Operator templates written by a language model: asking, mending, and working off a queue of hosts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..html.shred import Dom
from ..sources.operator_templates import TemplateError, dump, load
from .rules import apply_rules
from .skeleton import TextProvider, fenced_yaml, prompt_for, usable_rules

TRIES = 2


def complaint_of(answer: str, host: str, dom: Dom) -> tuple[dict | None, str]:
    """(template, what is wrong with the answer); a usable template comes with an empty complaint."""
    try:
        template = load(fenced_yaml(answer))
    except (TemplateError, ValueError) as problem:
        return None, str(problem)
    rules = usable_rules(dom, template["rules"])
    if not rules:
        return None, "no selector for MainContent matches anything on the page"
    lost = sorted({css for r in template["rules"] for css in r["selectors"]} - {css for r in rules for css in r["selectors"]})
    return template | {"host": host, "rules": rules}, f"these selectors match nothing: {', '.join(lost)}" if lost and len(rules) < len(template["rules"]) else ""


def induce_or_mend(provider: TextProvider, host: str, source: str, tries: int = TRIES) -> tuple[dict | None, int]:
    """(template, answers used): asks for a template, and asks again with what was wrong until one is usable or the tries are spent.

    Of several usable answers the last one counts; the host is ours whatever the answer says.
    """
    dom = Dom.of(source)
    prompt = ask = prompt_for(host, dom)
    best: dict | None = None
    for k in range(1, tries + 1):
        answer = provider(ask)
        template, complaint = complaint_of(answer, host, dom)
        best = template or best
        if template is not None and not complaint:
            return template, k
        ask = f"{prompt}\nYour last answer was:\n{answer}\nIt cannot be used as it is: {complaint}\nWrite the whole template again.\n"
    return best, tries


def mend(provider: TextProvider, template: dict, source: str, tries: int = TRIES) -> tuple[dict | None, int]:
    """The same for a template that no longer fits a page; one that still finds content there stays as it is and costs no answer."""
    from ..sources.operator_templates import as_extractor

    dom = Dom.of(source)
    blocks, hit, _ = apply_rules(dom, as_extractor(template))
    if hit and any(b.role == "MainContent" and b.text.strip() for b in blocks):
        return template, 0
    return induce_or_mend(provider, template["host"], source, tries)


def enriched(jobs: DataFrame, provider: TextProvider, by_hand: list[str] | None = None, tries: int = TRIES) -> DataFrame:
    """``host, status, answers, template``: queued hosts (``host, html``) worked off with a model.

    Hosts with a hand-written template are skipped; a host is done once, with its longest page;
    a template without MainContent is none.  Status is ``hand-written``, ``empty``, ``failed`` or ``made``,
    template its YAML text.  The provider travels to the executors.
    """
    known = frozenset(h.lower() for h in by_hand or [])
    one = jobs.where("host IS NOT NULL AND host <> ''").groupBy(F.lower("host").alias("host")).agg(F.max_by("html", F.struct(F.length("html"), F.md5("html"))).alias("html"))

    def work(host: str, source: str | None) -> tuple[str, int, str | None]:
        if host in known:
            return "hand-written", 0, None
        if not source or not source.strip():
            return "empty", 0, None
        try:
            template, answers = induce_or_mend(provider, host, source, tries)
        except OSError:  # the model cannot be reached: the host stays without a template
            return "failed", 0, None
        return ("made", answers, dump(template)) if template else ("failed", answers, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(h, *work(h, s)) for h, s in zip(pdf["host"], pdf["html"])]
            yield pd.DataFrame(rows, columns=["host", "status", "answers", "template"])

    return one.mapInPandas(run, "host string, status string, answers int, template string")


def into_store(write: Callable[[str, str], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over enriched rows: every template that was made goes to ``write(host, text)`` on the executors."""

    def each(rows) -> None:
        for r in rows:
            write(r["host"], r["template"])

    return lambda batch, _: batch.where("status = 'made'").foreachPartition(each)
