"""Structured Streaming: learning, fence scanning, capture drift and monitoring as keyed state.

Rows of a key are sorted by time (or chunk number) inside a micro-batch before they are
folded; chunks that come early wait in the state until they are due.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..html.shred import Dom
from ..operators.fingerprint import fingerprint
from ..operators.learn import RESULT, HostState, plain_markdown
from .fence import CaptureDrift, FenceTemplate, Pattern, Scanner, induce_fence, scan

_RESULT = [c.split()[0] for c in RESULT.split(", ")]


def learn_stream(pages: DataFrame) -> DataFrame:
    """Result rows of a stream of ``host, page, at, source``; the same fold as in batch, one state per host."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        host = pickle.loads(state.get[0]) if state.exists else HostState(key[0])
        for pdf in frames:
            rows = []
            for page, at, source in pdf.sort_values(["at", "page"])[["page", "at", "source"]].itertuples(index=False):
                dom = Dom.of(source)
                rows.append({"host": key[0], "page": page} | host.step(dom, fingerprint(dom), at.timestamp(), plain_markdown))
            yield pd.DataFrame(rows, columns=_RESULT)
        for t in host.templates:
            t.extractor["rules"] = [dict(r) for r in t.extractor["rules"]]
        state.update((pickle.dumps(host),))

    return pages.groupBy("host").applyInPandasWithState(step, RESULT, "state binary", "append", GroupStateTimeout.NoTimeout)


def template_of(row: dict) -> FenceTemplate:
    """A fence template from its stored JSON form (names in upper camel case, as exported)."""
    pattern = lambda p, scan_: Pattern(p["TagName"].lower(), tuple((a["Name"].lower(), a["Value"]) for a in p.get("RequiredAttributes") or []), bool(p.get("IsClose")), scan_)
    return FenceTemplate(
        row["Host"].lower(), pattern(row["PrefixPattern"], 512), pattern(row["ContentStartPattern"], 512), pattern(row["ContentEndPattern"], 64), int(row.get("Version", 1)), row.get("TemplateId", ""),
        int(row.get("BailoutBytes", 5_000_000)), int(row.get("MaxCaptureBytes", 5_000_000)),
    )


VERDICT = "stream_id string, host string, verdict string, capture_start bigint, capture_end bigint"


def scan_stream(chunks: DataFrame) -> DataFrame:
    """One verdict per stream of ``stream_id, host, template, seq, chunk, is_last``; template is JSON or null.

    The state holds the scanner, its unfinished tag and chunks that came early; memory per
    stream is bounded by the carry limit and by what is out of order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            due, waiting, saved, template, done = pickle.loads(state.get[0])
        else:
            due, waiting, saved, template, done = 0, {}, None, None, False
        out = []
        host = ""
        for pdf in frames:
            for h, t, seq, chunk, last in pdf[["host", "template", "seq", "chunk", "is_last"]].itertuples(index=False):
                host = h
                template = template if template is not None else (t if isinstance(t, str) else None)
                waiting[int(seq)] = (bytes(chunk), bool(last))
        if template is None and not done:
            out.append((key[0], host, "NoTemplate", -1, -1))
            done = True
        if not done:
            fence = template_of(json.loads(template))
            scanner = Scanner.resume(fence, saved) if saved else Scanner(fence)
            while due in waiting and not done:
                chunk, last = waiting.pop(due)
                scanner.feed(chunk)
                due += 1
                if last:
                    scanner.flush()
                if scanner.verdict != "Continue":
                    captured = scanner.verdict == "Captured"
                    out.append((key[0], host, scanner.verdict, scanner.begin if captured else -1, scanner.finish if captured else -1))
                    done = True
            saved = scanner.state()
        state.update((pickle.dumps((due, {} if done else waiting, saved, template, done)),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in VERDICT.split(", ")])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, VERDICT, "state binary", "append", GroupStateTimeout.NoTimeout)


def drift_stream(captures: DataFrame) -> DataFrame:
    """``host, at, reason`` whenever a host's template should be learned anew; captures: host, at, length."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        drift = CaptureDrift(*state.get) if state.exists else CaptureDrift()
        out = []
        for pdf in frames:
            for at, length in pdf.sort_values(["at", "length"])[["at", "length"]].itertuples(index=False):
                reason = drift.step(int(length))
                if reason:
                    out.append((key[0], at, reason))
        state.update((drift.count, drift.ewma, drift.hits))
        yield pd.DataFrame(out, columns=["host", "at", "reason"])

    return captures.groupBy("host").applyInPandasWithState(step, "host string, at timestamp, reason string", "count int, ewma double, hits int", "append", GroupStateTimeout.NoTimeout)


def hourly(events: DataFrame, at: str, kind: str, late: str = "10 minutes") -> DataFrame:
    """``hour, kind, n``: event counts in tumbling hours, with a watermark where the input is a stream."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, "1 hour"), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), F.col(kind).alias("kind"), "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """``key, began, ended, n``: a key's events no more than ``gap`` apart."""
    return events.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n")).select(F.col(key).alias("key"), F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "n")


def envelope(events: DataFrame, kind: str, at: str) -> DataFrame:
    """``value``: one JSON line per event with Kind, EmittedAt and Payload, for a text sink or a webhook."""
    rest = [c for c in events.columns if c not in (kind, at)]
    return events.select(F.to_json(F.struct(F.col(kind).alias("Kind"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("EmittedAt"), F.struct(*rest).alias("Payload"))).alias("value"))


def scan_pages(pages: DataFrame, fences: DataFrame, key: str, host: str, html: str) -> DataFrame:
    """Batch scan of whole pages with the latest readable template of their host (``host, blob``): VERDICT per page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, h, source, blob in zip(pdf["page"], pdf["host"], pdf["source"], pdf["blob"]):
                try:
                    template = template_of(json.loads(bytes(blob).decode("utf-8-sig"))) if blob is not None else None
                except (ValueError, KeyError, TypeError, AttributeError):
                    template = None
                verdict, a, b = scan(template, (source or "").encode())
                rows.append((page, h, verdict, a, b))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in VERDICT.split(", ")])

    own = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("page"), F.lower(F.coalesce(F.col(host), F.lit(""))).alias("host"), F.col(html).alias("source"))
    return own.join(fences.select("host", "blob"), "host", "left").mapInPandas(run, VERDICT)


# ------------------------------------------------------------------------------ fences in stores


def as_json(fence: FenceTemplate) -> str:
    """The stored JSON form of a fence template; ``template_of`` gives it back."""
    pattern = lambda p: {"TagName": p.tag, "IsClose": p.is_close, "RequiredAttributes": [{"Name": k, "Value": v} for k, v in p.attrs]}
    return json.dumps({
        "Host": fence.host, "Version": fence.version, "TemplateId": fence.template_id, "PrefixPattern": pattern(fence.prefix), "ContentStartPattern": pattern(fence.start), "ContentEndPattern": pattern(fence.end),
        "BailoutBytes": fence.bailout, "MaxCaptureBytes": fence.max_capture,
    }, sort_keys=True)


def usable(blob: bytes | str | None) -> bool:
    """Whether a stored fence can be scanned with."""
    if blob is None:
        return False
    try:
        template_of(json.loads(blob if isinstance(blob, str) else bytes(blob).decode("utf-8-sig")))
    except (ValueError, KeyError, TypeError, AttributeError):
        return False
    return True


def latest_usable(fences: DataFrame) -> DataFrame:
    """``host, blob``: of every host's stored fences (``host, version, file_seq, created_at, template_id, blob``) the newest that can be scanned with."""
    fits = F.pandas_udf(lambda s: s.map(usable), "boolean")
    rows = fences.where(F.col("host").isNotNull()).where(fits("blob"))
    return rows.groupBy(F.lower("host").alias("host")).agg(F.max_by("blob", F.struct("version", "file_seq", "created_at", "template_id")).alias("blob"))


def induced_fences(pages: DataFrame, key: str, host: str, html: str, at: str) -> DataFrame:
    """``host, blob``: a fence made from the earliest page of every host from which one can be made."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [induce_fence(h, s or "") if h else None for h, s in zip(pdf["host"], pdf["source"])]
            yield pdf[["host", "at", "page"]].assign(blob=[as_json(t).encode() if t else None for t in made])

    own = pages.where(F.col(key).isNotNull() & F.col(host).isNotNull()).select(F.lower(host).alias("host"), F.col(at).alias("at"), F.col(key).cast("string").alias("page"), F.col(html).alias("source"))
    made = own.mapInPandas(run, "host string, at timestamp, page string, blob binary").where("blob IS NOT NULL")
    return made.groupBy("host").agg(F.min_by("blob", F.struct("at", "page")).alias("blob"))


REFIT = "host string, at timestamp, page string, reason string, version int, changed boolean, template string"


class FenceState:
    """A host's fence as its captures come in: learned from the first page, made anew on drift, at a cadence, or when nothing is captured."""

    def __init__(self, host: str):
        self.host, self.fence, self.drift = host, None, CaptureDrift()

    def step(self, source: str) -> tuple[str, int, bool, str] | None:
        """Takes a page; (reason, version, changed, template) when the fence was made or looked at again."""
        if self.fence is None:
            self.fence = induce_fence(self.host, source)
            return ("first", 1, True, as_json(self.fence)) if self.fence else None
        verdict, a, b = scan(self.fence, source.encode())
        reason = self.drift.step(b - a) if verdict == "Captured" else "miss"
        if reason is None:
            return None
        new = induce_fence(self.host, source)
        old = (self.fence.prefix, self.fence.start, self.fence.end)
        changed = new is not None and (new.prefix, new.start, new.end) != old
        if changed:
            self.fence = replace(new, version=self.fence.version + 1)
            self.drift = CaptureDrift()
        return reason, self.fence.version, changed, as_json(self.fence)


def _refit(host: FenceState, pdf: pd.DataFrame) -> list[tuple]:
    return [(host.host, at, page, *made) for at, page, source in zip(pdf["at"], pdf["page"], pdf["source"]) if (made := host.step(source or ""))]


def refit_pages(pages: DataFrame, key: str, host: str, html: str, at: str) -> DataFrame:
    """REFIT rows of a batch of pages: when a host's fence was made, looked at again, and whether it became a new version.

    Pages stream through their host's task in order of time; the state is one fence.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: FenceState | None = None
        for pdf in batches:
            rows: list[tuple] = []
            for h, part in pdf.groupby("host", sort=False):
                if state is None or state.host != h:
                    state = FenceState(h)
                rows += _refit(state, part)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REFIT.split(", ")])

    own = pages.where(F.col(key).isNotNull() & F.col(host).isNotNull()).select(F.lower(host).alias("host"), F.col(at).alias("at"), F.col(key).cast("string").alias("page"), F.col(html).alias("source"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(parts, "host").dropDuplicates(["host", "page"]).sortWithinPartitions("host", "at", "page").mapInPandas(run, REFIT)


def refit_stream(pages: DataFrame, ttl: str = "30 days") -> DataFrame:
    """The same for a stream of ``host, at, page, source``; a host that is silent for ``ttl`` of processing time is forgotten."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        host = pickle.loads(state.get[0]) if state.exists else FenceState(key[0])
        rows: list[tuple] = []
        for pdf in frames:
            rows += _refit(host, pdf.sort_values(["at", "page"]))
        state.update((pickle.dumps(host),))
        state.setTimeoutDuration(int(pd.Timedelta(ttl).total_seconds() * 1000))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in REFIT.split(", ")])

    return pages.groupBy("host").applyInPandasWithState(step, REFIT, "state binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def every(stream: DataFrame, work, where: str, interval: str = "1 hour"):
    """Starts a periodic pass (such as mining) over a stream: ``work(batch)`` per trigger, at least a minute apart; a pass that fails is left for the next."""
    if pd.Timedelta(interval) < pd.Timedelta("1 minute"):
        raise ValueError("passes are at least a minute apart")

    def once(batch: DataFrame, number: int) -> None:
        try:
            work(batch)
        except Exception as problem:  # noqa: BLE001  # a bad pass must not end the stream
            print(f"pass {number} failed: {problem}")

    return stream.writeStream.trigger(processingTime=interval).option("checkpointLocation", where).foreachBatch(once).start()
