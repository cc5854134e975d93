"""Finding a content fence in a byte stream with bounded memory.

A template has three tag patterns: one that shows the stream is of the known kind, one
that opens the content and one that closes it.  ``Scanner`` takes chunks of any size and
keeps only an unfinished tag between them; the result does not depend on where chunks are
cut.  Unlike a scanner that forgets it was inside a script when a chunk ends there, this
one remembers the region it is skipping.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from ..functions.stability import is_stable
from ..html.shred import Dom

AWAIT_PREFIX, AWAIT_START, CAPTURING, CAPTURED, BAILED = "AwaitPrefix", "AwaitContentStart", "Capturing", "Captured", "Bailed"
BUDGET, OPEN_SCAN, CLOSE_SCAN, CARRY_LIMIT = 5_000_000, 512, 64, 1 << 20
_CLOSERS = {"comment": re.compile(rb"-->"), "cdata": re.compile(rb"\]\]>"), "script": re.compile(rb"</script\s*>", re.I), "style": re.compile(rb"</style\s*>", re.I)}
_OPENERS = ((b"<!--", "comment"), (b"<![CDATA[", "cdata"), (b"<script", "script"), (b"<style", "style"))
_TAG = re.compile(rb"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\s|/)(?:[^>\"']|\"[^\"]*\"|'[^']*')*)?>")
_ATTR = re.compile(rb"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'/]+)))?")


@dataclass(frozen=True)
class Pattern:
    """A tag: name, required attribute values (exact, in any order), opening or closing, longest tag looked at."""

    tag: str
    attrs: tuple[tuple[str, str], ...] = ()
    is_close: bool = False
    max_scan: int = OPEN_SCAN

    def fits(self, closing: bytes, name: bytes, attrs: bytes | None, size: int) -> bool:
        if bool(closing) != self.is_close or name != self.tag.encode() or size > self.max_scan:
            return False
        if self.is_close:
            return not (attrs or b"").strip()
        have = {}
        for k, a, b, c in _ATTR.findall(attrs or b""):
            have.setdefault(k, a or b or c)
        return all(have.get(k.encode()) == v.encode() for k, v in self.attrs)


@dataclass(frozen=True)
class FenceTemplate:
    host: str
    prefix: Pattern
    start: Pattern
    end: Pattern
    version: int = 1
    template_id: str = ""
    bailout: int = BUDGET
    max_capture: int = BUDGET


@dataclass
class Scanner:
    """``feed`` bytes, then ``flush``; ``verdict`` is Continue, Captured or Bailout; ``range`` the captured bytes."""

    template: FenceTemplate
    fence: str = AWAIT_PREFIX
    total: int = 0
    since: int = 0
    begin: int = -1
    finish: int = -1
    depth: int = 0
    skip: str = ""
    carry: bytes = b""

    @property
    def verdict(self) -> str:
        return {CAPTURED: "Captured", BAILED: "Bailout"}.get(self.fence, "Continue")

    def _move(self, n: int) -> bool:
        """Counts bytes as read; true when a budget is spent."""
        self.total += n
        self.since += n
        spent = self.since > self.template.bailout if self.fence in (AWAIT_PREFIX, AWAIT_START) else self.fence == CAPTURING and self.total - self.begin > self.template.max_capture
        if spent:
            self.fence = BAILED
        return spent

    def feed(self, chunk: bytes, last: bool = False) -> str:
        if self.fence in (CAPTURED, BAILED):
            return self.verdict
        data, self.carry, at = self.carry + chunk, b"", 0
        n = len(data)
        while at < n:
            if self.skip:
                m = _CLOSERS[self.skip].search(data, at)
                if m is None:  # keep what could be the start of the closer
                    keep = 0 if last else min(n - at, 64)
                    if self._move(n - at - keep):
                        return self.verdict
                    self.carry = data[n - keep :] if keep else b""
                    return self.verdict
                if self._move(m.end() - at):
                    return self.verdict
                at, self.skip = m.end(), ""
                continue
            lt = data.find(b"<", at)
            if lt < 0:
                self._move(n - at)
                return self.verdict
            if lt > at and self._move(lt - at):
                return self.verdict
            at = lt
            region = self._region(data, at)
            if region is None and not last:
                break
            if region:
                kind, size = region
                if self._move(size):
                    return self.verdict
                at, self.skip = at + size, kind
                continue
            m = _TAG.match(data, at)
            if m is None:
                if not last and self._open_tag(data, at):
                    break
                if self._move(1):
                    return self.verdict
                at += 1
                continue
            self._tag(m)
            if self.fence == CAPTURED or self._move(m.end() - at if self.fence != CAPTURED else 0):
                return self.verdict
            at = m.end()
        self.carry = data[at:]
        if len(self.carry) > CARRY_LIMIT:
            raise ValueError("an unfinished tag is longer than the carry limit")
        return self.verdict

    def _region(self, data: bytes, at: int):
        """(kind, opener's size) of a skipped region here, () for none, None when more bytes must tell."""
        for opener, kind in _OPENERS:
            head = data[at : at + len(opener)]
            named = kind in ("script", "style")
            same = head.lower() == opener if named else head == opener
            if same and len(head) == len(opener):
                if not named:
                    return kind, len(opener)
                after = data[at + len(opener) : at + len(opener) + 1]
                if not after:
                    return None
                if after in b" \t\n\r\f/>":
                    return kind, len(opener)
            elif len(head) < len(opener) and (opener.startswith(head.lower()) if named else opener.startswith(head)):
                return None
        return ()

    @staticmethod
    def _open_tag(data: bytes, at: int) -> bool:
        """Whether the bytes from here could still become a tag."""
        rest = data[at:]
        return bool(re.match(rb"</?[A-Za-z]?[A-Za-z0-9:-]*(?:(?:\s|/)(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:\"[^\"]*|'[^']*)?)?\Z", rest))

    def _tag(self, m: re.Match) -> None:
        t = self.template
        size = m.end() - m.start()
        closing, name, attrs = m[1], m[2], m[3]
        if self.fence == AWAIT_PREFIX and t.prefix.fits(closing, name, attrs, size):
            self.fence, self.since = AWAIT_START, -size
        elif self.fence == AWAIT_START and t.start.fits(closing, name, attrs, size):
            self.fence, self.begin, self.depth, self.since = CAPTURING, self.total, 1, -size
        elif self.fence == CAPTURING:
            if t.end.fits(closing, name, attrs, size):
                if self.depth <= 1:
                    self.total += size
                    self.finish, self.fence = self.total, CAPTURED
                else:
                    self.depth -= 1
            elif name == t.start.tag.encode():
                self.depth += -1 if closing and self.depth else 0 if closing else 1

    def flush(self) -> str:
        """The end of the stream: what is not captured by now is a bailout."""
        if self.fence not in (CAPTURED, BAILED):
            rest, self.carry = self.carry, b""
            if rest:
                self.feed(rest, last=True)
            if self.fence not in (CAPTURED, BAILED):
                self.fence = BAILED
        return self.verdict

    def state(self) -> tuple:
        return (self.fence, self.total, self.since, self.begin, self.finish, self.depth, self.skip, self.carry)

    @classmethod
    def resume(cls, template: FenceTemplate, state: tuple) -> "Scanner":
        return cls(template, *state)


def scan(template: FenceTemplate | None, data: bytes) -> tuple[str, int, int]:
    """(verdict, start, end) of one whole stream; NoTemplate without a template."""
    if template is None:
        return "NoTemplate", -1, -1
    s = Scanner(template)
    s.feed(data)
    s.flush()
    return s.verdict, s.begin if s.fence == CAPTURED else -1, s.finish


def induce_fence(host: str, source: str) -> FenceTemplate | None:
    """A template from one page: header, nav or body shows the kind; article, main or the parent of two paragraphs holds the content."""
    dom = Dom.of(source)
    tag_at = lambda *names: next((i for t in names for i in range(len(dom)) if dom.nodes[i].tag == t), None)
    prefix = tag_at("header", "nav", "body")
    content = tag_at("article", "main")
    if content is None:
        paragraphs = [i for i in range(len(dom)) if dom.nodes[i].tag == "p"]
        content = next((dom.parent[b] for a, b in zip(paragraphs, paragraphs[1:]) if dom.parent[a] == dom.parent[b]), None)
    if not host or prefix is None or content is None or content <= 0 and dom.nodes[content].tag == "html":
        return None
    x = dom.nodes[content]
    attrs: tuple = ()
    if sum(y.tag == x.tag for y in dom.nodes) > 1:
        if x.attrs.get("id") and is_stable(x.attrs["id"]):
            attrs = (("id", x.attrs["id"]),)
        elif any(map(is_stable, x.classes)):
            # The whole attribute value: a byte pattern compares whole values.
            attrs = (("class", x.attrs["class"]),)
    return FenceTemplate(host, Pattern(dom.nodes[prefix].tag), Pattern(x.tag, attrs), Pattern(x.tag, (), True, CLOSE_SCAN))


@dataclass
class CaptureDrift:
    """A host's capture lengths: drift after three lengths in a row more than 30 % off the mean, cadence at every tenth."""

    count: int = 0
    ewma: float = 0.0
    hits: int = 0

    def step(self, length: int) -> str | None:
        self.count += 1
        if self.ewma <= 0:
            self.ewma = float(length)
        else:
            before, self.ewma = self.ewma, 0.2 * length + 0.8 * self.ewma
            self.hits = self.hits + 1 if abs(length - before) / before > 0.30 else 0
        if self.hits >= 3:
            self.hits = 0
            return "drift"
        return "cadence" if self.count % 10 == 0 else None


def as_row(t: FenceTemplate) -> dict:
    return asdict(t)


__all__ = ["CaptureDrift", "FenceTemplate", "Pattern", "Scanner", "as_row", "induce_fence", "scan"]
