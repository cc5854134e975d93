"""A tag reader for byte streams: chunks in, tags out, only an unfinished tag kept between them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions.hashing import xxh64
from .fence import _ATTR, _CLOSERS, _OPENERS, _TAG

CARRY = 1 << 20
_UNFINISHED = re.compile(rb"</?[A-Za-z]?[A-Za-z0-9:-]*(?:(?:\s|/)(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:\"[^\"]*|'[^']*)?)?\Z")


@dataclass(frozen=True)
class Tag:
    """A tag and where it stands in the stream, end exclusive."""

    name: str
    closing: bool
    empty: bool
    attrs: tuple[tuple[str, str], ...]
    begin: int
    end: int

    @property
    def name_hash(self) -> int:
        return xxh64(self.name.encode())

    @property
    def attr_hashes(self) -> tuple[int, ...]:
        """One hash per attribute, of name and value."""
        return tuple(xxh64(f"{k}={v}".encode()) for k, v in self.attrs)


def attributes(raw: bytes | None) -> tuple[tuple[str, str], ...]:
    """Attributes in order, names in lower case, the first of a repeated name; without a value it is empty."""
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(raw or b""):
        if name != b"/":
            out.setdefault(name.decode("utf-8", "replace").lower(), (double or single or bare).decode("utf-8", "replace"))
    return tuple(out.items())


@dataclass
class TagReader:
    """``feed`` bytes in chunks of any size, then ``close``; both give the tags that are complete. Comments, scripts and styles hold none."""

    at: int = 0
    carry: bytes = b""
    skip: str = ""

    def feed(self, chunk: bytes, last: bool = False) -> Iterator[Tag]:
        data, base = self.carry + chunk, self.at
        pos, n = 0, len(self.carry) + len(chunk)
        self.carry = b""
        while pos < n:
            if self.skip:
                m = _CLOSERS[self.skip].search(data, pos)
                if m is None:
                    pos = n if last else max(pos, n - 64)
                    break
                pos, kind, self.skip = m.end(), self.skip, ""
                if kind in ("script", "style"):
                    yield Tag(kind, True, False, (), base + m.start(), base + m.end())
                continue
            pos = data.find(b"<", pos)
            if pos < 0:
                pos = n
                break
            opener = next((k for o, k in _OPENERS if k in ("comment", "cdata") and data.startswith(o, pos)), "")
            if opener:
                self.skip, pos = opener, pos + (4 if opener == "comment" else 9)
                continue
            rest = data[pos : pos + 9]
            if not last and any(len(rest) < len(o) and o.startswith(rest) for o, k in _OPENERS if k in ("comment", "cdata")):
                break
            m = _TAG.match(data, pos)
            if m is None:
                if not last and _UNFINISHED.match(data, pos):
                    break
                pos += 1
                continue
            name = m[2].decode("ascii").lower()
            raw = m[3] or b""
            yield Tag(name, bool(m[1]), raw.rstrip().endswith(b"/"), () if m[1] else attributes(raw), base + pos, base + m.end())
            pos = m.end()
            if name in ("script", "style") and not m[1]:
                self.skip = name
        self.carry, self.at = data[pos:], base + pos
        if len(self.carry) > CARRY:
            raise ValueError("an unfinished tag is longer than the carry limit")

    def close(self) -> Iterator[Tag]:
        """The tags that the end of the stream completes."""
        yield from self.feed(b"", last=True)


def tags_of(source: str | bytes | None, chunk: int = 1 << 16) -> Iterator[Tag]:
    """The tags of a whole page, read in chunks; the result does not depend on their size."""
    data = source.encode() if isinstance(source, str) else source or b""
    reader = TagReader()
    for lo in range(0, len(data), chunk):
        yield from reader.feed(data[lo : lo + chunk])
    yield from reader.close()


@dataclass
class Tripwire:
    """Tells from a stream's tags whether it is worth more work: up to three names, all of them wanted or any."""

    names: tuple[str, ...]
    every: bool = True
    met: set[int] = field(default_factory=set)

    def __post_init__(self) -> None:
        if not 0 < len(self.names) <= 3:
            raise ValueError("a tripwire has one to three tag names")
        self._wanted = {xxh64(n.lower().encode()) for n in self.names}

    def see(self, tag: Tag) -> bool:
        """Takes a tag; true once the wire is tripped."""
        if not tag.closing and tag.name_hash in self._wanted:
            self.met.add(tag.name_hash)
        return self.met >= self._wanted if self.every else bool(self.met)
