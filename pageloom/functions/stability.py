"""Which class tokens name something, and which are noise: as Python predicates and as Spark columns."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import NOISE_PREFIXES, NOISE_SUFFIX, NOISE_TOKENS

# Utility-class grammars of common style frameworks, in a syntax that Java, Python and RE2 read alike.
VARIANT = r"^(sm|md|lg|xl|2xl|dark|light):"
STATE = (
    r"^(hover|focus|focus-within|focus-visible|active|disabled|first|last|odd|even|group|peer|placeholder|target|enabled|checked|required|valid|invalid|"
    r"in-range|out-of-range|read-only|read-write|empty|root|file|marker|selection|backdrop|motion-safe|motion-reduce|print|portrait|landscape|rtl|ltr)"
    r"(-[a-z][a-z-]*)?:"
)
UTILITY = (
    r"^(p|m|w|h|gap|space|text|bg|border|rounded|grid|flex|col|row|min|max|inset|top|right|bottom|left|z|opacity|shadow|ring|fill|stroke|cursor|"
    r"select|resize|object|overflow|whitespace|break|content|origin|transition|duration|delay|ease|animate|transform|translate|rotate|scale|skew|"
    r"filter|blur|brightness|contrast|saturate|p[xytrbl]|m[xytrbl]|aspect|order|font|leading|tracking|list|placeholder|divide|outline|truncate|sr|"
    r"not-sr|antialiased|subpixel|italic|not-italic|underline|line-through|no-underline|uppercase|lowercase|capitalize|normal-case|items|justify|"
    r"self|place|basis|grow|shrink)-(\d|x-\d|y-\d|t-\d|r-\d|b-\d|l-\d|full|auto|screen|min|max|none|px|fit|prose|reverse|wrap|nowrap|first|last|"
    r"center|left|right|start|end|justify|between|around|evenly|baseline|stretch|hidden|visible|scroll|clip|solid|dashed|dotted|double|inherit|"
    r"current|transparent|black|white|gray|red|orange|yellow|green|teal|blue|indigo|purple|pink|slate|zinc|neutral|stone|amber|lime|emerald|cyan|"
    r"sky|violet|fuchsia|rose|primary|secondary|cols-\d|rows-\d|span-\d|flow-\w+|flex|grid|block|inline|cover|contain|fill|bold|semibold|medium|"
    r"light|normal|extrabold|thin)"
)
ATOMIC = (
    r"^(p|m|d|w|h|text|bg|border|rounded|col|row|mt|mb|ml|mr|mx|my|pt|pb|pl|pr|px|py)-(\d|sm|md|lg|xl|xxl|auto|none|fluid|flex|grid|block|inline|"
    r"inline-block|inline-flex|table|center|left|right|start|end|justify|primary|secondary|success|warning|danger|info|light|dark|muted|white|"
    r"black|body|wrap|nowrap|truncate|uppercase|lowercase|capitalize)"
)
SINGLETONS = (
    "flex grid block inline inline-block inline-flex inline-grid hidden visible invisible collapse table table-row table-cell table-caption table-column "
    "table-column-group table-footer-group table-header-group table-row-group contents flow-root list-item fixed absolute relative sticky static"
).split()
_STYLES = re.compile("|".join(f"(?:{x})" for x in (VARIANT, STATE, UTILITY, ATOMIC)))
_SINGLE = frozenset(SINGLETONS)


@functools.lru_cache(maxsize=1 << 16)
def is_stable(token: str) -> bool:
    """Whether a class token (or id) can identify an element: no hash, no utility, no layout word."""
    n = len(token)
    if not token.strip():
        return False
    if n < 3:
        return True
    if (token.startswith("css-") and n >= 8) or (token.startswith("sc-") and n >= 7) or (token[0] == "_" and "__" in token):
        return False
    if n >= 6 and (not any(c in "aeiouy" for c in token) or sum(c.isdigit() for c in token) > 0.3 * n):
        return False
    return token not in _SINGLE and not _STYLES.match(token)


def stable(token: Column) -> Column:
    """The same as a column, inside whole-stage code generation."""
    n = F.length(token)
    digits = n - F.length(F.regexp_replace(token, r"[0-9]", ""))
    hashed = (n >= 6) & (~token.rlike("[aeiouy]") | (digits > n * 0.3))
    framed = (token.startswith("css-") & (n >= 8)) | (token.startswith("sc-") & (n >= 7)) | (token.startswith("_") & token.contains("__"))
    style = token.rlike(VARIANT) | token.rlike(STATE) | token.rlike(UTILITY) | token.rlike(ATOMIC) | token.isin(SINGLETONS)
    return F.when(F.length(F.trim(token)) == 0, False).when(n < 3, True).otherwise(~(framed | hashed | style))


_SUFFIX = re.compile(NOISE_SUFFIX)


def quiet_classes(tokens: list[str]) -> list[str]:
    """Class tokens without state words and state prefixes, hashed block-element suffixes cut off."""
    return [_SUFFIX.sub("", t) for t in tokens if t not in NOISE_TOKENS and not t.startswith(NOISE_PREFIXES)]


def quiet(tokens: Column) -> Column:
    kept = F.filter(tokens, lambda t: ~t.isin(sorted(NOISE_TOKENS)) & ~t.rlike("^(" + "|".join(NOISE_PREFIXES) + ")"))
    return F.transform(kept, lambda t: F.regexp_replace(t, NOISE_SUFFIX, ""))
