"""Unfilled template fields in readable text (problem 2), page-local."""

from __future__ import annotations

import re

_FIELD = r"[A-Za-z_][\w.\-]*"
# Behaviour switches of wiki pages, which look like fields but are none.
_SWITCHES = "TOC|NOTOC|FORCETOC|NOEDITSECTION|NOINDEX|INDEX|NEWSECTIONLINK|NOGALLERY|HIDDENCAT"
# Words before a person's name in a greeting.
_GREETINGS = "Hello|Hi|Hey|Dear|Welcome back|Welcome|Hallo|Hola|Bonjour|Liebe[rs]?|Estimad[oa]|Cher|Chère|Здравствуйте|Привет|Уважаемый"
_PATTERNS = [
    r"\{\{\{?[#/^&>!]?\s*[\w.$@|:'\"()\[\] \-]+?\s*\}?\}\}",
    r"\{%-?\s*[A-Za-z][^%{}\n]*%\}",
    r"<%[=\-#]?[^%<>\n]*%>",
    rf"\$\{{\s*{_FIELD}[^{{}}\n]*\}}",
    rf"[#@]\{{\s*{_FIELD}\s*\}}",
    r"%%[A-Za-z][A-Za-z0-9_]*%%",
    r"##[A-Z][A-Z0-9_]*##",
    rf"(?<![\w])__(?!(?:{_SWITCHES})__)[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)",
    rf"\[%\s*{_FIELD}\s*%\]",
    r"\[\s*(?:[Ii]nsert|INSERT|[Yy]our|[Ee]nter|[Aa]dd)\s[^\[\]\n]+\]",
    rf"(?:{_GREETINGS})\s*,?\s*\[[^\W\d_][\w ]+\]",
    rf"(?<![\w}}\\$#@{{])\{{(?:{_FIELD}|\d{{1,2}})\}}(?![{{}}\w])",
    r"(?<![\w$])\$[A-Z][A-Z0-9_]{2,}\$(?![\w$])",
    r"\bYOUR_[A-Z0-9_]+_HERE\b|\bINSERT_[A-Z0-9_]+(?:_HERE)?\b",
    r"<\s?(?:[a-z_]+\s){1,4}(?:goes\s)?here\s?>",
    r"\b(?:TODO|FIXME|TBD)\s*:\s*(?:write|add|insert|fill|replace|translate)\b",
    rf"(?:{_GREETINGS})\s*,?\s*(?:undefined|null|NaN|None|nil|\(null\)|\[object Object\])\b",
    r"\b(?:holds|costs|has|from|of|by|on|for|total:?|price:?|is)\s(?:NaN|undefined|\[object Object\])\s(?:items?|results?|euros?|views?|comments?|reviews?)\b",
    r"\[object Object\]",
    r"\([\w ]{2,}\s(?:to follow|to come|goes here|folgt)\b[^()\n]*\)",
]
PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in _PATTERNS))
#: Without one of these signs or words no pattern matches.
_SIGN = re.compile(r"\{\{|\{%|<%|[$#@]\{|%%[A-Za-z]|##[A-Z]|__[A-Z]|\[%|\[\s*[^\W\d_]|\{\w|\$[A-Z]|<\s?[a-z_]+\s")
_TOLD = ("undefined", "null", "NaN", "None", "nil", "object Object", "TODO", "FIXME", "TBD", "YOUR_", "INSERT_", "to follow", "to come", "goes here", "folgt")


def may_hold_placeholder(text: str) -> bool:
    """False only where no part of the text can be an unfilled field."""
    return bool(_SIGN.search(text)) or any(x in text for x in _TOLD)


def has_placeholder(text: str) -> bool:
    """Whether a text without code shows an unfilled field."""
    return may_hold_placeholder(text) and bool(PLACEHOLDER.search(text))


def hide_placeholders(text: str) -> str:
    return PLACEHOLDER.sub("￼", text) if may_hold_placeholder(text) else text
