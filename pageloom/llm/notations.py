"""Markup of other notations in readable text: detection and conversion (problem 1).

Everything here is page-local and knows nothing about Spark.  Detection first hides what
never counts (code, Markdown escapes and links in angle brackets where Markdown is the
text's own notation, placeholders of problem 2) and then searches what is left.
"""

from __future__ import annotations

import html as _html
import re

from .placeholders import PLACEHOLDER, hide_placeholders

# Element names of HTML that may be readable as text.
TAGS = (
    "a abbr address article aside audio b big blockquote body br button canvas caption center cite code col dd del details div dl dt em "
    "embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link "
    "main mark meta nav nobr noscript object ol option p path pre q s samp script section select small source span strike strong style "
    "sub summary sup svg table tbody td template textarea tfoot th thead title tr tt u ul var video wbr"
).split()
_TAG = re.compile(r"</?(?:%s)(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>" % "|".join(TAGS), re.I)
_COMMENT = re.compile(r"<!--.*?-->|<!doctype\s[^>]*>|<!\[CDATA\[.*?\]\]>", re.I | re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ENTITY_NAMES = _html.entities.html5 if hasattr(_html, "entities") else {}
if not _ENTITY_NAMES:
    from html.entities import html5 as _ENTITY_NAMES

# Each pattern stands behind a string without which it cannot match, so that most texts cost one search.
_MARKDOWN = [
    (n, re.compile(p, re.M))
    for n, p in (
        ("#", r"^[ \t]{0,3}#{1,6}[ \t]+\S"),  # heading
        ("**", r"(?<![\w*\\])\*\*(?=[^\s*])[^\n*]+?(?<=[^\s*\\])\*\*(?!\*)"),  # strong
        ("**", r"(?<!\*)\*\*(?=[^\s*])[^\n*]+?(?<=[^\s*\\])\*\*(?![\w*])"),
        ("__", r"(?<![\w\\_])__(?=[^\s_])(?:[^\n_]|_(?!_))+(?<=[^\s_\\])__(?![\w])"),
        ("__", r"^(?=[^\n]*[぀-ヿ㐀-鿿])(?:[^\n_]|_(?!_))*__(?=[^\s_])(?:[^\n_]|_(?!_))+(?<=[^\s_\\])__(?!_)"),  # a script without spaces has no word edges
        ("~~", r"(?<![~\\])~~(?=[^\s~])[^\n~]+(?<=[^\s~])~~(?!~)"),  # struck out
        ("](", r"!?\[[^\[\]\n]*\]\((?:<[^<>\n]*>|[^\s()]+)(?:[ \t]+\"[^\"\n]*\")?\)"),  # link, picture
        ("[^", r"\[\^[\w-]+\]"),  # footnote
        ("", r"^[ \t]*(?:```|~~~)"),  # fence
        ("`", r"(?<![`\\])`[^`\n]+`(?!`)"),  # code
        (">", r"^[ \t]{0,3}>[ \t]+\S"),  # quotation
        ("---", r"(?:^|\s)\|[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|"),  # rule of a table
        ("]:", r"^[ \t]{0,3}\[[^\]\n]+\]:[ \t]+\S"),  # reference
        ("[", r"^[ \t]*[-*+][ \t]\[[ xX]\][ \t]"),  # task
        ("*", r"^[ \t]{0,3}\*[ \t]+\S.*\n[ \t]{0,3}\*[ \t]+\S"),
    )
]
_WIKI = [
    (n, re.compile(p, re.M))
    for n, p in (
        ("[[", r"\[\[(?=[^\s\[\]|])[^\[\]\n]+\]\]"),
        ("==", r"(?:^|(?<=\s))(={2,6})[ \t]*(?=[^\s=])[^=\n]+\1(?=\s|$)"),
        ("'''", r"(?<!')'''(?=[^\s'])(?:[^\n']|'(?!''))+'''(?!')"),
        ("''", r"(?<!')''(?=[^\s'])[^'\n]+''(?!')"),
        ("|", r"\{\|[ \t]*(?:class|style|border|cellpadding|width)\b|\{\|(?=.*\|\})|^\|-(?!-)"),
        ("__", r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION|NOINDEX|INDEX|NEWSECTIONLINK|NOGALLERY|HIDDENCAT)__"),
        ("://", r"(?<!\[)\[(?:https?|ftp)://[^\s\[\]]+[ \t]+[^\[\]\n]+\](?!\])"),
        ("<", r"<(?:ref|nowiki|gallery|math|syntaxhighlight|references)\b[^<>]*>"),
        ("#", r"^#(?:REDIRECT|WEITERLEITUNG)\b"),
        ("{{", r"\{\{(?i:cite|main|see also|infobox|reflist|citation needed|stub|lang)\b[^{}]*\}\}"),
    )
]
_LATEX = [
    (n, re.compile(p, re.M))
    for n, p in (
        ("\\", r"(?<!\\)\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}?"),
        ("\\", r"(?<!\\)\\(?:item|hline|centering|noindent|newpage|maketitle|tableofcontents|newline|par|LaTeX|TeX|ldots|dots|quad|qquad|bigskip|"
        r"medskip|smallskip|sum|prod|int|infty|alpha|beta|gamma|delta|lambda|sigma|theta|times|cdot|leq?|geq?|neq?|pm|approx|rightarrow)(?![A-Za-z])"),
        ("\\", r"(?<!\\)\\[(\[](?=(?:[^\n\\]|\\(?![()\[\]]))+\\[)\]])"),
        ("$", r"(?<![\\$\w])\$(?=[^\s$])(?=[^$\n]*[\\^_={}+])[^$\n]+(?<=[^\s\\$])\$(?![\w$])"),
        ("$$", r"\$\$[^$]+\$\$"),
    )
]

# What a text must hold where the string before a pattern says too little.
_SIGNS = {"|": r"\{\||^\|-(?!-)", "__": r"__[A-Z]+__", "://": r"\[(?:https?|ftp)://", "#": r"^#[RW]"}
#: For Python and Java: a line of a text without any of these can hold no html, wiki or latex.
FOREIGN_SIGNS = "(?m)" + "|".join(dict.fromkeys(["<", "&", *(_SIGNS.get(n, re.escape(n)) for n, _ in _WIKI + _LATEX)]))

_SWITCH = _WIKI[5][1]
_FENCE = re.compile(r"^(?P<lead>[ \t]{0,3}(?:[-*+>][ \t]+)?)(?P<bar>`{3,}|~{3,})[^\n]*\n(?:.*?\n)??[ \t]{0,3}(?:[>][ \t]+)?(?P=bar)[`~]*[ \t]*(?=\n|\Z)", re.M | re.S)
_OPEN_FENCE = re.compile(r"^[ \t]{0,3}(?:`{3,}|~{3,})[^\n]*\n.*\Z", re.M | re.S)
_TICKS = re.compile(r"(?<![`\\])(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_INDENTED = re.compile(r"(?:(?<=\n\n)|\A)(?:(?: {4}|\t)[^\n]*(?:\n|\Z))+")
_ESCAPE = re.compile(r"\\([!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~])")
_AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>")
HIDDEN = "￼"

KINDS = ("html", "markdown", "wiki", "latex")


def newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def hide_markdown_code(text: str) -> str:
    """Code blocks and inline code of Markdown become one placeholder character each."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(HIDDEN, text)
        text = _OPEN_FENCE.sub(HIDDEN, text)
    if "    " in text or "\t" in text:
        text = _INDENTED.sub(HIDDEN + "\n", text)
    if "`" in text:
        text = _TICKS.sub(HIDDEN, text)
    return text


def _entity(text: str) -> bool:
    return any(m[0][1] == "#" or m[0][1:] in _ENTITY_NAMES for m in _ENTITY.finditer(text))


def kinds_in(text: str, own_markdown: bool = False) -> list[str]:
    """The kinds of foreign markup in a text without code, in the order of KINDS."""
    out = []
    text = hide_placeholders(text)
    if own_markdown:
        if "\\" in text:
            # A backslash escape shows its character as text; TeX's \( and \[ are the same two characters, and count when they close.
            math = [m.span() for m in _LATEX[2][1].finditer(text)]
            spared = {s for s, _ in math}
            text = _ESCAPE.sub(lambda m: m[0] if m.start() in spared or m[1] in ")]" and math else HIDDEN, text)
        if "<" in text:
            text = _AUTOLINK.sub(HIDDEN, text)
    if ("<" in text and (_TAG.search(text) or _COMMENT.search(text))) or ("&" in text and _entity(text)):
        out.append("html")
    if not own_markdown:
        # A wiki page's switches look like strong text and are none.
        plain = _SWITCH.sub(" ", text) if "__" in text else text
        if any(n in plain and p.search(plain) for n, p in _MARKDOWN):
            out.append("markdown")
    if any(n in text and p.search(text) for n, p in _WIKI):
        out.append("wiki")
    if any(n in text and p.search(text) for n, p in _LATEX):
        out.append("latex")
    return out


# ---------------------------------------------------------------------------------- conversion

#: Steps that take marks of Markdown away, which stay where it is the text's own notation.
_OWN_STEPS = [
    (re.compile(r"!\[([^\[\]\n]*)\]\([^()\n]*\)"), r"\1"),
    (re.compile(r"\[([^\[\]\n^]+)\]\((?:<[^<>\n]*>|[^\s()]+)(?:[ \t]+\"[^\"\n]*\")?\)"), r"\1"),
    (re.compile(r"\[\^[\w-]+\]:?"), ""),
    (re.compile(r"(?<!\*)\*\*(?=\S)([^\n*]+)(?<=\S)\*\*"), r"\1"),
    (re.compile(r"(?<![\w_])__(?=[^\s_])((?:[^\n_]|_(?!_))+)(?<=[^\s_])__(?!\w)"), r"\1"),
    (re.compile(r"~~(?=\S)([^\n~]+)(?<=\S)~~"), r"\1"),
]
#: Steps for the notations that are foreign everywhere.
_FOREIGN_STEPS = [
    (_COMMENT, ""),
    (re.compile(r"<br\s*/?>", re.I), "\n"),
    (_TAG, ""),
    (re.compile(r"(?:^|(?<=\s))(={2,6})[ \t]*(?=[^\s=])([^=\n]+?)[ \t]*\1(?=\s|$)", re.M), lambda m: "#" * len(m[1]) + " " + m[2]),
    (re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}\n]*)\}"), lambda m: {"part": "# ", "chapter": "# ", "section": "## ", "subsection": "### "}.get(m[1], "#### ") + m[2]),
    (re.compile(r"(?<!\[)\[(?:https?|ftp)://[^\s\[\]]+[ \t]+([^\[\]\n]+)\](?!\])"), r"\1"),
    (re.compile(r"\[\[Category:[^\[\]\n]*\]\]", re.I), ""),
    (re.compile(r"\[\[(?:File|Image|Datei|Archivo|Fichier):[^\[\]\n]*?\|?([^\[\]|\n]*)\]\]", re.I), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]"), r"\1"),
    (_SWITCH, ""),
    (re.compile(r"\{\|[^\n|]*|\|\}"), ""),
    (_WIKI[-1][1], lambda m: m[0] if PLACEHOLDER.fullmatch(m[0]) else ""),
    (re.compile(r"'{2,5}(?=[^\s'])((?:[^\n']|'(?!'))+)'{2,5}"), r"\1"),
    (re.compile(r"\\begin\{(?:itemize|enumerate|description)\}|\\end\{(?:itemize|enumerate|description)\}"), ""),
    (re.compile(r"\\item(?:\[[^\]\n]*\])?[ \t]*"), "\n- "),
    (re.compile(r"~?\\(?:cite|citep|citet|label|ref|pageref|footnote|index|vspace|hspace)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}"), ""),
    (re.compile(r"\\(?:textbf|textit|emph|texttt|underline|textsc|text|mbox)\{([^{}\n]*)\}"), r"\1"),
    (re.compile(r"\\\(((?:[^\n\\]|\\(?![()\[\]]))+)\\\)"), r"$\1$"),
    (re.compile(r"\\\[((?:[^\n\\]|\\(?![()\[\]]))+)\\\]"), r"$$\1$$"),
]


def clean(text: str, own_markdown: bool = False) -> str:
    """The text without foreign markup; headings, list entries, code and formulas stay recognisable.

    Code blocks and inline code are untouched.  Formulas become ``$...$`` or ``$$...$$``.
    Where Markdown is the text's own notation, its own marks stay.  A clean text stays as it
    is: what becomes markup once entities are decoded is taken away as well.
    """
    while True:
        new = _cleaned(text, own_markdown)
        if new == text:
            return new
        text = new


def _cleaned(text: str, own_markdown: bool) -> str:
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"{HIDDEN}{len(kept) - 1}{HIDDEN}"

    text = newlines(text).replace(HIDDEN, "")
    if own_markdown:
        for pattern in (_FENCE, _OPEN_FENCE, _INDENTED, _TICKS, _AUTOLINK):
            text = pattern.sub(keep, text)
    for pattern, into in (*_FOREIGN_STEPS, *([] if own_markdown else _OWN_STEPS)):
        text = pattern.sub(into, text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: _html.unescape(m[0]), text).replace(" ", " ")
    text = re.sub(r"[ \t]+\n", "\n", text)
    text = re.sub(r"(?<=\S)[ \t]{2,}", " ", text)
    text = re.sub(r"\n{3,}", "\n\n", text).strip("\n")
    text = text if own_markdown else text.strip()
    while f"{HIDDEN}" in text:  # code that stands inside other kept code comes back last
        new = re.sub(rf"{HIDDEN}(\d+){HIDDEN}", lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else "", text)
        if new == text:
            break
        text = new
    return text.rstrip() if own_markdown else text
