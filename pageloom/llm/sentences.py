"""Sentence units in ten languages by semi-Markov dynamic programming (problem 9).

A text is cut at blank lines and before bullets.  Inside a piece every place where a
sentence could end is a point; the units are whole spans between points, and dynamic
programming picks the sequence of spans with the highest total of

* a closing score: what the mark and the word before the point say (abbreviation,
  initial, number, company form, final mark of the script),
* an opening score: what the word after the point says,
* a length score: spans of a few characters or of a bare number are unlikely,
* a balance score: spans that open or close a quotation or bracket without its partner,
  and spans that are nothing but a quotation, which belongs to the words around it.

All scores are log-odds-like constants below; nothing is learned, so that results do not
depend on the amount of data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that are followed by what they belong to, in lower case, without the final point.
_FORWARD = frozenset(
    # English
    "dr mr mrs ms prof st rev hon gen col sgt capt lt gov sen rep fig figs vs cf p pp vol vols no nos ch sec eq ed eds approx e.g i.e viz al "
    "jan feb mar apr jun jul aug sep sept oct nov dec mt ft "
    # German
    "abb nr vgl ca fa mio mrd bzw z b z.b d.h u.a u.ä s.o s.u s hr hrn fr tel str abs art bd kap sog evtl ggf inkl zzgl max min jh "
    # French
    "m mm mme mmes mlle mgr me fig av bd boul p.ex ex env chap réf "
    # Spanish
    "sr sra sres srta d dña ud uds vd vds avda av pág págs p.ej ej núm cap art "
    # Russian
    "см рис стр т тыс млн млрд ул д кв пл пр проф акад г-н г-жа им ср напр "
    # Arabic, Hindi
    "د أ م डॉ श्री कु प्रो".split()
)
# Abbreviations that often stand last, in lower case.
_LAST = frozenset("etc inc ltd co corp llc jr sr a.m p.m am pm usw u.s.w usf u.v.m gmbh ag т.д т.п др г гг в вв cía".split())
# Nouns before a letter that is a name, not an initial.
_LABELS = frozenset(
    "unit room section part class plan hall gate block building terminal zone group type level grade vitamin option appendix annex figure table "
    "einheit raum teil halle gebäude gruppe klasse typ anlage salle unité bloc zone groupe classe annexe unidad sala parte bloque zona grupo clase "
    "блок зал часть группа класс зона секция корпус".split()
)
# Words that open sentences and hardly ever follow an abbreviation or initial.
_OPENERS = frozenset(
    "The A An We It In On At When Why Most Each Is Are Our Nobody Thanks See Wait This That These Those They He She I You There What Who Where How If But And "
    "Der Die Das Ein Eine Im Am Wenn Warum Niemand Es Rund Laut Ca Vgl Und Aber Wir Sie Er "
    "Le La Les Un Une Des Pourquoi Personne Près Voir Nous Il Elle Ce C'est Et Mais Selon "
    "El Los Las Una Cerca Véase Por Nadie Y Pero Según "
    "В На Около См Почему Никто Осталось Ответ Цена Версия Это И Но Если Мы Он Она Версія".split()
)
# German words after a number with a point that show a date or an ordinal are nouns; these open sentences instead.
_AFTER_ORDINAL = frozenset("Der Die Das Ein Eine Im Am Wenn Warum Niemand Es Rund Laut Ca Vgl Wir Sie Er Und Aber".split())

_FINAL = "。．！？!?｡؟।॥۔‽‼⁇⁈⁉"
_CLOSERS = "\"'”’»›」』）)]】〉》〕“"
_POINT = re.compile(rf"(?:(?:\.{{2,}}|…+|\.)[!?]*|[{_FINAL}][{_FINAL}.…]*)")
_CLOSE_RUN = re.compile(r"(?:[”’»›」』）)\]】〉》〕\"']|[“](?=[\s,.;:!?)]|$)|\s+(?=»)»?)*")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+| +")
_BULLET = re.compile(r"(?:(?<=\n)|\A)[^\S\n]*[-*•][^\S\n]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿　-〿＀-￯]")
_THAI = r"[฀-๎]"
_THAI_GAP = re.compile(rf"(?<={_THAI})\s+(?={_THAI})")
_THAI_ANY = re.compile(_THAI)
_BEFORE_WORD = frozenset("([（「『“„«\"‘¿¡—–-")
_WORD_AFTER = re.compile(r"[\w'’.]+")
_GERMAN = re.compile(r"\b(?:der|die|das|und|nicht|ein|eine|von|vor|im|am|bei)\b|[ßäöü]", re.I)
_PAIRS = {"“": "”", "„": "“", "«": "»", "»": "«", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "‹": "›"}
_QUOTE_MARKS = re.compile(r"[“”„«»「」『』（）()\[\]【】《》〈〉‹›\"]")
_QUOTES = frozenset("“„«「『‹\"")
_PARTICLE = re.compile(r"[とってかなのにはがをもやで、，,：:；;]")

#: Longer spans have no length score.
SHORT = 6
LENGTH_SHORT, LENGTH_NUMBER, UNBALANCED, ONLY_QUOTE = -4.0, -9.0, -30.0, -6.0
SURE, LIKELY, NEVER = 6.0, 2.5, -12.0


def quotation_pairs(text: str) -> list[tuple[int, int]]:
    """(open, close) of every quotation or bracket that is closed within the text; partners without one are ignored."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    for m in _QUOTE_MARKS.finditer(text):
        c, i = m[0], m.start()
        before = text[i - 1] if i else " "
        after = text[i + 1] if i + 1 < len(text) else " "
        if c == '"':
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if k is not None and not (before.isspace() and not after.isspace() and after not in ".,;:!?"):
                out.append((stack[k][1], i))
                del stack[k:]
            elif not after.isspace():
                stack.append(('"', i))
            continue
        k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), None)
        if k is not None:  # closes something that is open
            out.append((stack[k][1], i))
            del stack[k:]
            continue
        if c in _PAIRS and not (c in "»" and not before.isspace() and i):
            stack.append((_PAIRS[c], i))
    return out


def _lowered(text: str, start: int, at: int, end: int) -> bool:
    """Whether the sentence before a point and the one after it are written without capitals."""
    a = max(text.rfind(c, start, at - 1) for c in ".!?\n")
    a = start if a < 0 else a + 1
    b = min((k for c in ".!?" if (k := text.find(c, at + 1, end)) >= 0), default=end)
    before, after = text[a:at], text[at:b]
    return at - a > 40 and b - at > 40 and before == before.lower() and after == after.lower()


def _opening(text: str, at: int, end: int, lowered: bool = False) -> tuple[float, str]:
    """Score of what follows a point, and the word there."""
    while at < end and text[at].isspace():
        at += 1
    if at >= end:
        return SURE, ""
    c = text[at]
    if c in "—–-":
        k = at + 1
        while k < end and text[k].isspace():
            k += 1
        if k < end and (text[k].isupper() or text[k] in "¿¡“«\"„" or text[k].isdigit()) and k == at + 1:
            return LIKELY, c
        return NEVER, c
    if c in ",;:.)]}”»'’，、；：）」』…!?。！？؟،":
        return NEVER, c
    k = at
    while k < end and text[k] in "“„«\"'‘(（[「『¿¡‹ " and k - at < 4:
        k += 1
    m = _WORD_AFTER.match(text, k, end)
    word = m[0] if m else ""
    if not word:
        return LIKELY, c
    first = word[0]
    if first.isupper() or (len(word) > 1 and first.islower() and word[1].isupper()):
        return LIKELY, word
    if first.isdigit():
        return LIKELY - 1, word
    if first.islower():
        if lowered:
            return 1.0, word
        return (NEVER if k == at or c in "(“«\"„‘'" else LIKELY), word
    return LIKELY, word  # a script without case


def _last_word(text: str, start: int, end: int) -> str:
    """The last word, ended by white space, of text[start:end]."""
    while end > start and text[end - 1].isspace():
        end -= 1
    first = end
    while first > start and not text[first - 1].isspace():
        first -= 1
    return text[first:end]


def _points(text: str, start: int, end: int, german: bool) -> list[tuple[int, float]]:
    """(position, score) of the places in text[start:end] where a sentence could end."""
    out: list[tuple[int, float]] = []
    for m in _POINT.finditer(text, start, end):
        mark = m[0]
        stop = m.end()
        close = _CLOSE_RUN.match(text, stop, end)
        after = close.end() if close else stop
        while after > stop and text[after - 1].isspace():
            after -= 1
        if after >= end:
            continue
        follow = text[after]
        wide = mark[0] in "。．！？｡" or bool(_CJK.match(follow)) and mark[0] in "!?"
        if not follow.isspace() and not wide and not (mark[0] in "।॥؟۔"):
            continue
        closers = text[stop:after]
        score, word = _opening(text, after, end)
        if score <= NEVER and not wide and _lowered(text, start, stop, end):
            score, word = _opening(text, after, end, True)
        if mark.startswith(("..", "…")) and not mark[-1] in "!?":
            continue  # an ellipsis alone ends nothing
        if wide:
            if follow in "」』”’）)»，、；：…。！？,;:":
                continue
            if _PARTICLE.match(follow) and (closers or mark[0] in "！？!?"):
                # と after a quotation or an exclamation carries the sentence on
                if follow in "とってか、，,：:；;" and not (follow == "か" and not closers):
                    continue
            out.append((after, SURE if not closers else LIKELY + 1))
            continue
        if mark != ".":
            if score > 0:
                out.append((after, score + (1.0 if closers else 2.0)))
            continue
        if score <= NEVER:
            continue
        # A single point: what stands before it?
        first = m.start()
        while first > start and text[first - 1] not in _BEFORE_WORD and not text[first - 1].isspace():
            first -= 1
        token = text[first : m.start()]
        low = token.lower().rstrip(".")
        if closers:
            out.append((after, score + 2.0))
        elif len(token) == 1 and token.isalpha() and not _CJK.match(token):
            previous = _last_word(text, start, first).lower().strip("(„“«\"")
            joined = (previous.rstrip(".") + "." + low) if previous.endswith(".") else ""
            if joined in _LAST and token.islower():
                out.append((after, score))
            elif token.isupper() and previous in _LABELS:
                out.append((after, score + 2.0))
            elif token.isupper() and word in _OPENERS and previous and not previous.endswith(".") and not (word in ("A", "I", "M")):
                out.append((after, 0.5))
            elif token.islower() and low not in _FORWARD and not joined:
                out.append((after, score))
            elif low in _LAST and not joined:
                out.append((after, score if score >= LIKELY else -1.0))
        elif low in _LAST:
            out.append((after, score + 1.0))
        elif low in _FORWARD or (("." in low) and low.replace(".", "").isalpha() and max(map(len, low.split("."))) <= 3):
            if word in _OPENERS and low not in ("dr", "mr", "mrs", "ms", "prof", "sr", "sra", "fig", "vs", "cf", "mio", "vgl", "abb", "e.g", "i.e") and low in ("no", "st", "al", "min", "max", "ft", "art", "str", "ex", "me", "fr", "ed", "д", "кв"):
                out.append((after, 0.5))
            elif low == "no" and not word[:1].isdigit():
                out.append((after, score))
        elif token.isdigit():
            if german and len(token) <= 2 and word not in _AFTER_ORDINAL:
                continue
            out.append((after, score + 1.0))
        else:
            out.append((after, score + 2.0))
    return out


def _span_score(text: str, a: int, b: int) -> float:
    """Length score of a span (spaces already outside)."""
    n = b - a
    if n <= 3 and not _CJK.search(text, a, b):
        return LENGTH_NUMBER if text[a:b].rstrip(".)").isdigit() else LENGTH_SHORT
    if n <= SHORT and text[a:b].rstrip(".)").isdigit():
        return LENGTH_NUMBER
    return 0.0


def _segment(text: str, start: int, end: int, german: bool) -> Iterator[tuple[int, int]]:
    """The best spans of one piece."""
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    if start >= end:
        return
    points = _points(text, start, end, german)
    if _THAI_ANY.search(text, start, end):
        known = {p for p, _ in points}
        points += [(m.start(), SURE) for m in _THAI_GAP.finditer(text, start, end) if m.start() not in known]
        points.sort()
    if not points:
        yield start, end
        return
    pairs = [(o + start, c + start) for o, c in quotation_pairs(text[start:end])]
    whole = {}
    if pairs:
        inside = np.zeros(len(points), dtype=bool)
        at = np.array([p for p, _ in points])
        for o, c in pairs:
            inside |= (at > o) & (at <= c)
            if text[o] in _QUOTES:
                whole[o] = max(whole.get(o, 0), c)
        points = [(p, s + (UNBALANCED if x else 0.0)) for (p, s), x in zip(points, inside)]
        points = [(p, s) for p, s in points if s > -20]
    # Dynamic programming over points; a span from i to j ends at point j.
    ends = [p for p, _ in points] + [end]
    gains = [s for _, s in points] + [0.0]
    begins = [start]
    for p in ends[:-1]:
        while p < end and text[p].isspace():
            p += 1
        begins.append(p)
    n = len(ends)
    best = [float("-inf")] * (n + 1)
    best[0], back = 0.0, [0] * (n + 1)
    # Spans of more than SHORT characters score the same whatever their length, unless they begin at a quotation that is still
    # open: the best of their beginnings is carried along, and only the few others are gone through for every end.
    far, far_at, passed, quoted = float("-inf"), 0, 0, []
    for j in range(1, n + 1):
        b = ends[j - 1]
        while passed < j and b - begins[passed] > SHORT:
            if begins[passed] in whole:
                quoted.append(passed)
            elif best[passed] > far:
                far, far_at = best[passed], passed
            passed += 1
        for i in [i for i in quoted if whole[begins[i]] + 1 < b or j == n]:
            quoted.remove(i)
            if best[i] > far or (best[i] == far and i < far_at):
                far, far_at = best[i], i
        top, at = far, far_at
        for i in (*quoted, *range(passed, j)):
            a = begins[i]
            score = best[i] + (_span_score(text, a, b) if i >= passed else 0.0)
            if a in whole and whole[a] + 1 >= b and j < n:
                score += ONLY_QUOTE if text[a] not in "（(" else 0.0
            if score > top or (score == top and i < at):
                top, at = score, i
        best[j], back[j] = top + gains[j - 1], at
    cuts = []
    j = n
    while j:
        cuts.append((begins[back[j]], ends[j - 1]))
        j = back[j]
    for a, b in reversed(cuts):
        if a < b:
            yield a, b



def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every unit in code points, end exclusive. Null, empty and blank texts have none."""
    if not text or text.isspace():
        return []
    german = len(_GERMAN.findall(text)) * 40 > len(text.split())
    out: list[tuple[int, int]] = []
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        stop = m.start() if m else len(text)
        piece = at
        marks = [b for b in _BULLET.finditer(text, at, stop) if b.start() == 0 or text[b.start() - 1] == "\n"]
        for b in marks:
            out.extend(_segment(text, piece, b.start(), german))
            piece = b.end()
        out.extend(_segment(text, piece, stop, german))
        at = m.end() if m else len(text)
    return out


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lo in range(0, len(pdf), 2000):
            part = pdf.iloc[lo : lo + 2000]
            spans = [sentence_spans(x) for x in part["text"]]
            counts = [len(x) for x in spans]
            flat = np.array([y for x in spans for y in x], dtype=np.int32).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": np.repeat(part["doc_id"].to_numpy(), counts), "start_pos": flat[:, 0], "end_pos": flat[:, 1]})


def sentence_units(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start_pos, end_pos`` of every unit; no shuffle.

    Null and blank texts and rows with a null key give no units; repeated rows give their
    units again; other columns are not read.
    """
    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(_split, "doc_id bigint, start_pos int, end_pos int")
