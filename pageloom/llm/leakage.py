"""Evaluation passages inside training documents, by spaced-seed hashing (problem 7).

Texts become token sequences: words, and for scripts without word breaks also letters
and digits one by one.  A seed is a fixed mask over a window of tokens; positions under a
0 are ignored, so a window still hashes alike when those tokens differ.  Every window of
every passage and of every document is hashed under every mask; equal hashes are joined,
and the tokens around each hit are laid side by side: exact runs and matches with
substitutions are counted there.

Documents are filtered before the join by a bit set of fixed size made from the
passages' hashes (at most ``2 ** BITS`` bits whatever the number of passages), so the
shuffle carries possible hits only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from .lookalikes import bit_set

#: Least consecutive words, and letters or digits in scripts without word breaks.
WORDS, LETTERS = 12, 25
# Masks span no more than the least run, so an exact run always holds a whole window.
WORD_MASKS = ("11011011011", "11101001111")
LETTER_MASKS = ("11101101110110111011",)
BITS = 22
_DROPPED = re.compile("[­​‌‍⁠﻿]")
_WORD = re.compile(r"\w+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_GAP = np.uint64(0xFFFFFFFFFFFFFFFF)


def normal(text: str) -> str:
    return _DROPPED.sub("", unicodedata.normalize("NFKC", text).lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, and the number of tokens of each."""
    words = [_WORD.findall(x) for x in texts]
    counts = np.array([len(x) for x in words], dtype=np.int64)
    flat = [w for x in words for w in x]
    codes, unique = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), np.zeros(0, object))
    return (pd.util.hash_array(np.asarray(unique, dtype=object), categorize=False)[codes] if flat else np.zeros(0, np.uint64)), counts


def letter_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    kept = ["".join(c for c in x if c.isalnum()) for x in texts]
    counts = np.array([len(x) for x in kept], dtype=np.int64)
    points = np.frombuffer("".join(kept).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    return _mix(points + np.uint64(0x9E3779B97F4A7C15)), counts


def _windows(tokens: np.ndarray, counts: np.ndarray, masks: tuple[str, ...], salt: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of all windows that lie within one text, for each mask."""
    owner = np.repeat(np.arange(len(counts)), counts)
    for m, mask in enumerate(masks):
        span = len(mask)
        n = len(tokens) - span + 1
        if n <= 0:
            continue
        whole = owner[:n] == owner[span - 1 :]
        value = np.full(n, salt * 1000003 + m + 1, dtype=np.uint64)
        for i, bit in enumerate(mask):
            if bit == "1":
                value = _mix(value * np.uint64(0x9E3779B97F4A7C15) ^ tokens[i : i + n])
        at = np.nonzero(whole)[0]
        yield at, value[at]


def _rows(ids: np.ndarray, tokens: np.ndarray, counts: np.ndarray, masks: tuple[str, ...], least: int, salt: int, bits: np.ndarray | None) -> pd.DataFrame:
    """key, id, context: one row per window (that the bit set lets through)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    keys, owners, contexts = [], [], []
    around = least - 1
    edge = np.full(around, _GAP)
    padded = np.concatenate([edge, tokens, edge])
    owner_padded = np.concatenate([np.full(around, -1), owner, np.full(around, -1)])
    for at, value in _windows(tokens, counts, masks, salt):
        if bits is not None:
            slot = value >> np.uint64(64 - BITS)
            keep = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
            at, value = at[keep > 0], value[keep > 0]
        if not len(at):
            continue
        width = 2 * around + len(masks[0])
        take = at[:, None] + np.arange(width)
        context = np.where(owner_padded[take] == owner[at][:, None], padded[take], _GAP)
        keys.append(value)
        owners.append(owner[at])
        contexts.extend(context.view(np.int64).tolist())
    if not keys:
        return pd.DataFrame({"key": np.zeros(0, np.int64), "id": ids[:0], "context": pd.Series([], dtype=object)})
    return pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "id": ids[np.concatenate(owners)], "context": contexts})


def _shred(by_lang: bool, bits: np.ndarray | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["text"].notna()]
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                texts = [normal(x) for x in part["text"]]
                ids = part["id"].to_numpy()
                if by_lang:  # passages: by their language, or by their script where it is missing
                    lang = [re.split(r"[-_]", x.strip().lower())[0] if isinstance(x, str) else "" for x in part["lang"]]
                    wide = np.array([x in ("zh", "ja") or (x == "" and len(_CJK.findall(t)) * 2 > len(t)) for x, t in zip(lang, texts)], dtype=bool)
                    groups = ((~wide, False), (wide, True))
                else:  # documents: words always, letters where the script occurs
                    groups = ((np.ones(len(texts), bool), False), (np.array([bool(_CJK.search(t)) for t in texts], dtype=bool), True))
                for chosen, letters in groups:
                    some = [t for t, c in zip(texts, chosen) if c]
                    if some:
                        tokens, counts = letter_tokens(some) if letters else word_tokens(some)
                        masks, least = (LETTER_MASKS, LETTERS) if letters else (WORD_MASKS, WORDS)
                        yield _rows(ids[chosen], tokens, counts, masks, least, int(letters), bits).assign(letters=letters)

    return run


def _runs(a: pd.Series, b: pd.Series, letters: pd.Series) -> pd.DataFrame:
    """Of the tokens around hits, side by side: the longest exact run through the window, and all equal tokens. All hits of a kind at once."""
    out = np.zeros((len(a), 3), dtype=np.int32)
    wide = letters.to_numpy(dtype=bool)
    for kind in (False, True):
        rows = np.nonzero(wide == kind)[0]
        if not len(rows):
            continue
        x, y = (np.stack(s.to_numpy()[rows]) for s in (a, b))
        real = (x != -1) & (y != -1)
        same = (x == y) & real
        best = run = np.zeros(len(rows), dtype=np.int32)
        for k in range(same.shape[1]):
            run = (run + 1) * same[:, k]
            best = np.maximum(best, run)
        least = LETTERS if kind else WORDS
        middle = same.shape[1] - 2 * (least - 1)
        compared = real.sum(axis=1)
        out[rows] = np.stack([best, same.sum(axis=1), np.where(compared > 0, compared, middle)], axis=1)
    return pd.DataFrame(out, columns=["longest", "equal", "compared"])


def leaked(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, item_id, exact_run, equal_share``: the documents that share a window with a passage.

    ``exact_run`` is the longest run of consecutive equal tokens around the best hit, at most
    twice the least run; ``equal_share`` the largest part of tokens around a hit that are equal,
    substitutions allowed.  Null and blank texts and null keys give no rows; repeated rows count
    once; an empty table on either side gives an empty result.
    """
    passages = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).distinct()
    schema = "key bigint, id bigint, context array<bigint>, letters boolean"
    seeds = cut(passages.mapInPandas(_shred(True, None), schema))
    bits = bit_set(seeds.select(F.shiftrightunsigned("key", 64 - BITS).alias("slot")), BITS)
    texts = documents.where(F.col(doc_key).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_key).alias("id"), F.col(text).alias("text"))
    hits = texts.mapInPandas(_shred(False, bits), schema)
    runs = F.pandas_udf(_runs, "longest int, equal int, compared int")
    both = hits.join(seeds.select("key", "letters", F.col("id").alias("item"), F.col("context").alias("passage")), ["key", "letters"])
    laid = both.select(F.col("id").alias(doc_key), F.col("item").alias(item_key), "letters", runs("context", "passage", "letters").alias("r"))
    return laid.groupBy(doc_key, item_key, "letters").agg(F.max("r.longest").alias("exact_run"), F.max(F.col("r.equal") / F.col("r.compared")).alias("equal_share"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p7_found: pairs with an exact run of at least WORDS words, or LETTERS letters."""
    need = F.when(F.col("letters"), F.lit(LETTERS)).otherwise(F.lit(WORDS))
    return leaked(documents, items).where(F.col("exact_run") >= need).select("doc_id", "item_id").distinct()
