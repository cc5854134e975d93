"""The binary forms in which stores keep fingerprints: signatures and pq-gram vectors."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS, BAND = 128, 8


def read_vector(blob: bytes | None) -> dict[str, float]:
    """A pq-gram vector: a u32 count, then u32 key length, UTF-8 key and f64 weight per entry. Broken ones are empty."""
    if not blob or len(blob) < 4:
        return {}
    (n,), at, out = struct.unpack_from("<I", blob, 0), 4, {}
    try:
        for _ in range(n):
            (size,) = struct.unpack_from("<I", blob, at)
            key = blob[at + 4 : at + 4 + size].decode("utf-8")
            (out[key],) = struct.unpack_from("<d", blob, at + 4 + size)
            at += 12 + size
    except (struct.error, UnicodeDecodeError):
        return {}
    return {k: v for k, v in out.items() if math.isfinite(v) and v != 0}


def write_vector(vector: dict[str, float]) -> bytes:
    """The binary form of a vector, entries in the order of their keys."""
    parts = [struct.pack("<I", len(vector))]
    for key in sorted(vector):
        raw = key.encode()
        parts += [struct.pack("<I", len(raw)), raw, struct.pack("<d", vector[key])]
    return b"".join(parts)


def write_signature(slots: np.ndarray) -> bytes:
    """128 slots as little-endian unsigned 32-bit numbers."""
    return np.asarray(slots).astype("<u4").tobytes()


def grams(vector: Column) -> Column:
    """A stored pq-gram vector as a map."""

    @F.pandas_udf("map<string,double>")
    def read(blobs: pd.Series) -> pd.Series:
        return blobs.map(read_vector)

    return read(vector)


def slots(signature: Column) -> Column:
    """A stored signature as an array of 8-character hex slots."""
    text = F.hex(signature)
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.substring(text, i * 8 + 1, F.lit(8)))


def stored_bands(signature: Column) -> Column:
    """The bands of a stored signature: 16 keys of eight slots each."""
    text = F.hex(signature)
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS // BAND - 1)), lambda i: F.substring(text, i * (8 * BAND) + 1, F.lit(8 * BAND)))


def equal_share(a: Column, b: Column) -> Column:
    """The share of equal slots of two stored signatures of full length, a batch at once."""

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        left, right = (np.frombuffer(b"".join(s), "<u4").reshape(-1, SLOTS) for s in (x, y))
        return pd.Series((left == right).mean(axis=1))

    return share(a, b)
