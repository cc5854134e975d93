"""Hashes and sketches of fingerprints, bit for bit the ones that stored bundles hold.

XXH64 with seed 0 comes from ``xxhash`` where it is installed, else from a small
implementation below.  The MinHash of a shingle set hashes 16 bytes (shingle, slot seed)
per slot; for that length XXH64 has a closed form, evaluated for all shingles and slots at
once with numpy.
"""

from __future__ import annotations

import hashlib
import hmac

import numpy as np

try:
    from xxhash import xxh64_intdigest as xxh64
except ImportError:
    _P = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
    _M = (1 << 64) - 1

    def _rot(x: int, r: int) -> int:
        return ((x << r) | (x >> (64 - r))) & _M

    def _step(acc: int, lane: int) -> int:
        return _rot((acc + lane * _P[1]) & _M, 31) * _P[0] & _M

    def xxh64(data: bytes) -> int:
        n, at = len(data), 0
        if n >= 32:
            accs = [(_P[0] + _P[1]) & _M, _P[1], 0, (-_P[0]) & _M]
            while at + 32 <= n:
                accs = [_step(a, int.from_bytes(data[at + 8 * i : at + 8 * i + 8], "little")) for i, a in enumerate(accs)]
                at += 32
            h = sum(_rot(a, r) for a, r in zip(accs, (1, 7, 12, 18))) & _M
            for a in accs:
                h = ((h ^ _step(0, a)) * _P[0] + _P[3]) & _M
        else:
            h = _P[4]
        h = (h + n) & _M
        while at + 8 <= n:
            h = (_rot(h ^ _step(0, int.from_bytes(data[at : at + 8], "little")), 27) * _P[0] + _P[3]) & _M
            at += 8
        if at + 4 <= n:
            h = (_rot(h ^ int.from_bytes(data[at : at + 4], "little") * _P[0] & _M, 23) * _P[1] + _P[2]) & _M
            at += 4
        while at < n:
            h = _rot(h ^ data[at] * _P[4] & _M, 11) * _P[0] & _M
            at += 1
        h = (h ^ h >> 33) * _P[1] & _M
        h = (h ^ h >> 29) * _P[2] & _M
        return h ^ h >> 32


SLOTS, BANDS = 128, 16
_GOLDEN = 0x9E3779B97F4A7C15
_U = np.uint64
_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _spin(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _lane(x: np.ndarray) -> np.ndarray:
    return _spin(x * _P2, 31) * _P1


def xxh64_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the 16 bytes ``first`` and ``second``, little-endian, with broadcasting."""
    with np.errstate(over="ignore"):
        h = _P5 + _U(16)
        h = _spin(h ^ _lane(first), 27) * _P1 + _P4
        h = _spin(h ^ _lane(second), 27) * _P1 + _P4
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        return h ^ (h >> _U(32))


SEEDS = np.array([_GOLDEN * (i + 1) & (2**64 - 1) for i in range(SLOTS)], dtype=np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """128 slots: the least low half of the hashes of (shingle, seed). An empty set gives all ones."""
    if not len(shingles):
        return np.full(SLOTS, 0xFFFFFFFF, dtype=np.uint32)
    out = np.full(SLOTS, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(shingles), 4096):
        low = (xxh64_pairs(shingles[lo : lo + 4096, None], SEEDS[None, :]) & _U(0xFFFFFFFF)).astype(np.uint32)
        out = np.minimum(out, low.min(axis=0))
    return out


def bands(slots: np.ndarray) -> np.ndarray:
    """16 band hashes, each of 8 slots, as signed 64-bit numbers."""
    raw = slots.astype("<u4").tobytes()
    return np.array([xxh64(raw[32 * i : 32 * i + 32]) for i in range(BANDS)], dtype=np.uint64).view(np.int64)


def fnv1a32(text: str) -> int:
    """FNV-1a over the UTF-16 units of a text, ASCII letters in lower case."""
    h = 0x811C9DC5
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        unit = raw[i] | raw[i + 1] << 8
        if 65 <= unit <= 90:
            unit += 32
        h = (h ^ unit) * 0x01000193 & 0xFFFFFFFF
    return h


def host_hash(host: str, key: bytes | None = None) -> bytes:
    """16 bytes for a host: HMAC-SHA256 under a key of at least 16 bytes, plain SHA-256 without one."""
    data = host.lower().encode()
    if key is None:
        return hashlib.sha256(data).digest()[:16]
    if len(key) < 16:
        raise ValueError("the key must have at least 16 bytes")
    return hmac.new(key, data, hashlib.sha256).digest()[:16]
