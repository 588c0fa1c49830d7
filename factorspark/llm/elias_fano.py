"""Elias-Fano sequences in numpy: ascending integers in about two bits and a few low bits each, searched in place.

A value's low bits stand in a packed array; its high part is coded in unary in a bit vector, in which the zeros end the
groups of equal high parts. A word-level count of zeros finds a group, a binary search over the low bits inside it
finds a value. All queries are arrays. A sequence is a dict of arrays, so it can be written to and mapped from files.
"""

from __future__ import annotations

import numpy as np

_BYTE_ONES = np.array([bin(k).count("1") for k in range(256)], dtype=np.uint8)
# Place of the k-th zero in a byte (8 where there is none).
_ZERO_AT = np.array([([p for p in range(8) if not b >> p & 1] + [8] * 8)[:8] for b in range(256)], dtype=np.uint8)
_CHUNK = 1 << 16


def _pack(x: np.ndarray, width: int) -> np.ndarray:
    """``x`` in ``width`` bits each, low bits first."""
    if not width:
        return np.zeros(1, dtype=np.uint64)
    parts = []
    for a in range(0, len(x), _CHUNK):  # _CHUNK values fill whole bytes
        bytes_ = np.ascontiguousarray(x[a : a + _CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(bytes_, axis=1, bitorder="little")[:, :width]
        parts.append(np.packbits(bits.reshape(-1), bitorder="little"))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return np.concatenate((flat, np.zeros(16 - len(flat) % 8, np.uint8))).view("<u8")


def _unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), dtype=np.uint64)
    bit = at.astype(np.int64) * width
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


def build(values: np.ndarray) -> dict[str, np.ndarray]:
    """The sequence of ascending ``values`` (unsigned 64-bit)."""
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, min(56, (top // max(n, 1)).bit_length() - 1))
    high = (values >> np.uint64(width)).astype(np.int64)
    groups = int(high[-1]) + 1 if n else 1
    bits = np.zeros((n + groups + 64) // 8 + 1, dtype=np.uint8)
    ones = high + np.arange(n)
    np.bitwise_or.at(bits, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
    zeros = 8 - _BYTE_ONES[bits].astype(np.int64)
    return {
        "head": np.array([n, width, groups], dtype=np.int64),
        "low": _pack(values & np.uint64((1 << width) - 1), width),
        "bits": bits,
        "zeros": (np.cumsum(zeros) - zeros)[::8].astype(np.int64),  # zeros before every eighth byte
    }


def _end_of_group(ef: dict[str, np.ndarray], group: np.ndarray) -> np.ndarray:
    """Number of values whose high part is at most ``group`` (0-based; -1 gives 0)."""
    valid = np.maximum(group, 0)
    block = np.searchsorted(ef["zeros"], valid, side="right") - 1
    left = valid - ef["zeros"][block]
    byte = block * 8
    out = np.full(len(group), -1, dtype=np.int64)
    last = len(ef["bits"]) - 1
    for _ in range(8):
        now = ef["bits"][np.minimum(byte, last)]
        count = 8 - _BYTE_ONES[now].astype(np.int64)
        here = (out < 0) & (left < count)
        out = np.where(here, byte * 8 + _ZERO_AT[now, np.clip(left, 0, 7)], out)
        left = np.where(out < 0, left - count, left)
        byte = byte + 1
    return np.where(group < 0, 0, out - valid)


def find(ef: dict[str, np.ndarray], values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
    """Index of each value in the sequence (between ``begin`` and ``end``), or -1: its successor is found and compared."""
    n, width, groups = (int(v) for v in ef["head"])
    if not n or not len(values):
        return np.full(len(values), -1, dtype=np.int64)
    values = values.astype(np.uint64)
    group = np.minimum(values >> np.uint64(width), np.uint64(groups)).astype(np.int64)
    inside = group < groups
    group = np.minimum(group, groups - 1)
    lo, hi = _end_of_group(ef, group - 1), _end_of_group(ef, group)
    if begin is not None:
        lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
    want = values & np.uint64((1 << width) - 1)
    stop = hi
    while (lo < hi).any():  # successor search: the first low part that is not smaller
        mid = (lo + hi) >> 1
        less = (_unpack(ef["low"], width, np.minimum(mid, n - 1)) < want) & (lo < hi)
        lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
    hit = inside & (lo < stop)
    return np.where(hit & (_unpack(ef["low"], width, np.minimum(lo, n - 1)) == want), lo, -1)


def get(ef: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Values at the given indexes: the place of the one in the bit vector minus its rank is the high part."""
    n, width, groups = (int(v) for v in ef["head"])
    lo, hi = np.zeros(len(at), dtype=np.int64), np.full(len(at), groups - 1, dtype=np.int64)
    while (lo < hi).any():  # smallest group that ends after the index
        mid = (lo + hi) >> 1
        after = _end_of_group(ef, mid) > at
        lo, hi = np.where(after, lo, mid + 1), np.where(after, mid, hi)
    return (lo.astype(np.uint64) << np.uint64(width)) | _unpack(ef["low"], width, at)
