"""Words of UTF-8 texts as numpy arrays, a whole Arrow batch at a time (no loop over words)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
PART_BYTES = 1 << 21  # bytes hashed at a time; a longer text makes a longer part


class Words(NamedTuple):
    """Words of some texts in order: hash and byte range of each, and where each text's words begin (n texts + 1)."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of ``x``."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        steps = np.full(max(n, PART_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the n + 1 offsets of its texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def parts(offsets: np.ndarray):
    """Ranges of texts of about PART_BYTES together (one text at least)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PART_BYTES, side="right")) - 1)
        yield first, last
        first = last


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True, bare: bool = False) -> Words:
    """Maximal runs of bytes other than space and 0x09-0x0D, A-Z lower-cased for the hash if wanted.

    Equal words have equal hashes; different ones differ but for 64-bit coincidence. ``bare`` words lose the ASCII
    punctuation at both ends, and are left out when nothing else is in them.
    """
    data = _LOWER[raw] if lower else raw
    solid = ~_SPACE[raw]
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    before[inner] = False  # a text ends a word
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = solid[1:]
    last = offsets[1:] - 1
    after[last[(last >= 0)]] = False
    ends = np.flatnonzero(solid & ~after) + 1
    if bare:
        starts, ends = _stripped(raw, starts, ends)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("p", _P, len(raw) + 1)[: len(raw)], dtype=np.uint64, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power("i", _P_INV, len(raw) + 1)[starts])
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def _stripped(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = starts.copy(), ends.copy()
    at = np.arange(len(starts))
    while len(at := at[(starts[at] < ends[at]) & _PUNCT[raw[np.minimum(starts[at], len(raw) - 1)]]]):
        starts[at] += 1
    at = np.arange(len(starts))
    while len(at := at[(starts[at] < ends[at]) & _PUNCT[raw[ends[at] - 1]]]):
        ends[at] -= 1
    full = starts < ends
    return starts[full], ends[full]


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of ``size`` words inside one text; a text with fewer words gives its whole sequence once."""
    counts = np.diff(w.bounds)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), made)
    begin = np.repeat(w.bounds[:-1] - np.concatenate(([0], np.cumsum(made)[:-1])), made) + np.arange(len(doc))
    length = np.minimum(counts, size)[doc]
    padded = np.concatenate((w.hashes, np.zeros(size, dtype=np.uint64)))
    out = length.astype(np.uint64)
    for k in range(size):
        out = mix(out * _P + np.where(k < length, padded[begin + k], np.uint64(0)))
    return doc, out
