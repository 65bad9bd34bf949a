"""Words of many texts at once, as 64-bit hashes, straight from Arrow buffers.

A word is a run of ASCII letters and digits and of bytes above 127; ASCII and
Latin-1 letters are lower-cased. The hash of a word is the same wherever it
stands. All work is on arrays, a bounded slice of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_PRIME = 0x9E3779B97F4A7C15 | 1


def _alphabet() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for chars in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz"):
        table[list(chars)] = list(chars)
    table[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = list(b"abcdefghijklmnopqrstuvwxyz")
    table[128:] = np.arange(128, 256)
    return table


_ALPHABET = _alphabet()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    size = max(SLICE, 1 << max(0, size - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for base in (_PRIME, pow(_PRIME, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the value."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


@dataclass(frozen=True)
class Words:
    """Word hashes of a slice of texts; text i has the words first[i] to first[i + 1]."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray


def hashed(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    base = _ALPHABET[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    base[after] += 0x20
    inside = base != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), starts)
    powers, inverse = _powers(len(data))
    sums = np.add.reduceat(base * powers[:len(data)], starts)
    return Words(mixed(sums * inverse[starts]), np.searchsorted(starts, offsets), starts)


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about ``SLICE`` bytes: the first text's number, bytes, offsets. Nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def of_text(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return hashed(data, np.array([0, len(data)])).hashes
