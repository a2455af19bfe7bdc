"""Word hashes of whole texts, by array operations over their UTF-8 bytes.

Words are runs of bytes other than white space (0x20, 0x09-0x0D). A word's hash is the polynomial of its bytes, taken from
prefix sums modulo 2**64 and divided by the power of its place, with its length mixed in.
"""

from __future__ import annotations

import numpy as np

#: Bytes at a time; the tables of powers need not be longer (unless one word is).
CHUNK = 1 << 20
BASE = int(np.random.default_rng(31).integers(2**60, 2**62)) * 2 + 1
LENGTH = np.uint64(0x9E3779B97F4A7C15)

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_tables = [np.ones(1, "u8"), np.ones(1, "u8")]


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_tables[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 2**64))):
            steps = np.full(max(4096, 2 * n), b, "u8")
            steps[0] = 1
            _tables[k] = np.cumprod(steps)
    return _tables


def word_hashes(raw: bytes | None) -> np.ndarray:
    """64-bit hashes of a text's words, in order."""
    raw = raw or b""
    if len(raw) <= CHUNK:
        return _hashes(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        while end < len(raw) and not _space[raw[end]]:
            end += 1
        parts.append(_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts)


def _hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, "u1")
    edge = np.diff(_space[b].view("i1"), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, back = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, "u8")
    np.cumsum(b * power[: len(b)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype("u8") * LENGTH)
