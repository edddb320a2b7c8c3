"""Word shingles of whole texts, hashed to 64 bits with numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Shingle width in words.
WIDTH = 5
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15


@cache
def _constants() -> tuple[np.ndarray, np.ndarray, int]:
    rng = np.random.default_rng(20240229)
    byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    place = rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return byte, place, pow(_BASE, -1, 2**64)


_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 24:
            _POWERS[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words of data; words are runs without ASCII white space."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return starts, span_hashes(raw, starts, ends)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes; equal spans have equal hashes wherever they lie."""
    byte, _, inverse = _constants()
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(byte[raw] * _powers("up", _BASE, len(raw)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _powers("down", inverse, len(raw) + 1)[starts]
    return mix(value ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; with fewer words than width, one hash of all; else empty."""
    _, place, _ = _constants()
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        parts, size, first = [], 0, at
        while at < len(texts) and (size < 1 << 20 or at == first):
            part = (texts[at] or "").encode("utf-8", "surrogatepass").translate(_LOWER)
            parts.append(part)
            size += len(part) + 1
            at += 1
        starts, words = word_hashes(b"\n".join(parts))
        bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
        cuts = np.searchsorted(starts, bounds)
        many = max(0, len(words) - width + 1)
        rolled = np.zeros(many, dtype=np.uint64)
        for j in range(width):
            rolled += words[j : j + many] * place[j]
        rolled = mix(rolled)
        for k in range(len(parts)):
            a, b = cuts[k], cuts[k + 1]
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                # the count takes part, so that a short text never equals a shingle of a longer one
                short = np.append(words[a:b], np.uint64(int(b - a))) * np.append(place[: b - a], place[63])
                out.append(mix(np.add.reduce(short, keepdims=True)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out
