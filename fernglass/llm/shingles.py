"""Distinct word shingles of whole texts as sorted 64-bit hashes, computed for a batch of texts at once.

Word hashes come from prefix sums of a random table times powers of an odd base (modulo 2**64, then mixed), so
no Python object is made for a word. Two different shingles of one text share a hash with probability of about
n**2 / 2**65 for n shingles."""

from __future__ import annotations

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240229))
#: One random value per byte; A-Z share those of a-z.
_BYTES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text worked on at once.
BLOCK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, BLOCK), _powers(_INVERSE, BLOCK)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of one block and where they start; no word crosses the block's ends."""
    n = len(data)
    up, down = (_UP, _DOWN) if n <= BLOCK else (_powers(_BASE, n), _powers(_INVERSE, n))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:n], dtype=np.uint64)])
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _IS_SPACE[data], [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a text with fewer words than `width` has its whole
    word sequence as one shingle, one without words (or null) has none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        stop, held = at, 0
        while stop < len(raw) and (stop == at or held + len(raw[stop]) < BLOCK):
            held += len(raw[stop]) + 1
            stop += 1
        out += _block_sets(raw[at:stop], width)
        at = stop
    return out


def _block_sets(raw: list[bytes], width: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    words, starts = _word_hashes(data)
    bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    first = np.searchsorted(starts, bounds)
    n = max(0, len(words) - width + 1)
    rolled = words[:n].copy()
    for k in range(1, width):
        rolled = mix(rolled * _BASE + words[k : n + k])
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in words[a:b]:
                whole = mix(whole * _INVERSE + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
