"""Vectorised token hashes over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE, WORD, MARK = 0, 1, 2
#: Bytes of one text that are hashed at a time; a longer text is cut at white space.
WINDOW = 1 << 20
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _classes() -> np.ndarray:
    kind = np.full(256, MARK, np.uint8)
    for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
        kind[low:high] = WORD
    kind[list(range(0, 33)) + [127]] = SPACE
    return kind


KIND = _classes()
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Radix powers and their inverses modulo 2^64."""
    up = np.full(n, _RADIX)
    up[0] = 1
    inverse = np.uint64(pow(int(_RADIX), -1, 1 << 64))
    down = np.full(n, inverse)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_TABLE: list[np.ndarray] = []


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLE or len(_TABLE[0]) < n:
        _TABLE[:] = _powers(max(n, 1 << 16))
    return _TABLE[0], _TABLE[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def hash_tokens(raw: np.ndarray, marks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the tokens in bytes: runs of letters and digits (any byte over 127 too) and,
    with marks, runs of other printing bytes. A-Z count as a-z."""
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    kind = KIND[raw]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = np.concatenate(([0], edge))
    end = np.concatenate((edge, [len(raw)]))
    keep = kind[start] != SPACE if marks else kind[start] == WORD
    start, end = start[keep], end[keep]
    up, down = _table(len(raw) + 1)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum((FOLD[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start, end


def windows(text: bytes, marks: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """hash_tokens over a whole text of any length; memory is bounded by WINDOW unless one token is longer."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + WINDOW)
        if stop < len(text):
            cut = max(text.rfind(b" ", at, stop), text.rfind(b"\n", at, stop))
            while cut <= at and stop < len(text):
                stop = min(len(text), stop + WINDOW)
                cut = max(text.rfind(b" ", at, stop), text.rfind(b"\n", at, stop))
            stop = stop if cut <= at else cut
        h, s, e = hash_tokens(np.frombuffer(text, np.uint8, stop - at, at), marks)
        yield h, s + at, e + at
        at = stop


def token_hashes(text: bytes, marks: bool = False) -> np.ndarray:
    parts = [h for h, _, _ in windows(text, marks)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive tokens; fewer than n tokens: one hash of them all; none: empty."""
    n = min(n, len(h))
    if not n:
        return h
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * _RADIX + h[k : len(h) - n + 1 + k])
    return out
