"""Content-defined anchors of byte strings (winnowing).

An anchor is the start of a ``gram``-byte string whose hash is the least of some ``window``
neighbouring ones. Any two equal strings of gram + window - 1 bytes hold an anchor at the
same place, whatever surrounds them, so repeated strings always share anchors.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram at each start, built by doubling lengths."""
    if len(data) < gram:
        return np.zeros(0, dtype=np.uint64)
    power, length, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    base = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    rest = gram
    while rest:
        if rest & 1:
            out = power if out is None else out[: len(power) - done] * base(length) + power[done : done + len(out)][: len(out[: len(power) - done])]
            done += length
        rest >>= 1
        if rest:
            power = power[:-length] * base(length) + power[length:]
            length *= 2
    out = out[: len(data) - gram + 1]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbouring values."""
    length = 1
    while 2 * length <= width:
        values = pick(values[:-length], values[length:])
        length *= 2
    extra = width - length
    return pick(values[:-extra], values[extra:]) if extra else values


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """Starts whose hash is the least of some window that they are in."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64)
    least = _sliding(hashes, window, np.minimum)
    edge = np.zeros(window - 1, dtype=least.dtype)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), window, np.maximum) == hashes)
