"""Content-defined anchors of fixed-length windows (robust against the text around them).

A *window* is ``width`` consecutive symbols of one sequence.  Its *anchor* is the position of the smallest
``gram``-symbol hash inside it (the leftmost on ties), so equal windows have equal anchors at equal offsets.
Consecutive windows with one anchor form a *region*: the symbols that all those windows cover.  Two windows can only be
equal if the hashes of their anchors are; if their regions are equal, so are all their windows.

Everything here is numpy over many sequences laid end to end; hashes are polynomials modulo 2**64 with an odd,
hence invertible, base, followed by a finalizer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)
#: low bits of a packed minimum that hold the position; batches are cut so that positions fit
POSITION_BITS = 22


def finalize(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit hash (multiply, xor, shift)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base & MASK, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of symbols[j] * BASE**j over j < i, modulo 2**64."""
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols.astype(np.uint64) * powers(BASE, len(symbols)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:stop], the same wherever they stand."""
    inverse = powers(INVERSE, len(sums))
    return finalize((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values (two passes over blocks of that width)."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


@dataclass
class Regions:
    """Regions in the order of their first windows; positions are in the laid-out symbols."""

    sequence: np.ndarray  # which input sequence
    first: np.ndarray  # first window start
    last: np.ndarray  # last window start
    anchor: np.ndarray  # position of the anchor
    anchor_hash: np.ndarray
    region_hash: np.ndarray
    sums: np.ndarray


def regions(symbols: np.ndarray, lengths: np.ndarray, width: int, gram: int) -> Regions:
    """The regions of all windows; sequences shorter than a window have none.

    symbols: all sequences end to end; lengths: their lengths; fewer than 2**22 symbols.
    """
    assert len(symbols) < 1 << POSITION_BITS
    sums = prefix_sums(symbols)
    empty = np.zeros(0, dtype=np.int64)
    n = len(symbols) - gram + 1
    if len(symbols) < width or n <= 0:
        return Regions(empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), sums)
    at = np.arange(n, dtype=np.int64)
    hashes = span_hash(sums, at, at + gram)
    low = np.uint64((1 << POSITION_BITS) - 1)
    packed = (hashes & ~low) | at.astype(np.uint64)
    least = (sliding_min(packed, width - gram + 1) & low).astype(np.int64)  # anchor of each window start
    ends = np.cumsum(lengths)
    starts = ends - lengths
    count = np.maximum(lengths - width + 1, 0)
    which = np.repeat(np.arange(len(lengths)), count)
    # window starts of all sequences, in order
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    if not len(window):
        return Regions(empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), sums)
    anchor = least[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1])
    k = np.flatnonzero(new)
    first, last = window[k], window[np.append(k[1:], len(window)) - 1]
    anchor = anchor[k]
    body = span_hash(sums, first, last + width)
    with np.errstate(over="ignore"):
        place = (anchor - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return Regions(which[k], first, last, anchor, hashes[anchor], finalize(body ^ place), sums)
