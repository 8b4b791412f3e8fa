"""Word hashes of whole texts, computed on byte arrays of about one megabyte at a time.

A word is a run of bytes other than ASCII white space, so texts of any length are taken in pieces that are cut
at white space. Hashes have 64 bits: the words of equal bytes have equal hashes, and different words differ but
for a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

PIECE = 1 << 18
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_WHITE = re.compile(rb"[ \t-\r]")
_IS_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _M1)


@lru_cache(8)
def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, _BASE, np.uint64))


_WORD = (~_IS_WHITE).astype(np.uint8)


def run_hashes(data: bytes, classes: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every run of one class of bytes; bytes of class 0 are left out."""
    a = np.frombuffer(data, np.uint8)
    c = classes[a]
    starts = np.flatnonzero(np.diff(c, prepend=0 if len(c) and c[0] else 1) != 0)
    lengths = np.diff(starts, append=len(a))
    kept = c[starts] > 0
    starts, lengths = starts[kept], lengths[kept]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    firsts = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    longest = 1 << int(lengths.max() - 1).bit_length()
    sums = np.add.reduceat(_BYTE[a[c > 0]] * _powers(max(64, longest))[inside], firsts)
    return mix(sums + lengths.astype(np.uint64) * _M1), starts


def pieces(data: bytes) -> Iterator[bytes]:
    """data in parts of about PIECE bytes, cut at white space."""
    at = 0
    while at < len(data):
        cut = _WHITE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def encoded(text: str | None, lower: bool = False) -> bytes:
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return data.lower() if lower else data


def word_hashes(texts: Sequence[str | None], lower: bool = False, classes: np.ndarray = _WORD) -> Iterator[np.ndarray]:
    """For each text the hashes of its words in order; lower: A-Z count as a-z. Null counts as empty.

    classes: other words than runs without white space, as a class for each byte; white space has class 0.
    """
    group: list[bytes] = []
    held = 0
    for text in texts:
        data = encoded(text, lower)
        if held + len(data) > PIECE and group:
            yield from _together(group, classes)
            group, held = [], 0
        if len(data) > PIECE:
            yield np.concatenate([run_hashes(x, classes)[0] for x in pieces(data)])
        else:
            group.append(data)
            held += len(data) + 1
    if group:
        yield from _together(group, classes)


def _together(group: list[bytes], classes: np.ndarray) -> list[np.ndarray]:
    hashes, starts = run_hashes(b"\n".join(group), classes)
    ends = np.cumsum([len(x) + 1 for x in group])
    return np.split(hashes, np.searchsorted(starts, ends[:-1]))


@lru_cache(64)
def _place(i: int) -> np.uint64:
    """An odd factor for the i-th word of a window."""
    return mix(np.array([i], np.uint64) * _M3)[0] | np.uint64(1)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n-word window, in order; a shorter sequence is one window, an empty one has none."""
    width = min(n, len(hashes))
    if not width:
        return hashes
    n_out = len(hashes) - width + 1
    out = hashes[:n_out] * _M1
    for i in range(1, width):
        out = out + hashes[i : i + n_out] * _place(i)
    return mix(out + np.uint64(width))
