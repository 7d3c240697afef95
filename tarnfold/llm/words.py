"""Word hashes of whole texts in array steps: a text's UTF-8 bytes in, one 64-bit hash a word out.

Words end at the bytes 0x20 and 0x09 to 0x0D only. A word's hash is a polynomial over a fixed random value for each
byte, modulo 2**64, then mixed; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: 0 space, 1 letters, digits and all bytes beyond ASCII, 2 other signs.
_KIND = np.full(256, 2, np.uint8)
_KIND[_SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1
PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES = [_powers(_BASE, 1 << 14), _powers(_UNBASE, 1 << 14)]


def _tables(n: int) -> list[np.ndarray]:
    if len(_TABLES[0]) < n:
        _TABLES[:] = [_powers(_BASE, 2 * n), _powers(_UNBASE, 2 * n)]
    return _TABLES


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(data: bytes) -> list[tuple[int, bytes]]:
    """The text cut at white space into pieces of about ``PIECE`` bytes, each with its offset (a longer word stays whole)."""
    if len(data) <= PIECE:
        return [(0, data)]
    space = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8)])
    cuts, at = [0], 0
    while at + PIECE < len(data):
        k = int(np.searchsorted(space, at + PIECE))
        if k == len(space):
            break
        at = int(space[k])
        cuts.append(at)
    cuts.append(len(data))
    return [(s, data[s:e]) for s, e in zip(cuts, cuts[1:], strict=False) if e > s]


def _hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    power, inverse = _tables(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(value[a] * power[: len(a)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of each word; ``lower`` takes A-Z as a-z."""
    got = []
    for offset, piece in _pieces(data):
        a = np.frombuffer(piece, np.uint8)
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = ~_SPACE[a]
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        got.append((_hashes(a, starts, ends, _LOWER if lower else _VALUE), starts + offset, ends + offset))
    if len(got) == 1:
        return got[0]
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))  # type: ignore[return-value]


def runs(data: bytes) -> np.ndarray:
    """Hash of each run of letters and of each run of other signs, case kept."""
    got = []
    for _, piece in _pieces(data):
        a = np.frombuffer(piece, np.uint8)
        kind = np.zeros(len(a) + 2, np.uint8)
        kind[1:-1] = _KIND[a]
        change = np.flatnonzero(kind[1:] != kind[:-1])
        starts, ends = change[:-1], change[1:]
        real = kind[starts + 1] > 0
        got.append(_hashes(a, starts[real], ends[real], _VALUE) if len(change) else np.empty(0, np.uint64))
    return got[0] if len(got) == 1 else np.concatenate(got)


_SALTS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(data: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``k`` words; with fewer words the whole sequence is one, with none there is none."""
    h = words(data)[0]
    if not len(h):
        return h
    n = max(len(h) - k + 1, 1)
    out = np.full(n, np.uint64(min(k, len(h))), np.uint64)
    for j in range(min(k, len(h))):
        out = mix(out * _SALTS[j % 5] + h[j : j + n])
    return np.unique(out)


def tokens(data: bytes) -> np.ndarray:
    """Hash of each run of letters, digits and bytes beyond ASCII, A-Z taken as a-z; other signs only part them."""
    got = []
    for _, piece in _pieces(data):
        a = np.frombuffer(piece, np.uint8)
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = _KIND[a] == 1
        step = np.diff(inside)
        got.append(_hashes(a, np.flatnonzero(step == 1), np.flatnonzero(step == -1), _LOWER))
    return got[0] if len(got) == 1 else np.concatenate(got)


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbours, in order; empty if there are fewer."""
    n = len(h) - k + 1
    if k < 1 or n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        out = mix(out * _SALTS[j % 5] + h[j : j + n])
    return out
