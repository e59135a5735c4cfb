"""Words of many texts at once: numpy over the texts' UTF-8 bytes, without a Python step for each word."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: A fixed odd 64-bit value for each byte.
BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= 1 << 23:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def joined(texts: list[bytes], sep: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text followed by one separator, and where each text begins (and where the last has ended)."""
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(sep) for t in texts], out=begins[1:])
    return np.frombuffer(sep.join([*texts, b""]), np.uint8), begins


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: equal bytes, equal hash, wherever they stand."""
    n = len(data) + 1
    total = np.zeros(n, np.uint64)
    np.cumsum(BYTE[data] * _power(BASE, n)[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * _power(BASE_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def chunks(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``; a larger row stands alone."""
    out, at, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            out.append((at, i))
            at, total = i, 0
        total += n
    if at < len(sizes):
        out.append((at, len(sizes)))
    return out
