"""The first four hex digits of many MD5 sums at once, as numbers: the stand-in models take every value from such digits, and one call of a
hash function per token costs more than the hash itself."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_WORDS = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
#: Messages that are hashed together, so many that the work of a step outweighs its call.
CHUNK = 32768
#: Longer tokens are hashed one by one.
LONG = 64


def _block(state: tuple, words: np.ndarray) -> tuple:
    a, b, c, d = state
    for i in range(64):
        if i < 16:
            f = c ^ d
            f &= b
            f ^= d
        elif i < 32:
            f = b ^ c
            f &= d
            f ^= c
        elif i < 48:
            f = b ^ c
            f ^= d
        else:
            f = ~d
            f |= b
            f ^= c
        f += a
        f += words[_WORDS[i]]
        f += _ADDED[i]
        turned = f << np.uint32(_TURNS[i])
        f >>= np.uint32(32 - _TURNS[i])
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    return tuple(x + y for x, y in zip(state, (a, b, c, d)))


def md5_digits(messages: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row of ``messages`` (bytes, zeros behind the row's first ``sizes``; wide enough for the padding) the number that the first four
    hex digits of its MD5 sum are."""
    out = np.empty(len(sizes), np.uint16)
    blocks = (sizes + 8) // 64 + 1
    for n in np.unique(blocks):
        for at in np.array_split(np.flatnonzero(blocks == n), max(1, int((blocks == n).sum()) // CHUNK)):
            m = messages[at, : 64 * n]
            m[np.arange(len(at)), sizes[at]] = 0x80
            m[:, 64 * n - 8:] = (sizes[at].astype("<u8") * 8).view(np.uint8).reshape(-1, 8)
            words = m.view("<u4")
            state = tuple(np.full(len(at), x) for x in _START)
            for k in range(n):
                state = _block(state, np.ascontiguousarray(words[:, 16 * k:16 * k + 16].T))
            out[at] = (state[0] & np.uint32(0xFF)) << np.uint32(8) | (state[0] >> np.uint32(8)) & np.uint32(0xFF)
    return out


def digits_of(message: bytes) -> int:
    return int.from_bytes(hashlib.md5(message).digest()[:2], "big")


def token_bytes(tokens: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The bytes of ASCII tokens, one per row, their sizes, and which tokens are over ``LONG`` bytes: these are cut here and need ``digits_of``."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    width = min(max(int(sizes.max(initial=1)), 1), LONG)
    long = np.flatnonzero(sizes > LONG)
    return np.array(tokens, dtype=f"S{width}").view(np.uint8).reshape(len(tokens), width), np.minimum(sizes, LONG), long.tolist()


def table(n: int, width: int) -> np.ndarray:
    """Room for ``n`` messages of up to ``width`` bytes and their padding."""
    return np.zeros((n, (width + 8) // 64 * 64 + 64), np.uint8)


@lru_cache(maxsize=8)
def _numbers(width: int) -> np.ndarray:
    """The digits of all numbers of ``width`` digits, from 0."""
    lo = 10 ** (width - 1) if width > 1 else 0
    rest = np.arange(lo, 10**width)
    return np.stack([rest // 10**k % 10 + 48 for k in range(width - 1, -1, -1)], axis=1).astype(np.uint8)


def put_numbers(messages: np.ndarray, at: int) -> list[tuple[int, int, int]]:
    """Write 0, 1, 2, ... in decimal into the rows from byte ``at``; returns (first row, row behind the last, digits) of each width."""
    out = []
    lo, width = 0, 1
    while lo < len(messages):
        hi = min(10**width, len(messages))
        messages[lo:hi, at:at + width] = _numbers(width)[: hi - lo]
        out.append((lo, hi, width))
        lo, width = hi, width + 1
    return out
