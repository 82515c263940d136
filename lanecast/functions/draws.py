"""pricing.uniform for many draws at once: the md5 of one short key under each of them, in numpy."""

from __future__ import annotations

import hashlib
from math import floor, sin

import numpy as np

_K = [np.uint32(floor(abs(sin(n + 1)) * 2**32)) for n in range(64)]
_TURN = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_WORD = [*range(16), *[(5 * n + 1) % 16 for n in range(16)], *[(3 * n + 5) % 16 for n in range(16)], *[7 * n % 16 for n in range(16)]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
ONE_BLOCK = 55  # bytes that md5 takes in one step
CELLS = 1 << 16  # of a step's arrays, so that they stay in the processor's cache


def _first_word(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The digest's first four bytes as a big-endian number; words: the block's 16, each of a shape that broadcasts to `shape`."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for n in range(64):
        if n < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif n < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif n < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a), np.add(a, words[_WORD[n]] + _K[n], out=a)
        np.left_shift(a, np.uint32(_TURN[n]), out=f), np.right_shift(a, np.uint32(32 - _TURN[n]), out=t), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    np.add(a, np.uint32(_START[0]), out=a)
    return a.byteswap()


def _blocks(texts: list[bytes], at: int) -> np.ndarray:
    """A row of 64 bytes a text, which starts at a byte."""
    gap = b"\0" * at
    return np.frombuffer(b"".join([(gap + x).ljust(64, b"\0") for x in texts]), np.uint32).reshape(len(texts), 16).copy()


def uniforms(seed: int, n: int, keys: list[str]):
    """Yields (draws, rows, u): slices, and the uniforms of f"{seed}|{draw}{key}" of these keys (down) and draws 0..n-1 (across)."""
    tails = [k.encode() for k in keys]
    for digits in range(1, len(str(n - 1)) + 1):
        lo, hi = 10 ** (digits - 1) if digits > 1 else 0, min(n, 10**digits)
        heads = [f"{seed}|{draw}".encode() for draw in range(lo, hi)]
        long, step = len(heads[0]), max(1, CELLS // len(heads))
        for start in range(0, len(tails), step):
            some = tails[start:start + step]
            where = slice(lo, hi), slice(start, start + len(some))
            if max(map(len, some)) + long > ONE_BLOCK:
                whole = [[int.from_bytes(hashlib.md5(h + x).digest()[:4]) for h in heads] for x in some]
                yield *where, np.array(whole) / 4294967296.0
                continue
            rows, across = _blocks([x + b"\x80" for x in some], long), _blocks(heads, 0)
            rows[:, 14] = [8 * (long + len(x)) for x in some]
            if len(heads) >= len(some):  # the longer side lies along the arrays' rows
                words = [rows[:, k:k + 1] | across[None, :, k] if 4 * k < long else rows[:, k:k + 1] for k in range(16)]
                yield *where, _first_word(words, (len(some), len(heads))) / 4294967296.0
            else:
                words = [np.ascontiguousarray(rows[:, k])[None] for k in range(16)]
                words = [w | across[:, k:k + 1] if 4 * k < long else w for k, w in enumerate(words)]
                yield *where, _first_word(words, (len(heads), len(some))).T / 4294967296.0
