"""64-bit hashes of the words of many texts at a time; A-Z lowered, words separated by ASCII white space."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_STEP = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2^64
CHUNK_BYTES = 1 << 22  # of text hashed at a time


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z


class Powers:
    """Powers of _STEP and of its inverse modulo 2^64, as many as the longest chunk so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.full(n, x % (1 << 64), np.uint64) for x in (_STEP, pow(_STEP, -1, 1 << 64)))
            for x in (self.up, self.down):
                x[0] = 1
                np.multiply.accumulate(x, out=x)
        return self.up[:n], self.down[:n]


def word_hashes(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word of data, which white space begins and ends: a polynomial over the word's bytes, mixed."""
    buf = np.frombuffer(data, np.uint8)
    gap = _SPACE[buf]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(buf))
    sums = np.cumsum(_BYTE[buf] * up, dtype=np.uint64)
    return starts, mixed((sums[ends - 1] - sums[starts - 1]) * down[starts] ^ (ends - starts).astype(np.uint64) * ODD)


class Words:
    """Word hashes of many texts at a time."""

    def __init__(self):
        self.powers = Powers()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's begin (one more than texts)."""
        data = [t.encode("utf-8") for t in texts]
        begins = np.cumsum([1, *[len(d) + 1 for d in data]])
        whole, at, starts, hashes = b"\n" + b"\n".join(data) + b"\n", 0, [], []
        while at < len(whole) - 1:
            end = min(at + CHUNK_BYTES, len(whole) - 1)
            while not _SPACE[whole[end]]:  # on to the next white space
                end += 1
            s, h = word_hashes(whole[at : end + 1], self.powers)
            starts.append(s + at)
            hashes.append(h)
            at = end
        none = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        return np.concatenate(hashes or none[1]), np.searchsorted(np.concatenate(starts or none[0]), begins)
