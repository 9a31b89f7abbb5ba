"""Word shingles of whole texts as 64-bit hashes, for many texts at once in numpy.

Words are hashed from one buffer with prefix sums of byte codes times powers of
an odd number modulo 2**64, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POSITION = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text that are hashed together at least; a longer text makes a buffer of its own size.
BUFFER = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of the base and of its inverse, grown to the longest buffer met."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]), dtype=np.uint64)


_POWERS = Powers()


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, and where each text's words begin (one more entry at the end)."""
    buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2] + 1, edge[1::2]  # first and last byte of each word
    _POWERS.grow(len(buf))
    total = np.cumsum(_BYTE[buf] * _POWERS.up[: len(buf)], dtype=np.uint64)
    hashes = mix((total[ends] - total[starts - 1]) * _POWERS.down[starts])
    begins = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]) + 1)
    return hashes, begins


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of runs of bytes of a buffer (from ``starts`` to before ``ends``; no run begins at byte 0); other seeds, other hashes."""
    codes = mix(_BYTE + np.uint64(seed)) if seed else _BYTE
    _POWERS.grow(len(buf))
    total = np.cumsum(codes[buf] * _POWERS.up[: len(buf)], dtype=np.uint64)
    return mix((total[ends - 1] - total[starts - 1]) * _POWERS.down[starts])


def shingle_hashes(texts: Sequence[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """All k-word shingles of each text in order, repeats included, and where each text's begin.

    A text of fewer than k words has its whole sequence as one shingle; a text
    without words has none.
    """
    words, begins = word_hashes(texts)
    n = np.diff(begins)
    full = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
    for j in range(k):
        full += words[j : len(words) - k + 1 + j] * _POSITION[j]
    full = mix(full)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_begins = np.concatenate([[0], np.cumsum(count)])
    rows = np.repeat(begins[:-1] - out_begins[:-1], count) + np.arange(out_begins[-1])
    out = full[np.minimum(rows, max(0, len(full) - 1))] if len(full) else np.zeros(len(rows), dtype=np.uint64)
    for i in np.flatnonzero((n > 0) & (n < k)):
        own = words[begins[i] : begins[i + 1]]
        out[out_begins[i]] = mix((own * _POSITION[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    return out, out_begins


def buffers(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are hashed together."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BUFFER:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def ascii_lower(texts: Sequence[str | None]) -> list[bytes]:
    """UTF-8 bytes with A-Z as a-z and every other character as it is."""
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
