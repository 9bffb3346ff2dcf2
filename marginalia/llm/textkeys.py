"""Vectorised word and shingle hashing over batches of UTF-8 texts.

Words are maximal runs of bytes outside space and 0x09-0x0D; A-Z is folded to
lower case.  Every hash is a function of the bytes alone (fixed constants), so
separate tasks, retries and machines agree.
"""

from __future__ import annotations

import re

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C55 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BASE_INVERSE, k, 1 << 64))])
        return self.up[:n], self.down[:n]

    def shrink(self) -> None:
        """Forget what only a very long word needed."""
        if len(self.up) > 4 * STRETCH:
            self.up, self.down = self.up[: 2 * STRETCH].copy(), self.down[: 2 * STRETCH].copy()


_POWERS = _Powers()
#: Up to the last white space of a stretch; the first one.
_LAST_BLANK = re.compile(rb".*[\x09-\x0d\x20]", re.DOTALL)
_NEXT_BLANK = re.compile(rb"[\x09-\x0d\x20]")
#: Bytes hashed at a time; a stretch ends at the last white space in it, or goes on to the first one after it.
STRETCH = 1 << 20


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, number of words of each text); beyond the texts, memory is a stretch's and 8 bytes a word."""
    joined = b"\n".join(texts) + b"\n"
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    hashes, before, at = [], np.zeros(len(texts), dtype=np.int64), 0
    while at < len(joined):
        end = len(joined)
        if at + STRETCH < end:
            last = _LAST_BLANK.search(joined, at, at + STRETCH) or _NEXT_BLANK.search(joined, at + STRETCH)
            end = last.end()
        raw = np.frombuffer(joined[at:end].translate(FOLD), dtype=np.uint8)
        blank = SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        before += np.searchsorted(starts + at, text_ends)
        up, down = _POWERS.get(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[raw] * up[: len(raw)], out=total[1:])
        hashes.append(mix((total[ends] - total[starts]) * down[starts]))
        at = end
    _POWERS.shrink()
    return np.concatenate(hashes), np.diff(np.concatenate([[0], before]))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words of one text, in order; a shorter text is one run."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    width = min(size, n)
    out = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(0x2545F4914F6CDD1D) + words[i : n - width + 1 + i]
        out ^= out >> np.uint64(29)
    return mix(out)


def batch_shingles(texts: list[bytes], size: int, budget: int = 1 << 20):
    """Yield, text by text, the ascending distinct shingle hashes; works through `budget` bytes at a time."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= budget):
            total += len(texts[end])
            end += 1
        words, counts = word_hashes(texts[at:end])
        stops = np.cumsum(counts)
        # all runs at once; a run that would cross into the next text is left out
        n = len(words)
        if n >= size:
            runs = shingle_hashes(words, size)
            for stop, count in zip(stops, counts):
                if count >= size:
                    yield np.unique(runs[stop - count : stop - size + 1])
                else:
                    yield np.unique(shingle_hashes(words[stop - count : stop], size))
        else:
            for stop, count in zip(stops, counts):
                yield shingle_hashes(words[stop - count : stop], size)
        at = end
