"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of letters, digits, underscores and non-ASCII bytes of the lower-cased UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_rng = np.random.default_rng(20240501)
_PLACE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_WORD = np.zeros(256, bool)
IS_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", np.uint8)] = True
IS_WORD[128:] = True
#: Bytes of text that are turned into arrays together.
CHUNK = 1 << 20


def chunks(texts: Sequence[str | None], limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of runs of about `limit` characters, so that memory follows the chunk and not the batch."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > limit:
            yield start, [t or "" for t in texts[start:i]]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, [t or "" for t in texts[start:]]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a hash can serve as an index."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """hashes: a hash per word; doc: first word of each text, with the end; start, end: byte places in `data`."""

    def __init__(self, texts: Sequence[str]) -> None:
        parts = [t.lower().encode("utf-8", "replace") for t in texts]
        self.data = b"\n".join(parts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        inside = IS_WORD[raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        if len(edge):
            # runs of word bytes and of others in turn; a hash is a sum of bytes, each times a number of its place in the run
            place = np.arange(edge[0], len(raw))
            place -= np.repeat(edge, np.diff(np.append(edge, len(raw))))
            value = raw[edge[0] :].astype(np.uint64)
            value += np.uint64(257)
            value *= _PLACE.take(place & 255)
            if (self.end - self.start).max() > 256:
                value *= (place >> 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            self.hashes = mix(np.add.reduceat(value, edge - edge[0])[::2])
        else:
            self.hashes = np.zeros(0, np.uint64)
        begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        self.doc = np.searchsorted(self.start, begins)

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].decode("utf-8", "replace")


def shingles(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside a text, and the first of each text, with the end.
    A text of fewer words, but one at least, has one shingle of all its words."""
    n = np.diff(doc)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    first = np.repeat(doc[:-1], count) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)
    end = np.repeat(doc[1:], count)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    total = np.zeros(bounds[-1], np.uint64)
    for k in range(size):
        part = padded[first + k] * _SHINGLE[k]
        total += np.where(first + k < end, part, np.uint64(0)) if (n < size).any() else part
    return mix(total), bounds
