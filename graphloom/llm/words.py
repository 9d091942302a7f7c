"""Word and shingle hashes of many texts at once, in numpy.

A word is a maximal run of bytes that are no ASCII white space; A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ROUND = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; the array is changed in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def series(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit numbers, the same in every process."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_BYTE, _PLACE, _SLOT = series(256, 1), series(_ROUND, 2), series(8, 3)
_BYTE[_SPACE] = 0


def _cut(blob: bytes, limit: int) -> list[bytes]:
    """The text in parts of about limit bytes that end at white space (a longer word stays whole)."""
    parts, at = [], 0
    while len(blob) - at > limit:
        end = at + limit
        while end < len(blob) and blob[end] not in b" \t\n\v\f\r":
            end += 1
        parts.append(blob[at:end])
        at = end
    return [*parts, blob[at:]]


def _hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    first, end = edge[::2], edge[1::2]
    base = np.cumsum([0, *(len(b) + 1 for b in blobs)])
    counts = np.diff(np.searchsorted(first, base))
    if not len(first):
        return np.zeros(0, np.uint64), counts
    place = np.arange(len(data))
    place[first[0] :] -= np.repeat(first, np.diff(first, append=len(data)))
    value = _BYTE[data] * _PLACE[place % _ROUND]
    if (end - first).max() > _ROUND:
        value *= (place // _ROUND).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return mix(np.add.reduceat(value, first) + (end - first).astype(np.uint64)), counts


def word_hashes(blobs: list[bytes], limit: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    parts = [(i, p) for i, b in enumerate(blobs) for p in _cut(b.lower(), limit)]
    out, counts, group, size = [], np.zeros(len(blobs), np.int64), [], 0
    for k, (i, p) in enumerate(parts):
        group.append((i, p))
        size += len(p)
        if size >= limit or k == len(parts) - 1:
            h, c = _hashes([p for _, p in group])
            out.append(h)
            np.add.at(counts, [i for i, _ in group], c)
            group, size = [], 0
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def shingle_sets(blobs: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their number by text.

    A text of fewer words than width has its whole sequence as one shingle; a text without words has none.
    """
    words, counts = word_hashes(blobs)
    doc = np.repeat(np.arange(len(blobs)), counts)
    n = max(0, len(words) - width + 1)
    value = np.zeros(n, np.uint64)
    for k in range(width):
        value += words[k : k + n] * _SLOT[k]
    whole = doc[:n] == doc[len(words) - n :] if n else np.zeros(0, bool)
    value, owner = mix(value[whole]), doc[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        at = np.cumsum(counts) - counts
        extra = np.array([sum((int(words[at[d] + k]) * int(_SLOT[k]) for k in range(counts[d])), int(counts[d]) << 56) & (1 << 64) - 1 for d in short], np.uint64)
        value, owner = np.concatenate([value, mix(extra)]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(blobs))
