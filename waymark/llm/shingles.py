"""Sets of word shingles as 64-bit hashes, made in numpy for many texts at once."""

from __future__ import annotations

import numpy as np

from .batches import ODD, mix64, segment_index, within

WORDS = 5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every lower-cased word, words per text); words are runs without ASCII white space."""
    octets = [t.lower().encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(octets), np.uint8)
    owner_ends = np.cumsum(np.fromiter(map(len, octets), np.int64, len(octets)))
    solid = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    size = ends - starts
    power = np.multiply.accumulate(np.full(int(size.max()), ODD), dtype=np.uint64)
    letters = data[solid].astype(np.uint64) + np.uint64(1)
    h = np.add.reduceat(letters * power[within(size)], np.cumsum(size) - size)
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, owner_ends)]))
    return mix64(h ^ (size.astype(np.uint64) << np.uint64(48))), counts


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count, text) of every distinct shingle, by text and hash.

    A text of fewer words than a shingle has one shingle of all its words; a text
    without words has none.
    """
    h, n = word_hashes(texts)
    first = np.cumsum(n) - n
    full = np.maximum(n - words + 1, 0)
    at = np.repeat(first, full) + within(full)
    value = np.full(len(at), np.uint64(words), dtype=np.uint64)
    for k in range(words):
        value = mix64(value * ODD + h[at + k])
    owner = segment_index(full)
    for k in range(1, words):
        short = np.flatnonzero(n == k)
        if len(short):
            part = np.full(len(short), np.uint64(k), dtype=np.uint64)
            for j in range(k):
                part = mix64(part * ODD + h[first[short] + j])
            value, owner = np.concatenate([value, part]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    where = np.flatnonzero(new)
    return value[where], np.diff(np.concatenate([where, [len(value)]])), owner[where]
