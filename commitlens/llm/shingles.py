"""Vectorised word shingles of whole texts (numpy, inside tasks).

Words are runs of bytes other than ASCII white space, A-Z in lower case.  A word's
64-bit hash is a sum over its bytes of a random table entry times a random odd
power by position; shingle hashes chain word hashes through a mixing function.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20     # bytes hashed at once
_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Odd multipliers by position in a word."""
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = mix(np.arange(max(n, 2 * len(_powers)), dtype=np.uint64) * _BASE + np.uint64(1)) | np.uint64(1)
    return _powers


def block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word in a block of bytes."""
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start
    at = np.flatnonzero(inside)
    lengths = end - start
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    pos = np.arange(len(at)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_TABLE[data[at]] * powers(int(lengths.max()))[pos], first)
        return mix(sums + lengths.astype(np.uint64) * _BASE), start


def word_hashes(texts: list[str | None], fold: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and how many each text has; ``fold`` maps bytes first."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    members: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            data = np.frombuffer(b" ".join(group), np.uint8)
            h, start = block_words(data)
            bounds = np.cumsum([len(g) + 1 for g in group])
            np.add.at(counts, np.array(members), np.diff(np.searchsorted(start, bounds), prepend=0))
            hashes.append(h)
            group.clear()
            members.clear()
            size = 0

    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass").lower()
        b = b.translate(fold) if fold else b
        at = 0
        while at < len(b):
            end = at + BLOCK
            while 0 < end < len(b) and not _SPACE[b[end]]:     # a block ends before white space
                nxt = [p for p in (b.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
                end = min(nxt, default=len(b))
            piece = b[at:end]
            group.append(piece)
            members.append(i)
            size += len(piece)
            at = end
            if size >= BLOCK:
                flush()
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text: hashes in rising order text after text, and counts.

    A text with fewer words has one shingle, the whole sequence; without words, none.
    """
    w, n = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(w)) - first[owner]
    with np.errstate(over="ignore"):
        h = np.zeros(len(w), np.uint64)
        for j in range(k):
            nxt = np.zeros(len(w), np.uint64)
            nxt[: max(0, len(w) - j)] = w[j:]
            inside = place + j < n[owner]
            h = np.where(inside, mix(h * _BASE + nxt), h)
    keep = (place + k <= n[owner]) | (place == 0)
    h, owner = h[keep], owner[keep]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(texts))


def set_ids(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit id of each set, never 0."""
    ends = np.cumsum(n)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _BASE), dtype=np.uint64)])
        out = mix(total[ends] - total[ends - n] + n.astype(np.uint64) * _BASE)
    return np.where(out == 0, np.uint64(1), out)
