"""Sets of word shingles as sorted 64-bit numbers, for many texts at once."""

from __future__ import annotations

import numpy as np

WORDS = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number spread over all bits, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word (run of bytes other than space, tab, line feeds and the like), and the words per text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    change = np.flatnonzero(np.diff(np.concatenate(([True], space))))
    start, end = change[0::2], change[1::2]
    # a hash by prefix sums: sum of byte value times step ** position, moved back to position 0
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers(_STEP, len(data)))))
    hashes = mixed((sums[end] - sums[start]) * powers(_BACK, len(data))[start] + (end - start).astype(np.uint64))
    text_end = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.concatenate(([0], np.searchsorted(start, text_end))))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted numbers; fewer words than WORDS make one shingle, none an empty set."""
    hashes, counts = word_hashes(texts)
    joined = np.zeros(len(hashes), np.uint64)
    for i in range(WORDS):
        joined[: max(0, len(hashes) - i)] += hashes[i:] * _PLACE[i]
    joined = mixed(joined)
    out, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            out.append(np.unique(joined[at : at + n - WORDS + 1]))
        elif n:
            out.append(mixed(np.array([(hashes[at : at + n] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * size of the intersection >= percent * size of the union, on whole sets."""
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)
