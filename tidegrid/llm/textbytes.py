"""Words, shingles and substring names of many texts at once, on the bytes of an Arrow column.

Texts of a slice lie behind each other in one buffer; ``offsets`` holds the places between
them. All hashes are 64-bit, the same in every process.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, U64)
_inverse = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def join_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Name of a string from the names of its two parts."""
    x = left * _BASE
    x += right
    x ^= x >> U64(32)
    x *= _STEP
    x ^= x >> U64(29)
    return x


BYTE = mix(np.arange(1, 257, dtype=U64) * _BASE)
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 20)
        back = U64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("_powers", _BASE), ("_inverse", back)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _powers, _inverse


def word_spans(buffer: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes that are not ``between`` words: white space, if not said otherwise."""
    if not len(buffer):
        return (np.zeros(0, np.int64),) * 3
    word = ~between[buffer]
    edge = np.zeros(len(buffer) + 1, bool)
    edge[offsets] = True
    cut = edge[1:-1]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | cut
    last[:-1] &= ~word[1:] | cut
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A hash of each span; ``table`` gives the value of a byte, so LOWER makes A-Z and a-z equal."""
    powers, inverse = _power_tables(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, U64)
    np.cumsum(table[buffer] * powers[: len(buffer)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(U64) * _STEP)


def shingle_sets(buffer: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each distinct ``words``-word shingle (A-Z folded), ordered by both.

    A text with fewer words has its whole word sequence as its one shingle; without words, none.
    """
    starts, ends, text = word_spans(buffer, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    hashes = span_hashes(buffer, starts, ends, LOWER)
    n = max(0, len(hashes) - words + 1)
    name = hashes[:n].copy()
    for j in range(1, words):
        name = join_names(name, hashes[j: n + j])
    whole = text[:n] == text[words - 1:]
    owners, names = [text[:n][whole]], [name[whole]]
    count = np.bincount(text, minlength=len(offsets) - 1)
    begin = np.cumsum(count) - count
    for k in range(1, words):
        short = np.flatnonzero(count == k)
        name = hashes[begin[short]] + U64(k)
        for j in range(1, k):
            name = join_names(name, hashes[begin[short] + j])
        owners.append(short)
        names.append(name)
    owner, name = np.concatenate(owners), mix(np.concatenate(names))
    order = np.lexsort((name, owner))
    owner, name = owner[order], name[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (name[1:] != name[:-1])
    return owner[new], name[new]


def sums_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum modulo 2**64 of the values of each owner; ``owner`` is ordered."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=sums[1:])
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return sums[bounds[1:]] - sums[bounds[:-1]]
