"""Words of many texts at once by Unicode code points."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from tidegrid.llm.textbytes import U64, join_names, mix


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: is it a letter, is it upper case, its lower case (itself where that is not one character)."""
    characters = [chr(c) for c in range(0x110000)]
    letter = np.fromiter((c.isalpha() for c in characters), bool, 0x110000)
    upper = np.fromiter((c.isupper() for c in characters), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter):
        small = characters[c].lower()
        if len(small) == 1:
            lower[c] = ord(small)
    return letter, upper, lower


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts behind each other, and the places between them; a null is an empty text."""
    held = [t or "" for t in texts]
    lengths = np.fromiter(map(len, held), np.int64, len(held))
    points = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum(lengths)))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each run of marked places; a run never crosses the end of a text."""
    mark = np.zeros(len(inside) + 2, bool)
    mark[1:-1] = inside
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~mark[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside & (~mark[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_names(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's code points."""
    length = ends - starts
    name = np.zeros(len(starts), U64)
    for k in range(min(41, int(length.max(initial=0)))):
        live = np.flatnonzero(length > k) if k else np.arange(len(starts))
        name[live] = join_names(name[live], points[starts[live] + k].astype(U64) + U64(1))
    for i in np.flatnonzero(length > 41):  # one by one, so that a very long word does not hold up all
        rest = points[starts[i] + 41: ends[i]].astype(U64)
        name[i] ^= np.bitwise_xor.reduce(mix(rest * U64(0x9E3779B97F4A7C15) + np.arange(1, len(rest) + 1, dtype=U64)))
    return mix(name + length.astype(U64))
