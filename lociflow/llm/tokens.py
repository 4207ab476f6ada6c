"""Words and word shingles of texts as 64-bit hashes, computed with numpy over a block of texts at a time.

A word is a maximal run of letters, digits and combining marks; case is ignored. Everything else separates words.
Null counts as the empty text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Characters that a block of texts holds, at least one text.
BLOCK_CHARS = 200_000
#: Words in a shingle.
WIDTH = 5
_POSITIONS = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


def by_character(value: Callable[[str], object], kind: type) -> np.ndarray:
    """A value for every code point. No list of all characters is ever held: workers keep what they once took."""
    return np.fromiter((value(chr(i)) for i in range(0x110000)), kind, 0x110000)


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it belongs to a word; a random number that upper and lower case share."""
    inside = by_character(lambda c: c.isalnum() or unicodedata.category(c)[0] == "M", bool)
    lower = by_character(lambda c: ord(x) if len(x := c.lower()) == 1 else ord(c), np.uint64)
    return inside, mix((lower + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_PLACES = randoms(1, _POSITIONS) | np.uint64(1)
_SHINGLE = randoms(2, WIDTH) | np.uint64(1)


@dataclass
class Words:
    """Words of a block of texts; those of text i are at first[i] .. first[i + 1]."""

    hashes: np.ndarray
    starts: np.ndarray  # characters from the start of the word's own text
    ends: np.ndarray
    first: np.ndarray


def words(texts: Sequence[str | None]) -> Words:
    texts = [t or "" for t in texts]
    inside, number = _characters()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    word = inside[points]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(texts) + 1, np.int64))
    size = ends - starts
    heads = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(heads[-1] + size[-1]) - np.repeat(heads, size)
    hashes = mix(np.add.reduceat(number[points[word]] * _PLACES[place % _POSITIONS], heads) + size.astype(np.uint64))
    first = np.searchsorted(starts, begins)
    base = np.repeat(begins[:-1], np.diff(first))
    return Words(hashes, starts - base, ends - base, first)


def blocks(texts: Sequence[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Cut the texts into ranges of about ``limit`` characters, so that memory does not follow the batch."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "") + 1
        if held >= limit:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of every run of ``width`` words; of the whole text if it has fewer words; none for no words."""
    if not len(hashes):
        return hashes
    n = len(hashes) - width + 1
    if n < 1:
        short = hashes * (randoms(2, width)[: len(hashes)] | np.uint64(1))
        return mix(np.array([np.add.reduce(short) + np.uint64(len(hashes))], np.uint64))
    factors = _SHINGLE if width == WIDTH else randoms(2, width) | np.uint64(1)
    out = hashes[:n] * factors[0]
    for k in range(1, width):
        out += hashes[k : k + n] * factors[k]
    return mix(out)


def each(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index, word hashes, starts, ends) of every text."""
    for a, b in blocks(texts):
        block = words(texts[a:b])
        for i in range(b - a):
            x, y = block.first[i], block.first[i + 1]
            yield a + i, block.hashes[x:y], block.starts[x:y], block.ends[x:y]


def each_shingled(texts: Sequence[str | None], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index, shingles, starts and ends of words) of every text; no shingles if it has fewer than ``least`` words (WIDTH or more)."""
    none = np.zeros(0, np.uint64)
    for a, b in blocks(texts):
        block = words(texts[a:b])
        # Shingles that reach from one text into the next are left out below.
        every = shingles(block.hashes) if len(block.hashes) >= least else none
        for i in range(b - a):
            x, y = block.first[i], block.first[i + 1]
            yield a + i, every[x : y - WIDTH + 1] if y - x >= least else none, block.starts[x:y], block.ends[x:y]
