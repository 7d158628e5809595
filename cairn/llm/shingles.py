"""Word shingles of whole texts as 64-bit hashes, computed in Arrow and numpy.

Words are runs of anything but ASCII white space, A-Z lower-cased.  A text's set
holds its distinct runs of ``width`` words; a shorter text has its whole word
sequence as its one shingle; a text without words has the empty set.  Texts are
taken some megabytes at a time and each different word among them is hashed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SHINGLE_WORDS = 5
#: Bytes of text taken at a time (a longer text is taken by itself).
SLICE_BYTES = 4 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> np.uint64(32))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """A string array in slices of about ``most`` bytes, nulls as empty."""
    texts = texts.fill_null("")
    size = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most)))
        yield texts[start:end]
        start = end


def coded_words(split: pa.ListArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different words of lists of words, each word's place among them, and the lists' offsets.

    Empty words, which splitting leaves at a text's ends, are left out.
    """
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    codes, offsets = coded.indices.to_numpy(), split.offsets.to_numpy()
    offsets = offsets - offsets[0]
    empty = words.index(b"") if b"" in words else -1
    if empty >= 0:
        there = codes != empty
        offsets = np.r_[0, np.cumsum(there)][offsets]
        codes = codes[there]
    return words, codes, offsets


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text of an array, one 64-bit hash per word, in order."""
    for part in slices(texts):
        words, codes, offsets = coded_words(pc.ascii_split_whitespace(pc.ascii_lower(part)))
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[codes]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            yield h[a:b]


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` items; all items as one run if fewer."""
    n = len(h)
    if n == 0:
        return h
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * _MULT + h[k : n - width + 1 + k])
    return out


def shingle_sets(texts: pa.Array, width: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingle hashes (null and blank texts: none)."""
    for h in word_hashes(texts):
        yield np.unique(windows(h, width))


def shingle_set(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), width))
