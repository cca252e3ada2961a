"""Words and shingles of whole texts, as arrays of hashes, many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .units import ranges


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per run of characters other than space and \\t to \\r, A-Z lower-cased, and where each text's begin, with the end."""
    lower = pc.ascii_lower(pc.fill_null(pa.array(texts, pa.large_string()), ""))
    split = pc.ascii_split_whitespace(lower)
    flat = split.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    codes, ends = flat.indices.to_numpy(), split.offsets.to_numpy()
    if "" in names:  # beside white space at either end of a text
        word = codes != names.index("")
        codes, ends = codes[word], np.r_[0, np.cumsum(word)][ends]
    return hashes[codes], ends


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result hangs on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_sets(texts: list[str | None], width: int, level=None) -> tuple[np.ndarray, ...]:
    """For each text the sorted distinct hashes of runs of ``width`` words, one text after the other, and where they begin, with the end.

    Shorter texts are one run; texts without words have none. With ``level``, a function from hashes of words to small numbers, also
    the least of the levels of the words of each run.
    """
    words, bounds = word_hashes(texts)
    begins, counts = bounds[:-1], np.diff(bounds)
    number = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at, last = ranges(begins, number), np.repeat(bounds[1:] - 1, number)
    out = np.repeat(np.minimum(counts, width), number).astype(np.uint64)
    if level is not None:
        each = level(words)
        least = each[at]
    for i in range(width):
        here = at + i <= last
        step = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(at + i, last)])
        out = step if i == 0 else np.where(here, step, out)
        if level is not None and i:
            least = np.minimum(least, each[np.minimum(at + i, last)])
    ends = np.r_[0, np.cumsum(number)]
    if level is None:
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            out[a:b].sort()
    else:
        order = np.concatenate([a + np.argsort(out[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())] + [np.empty(0, np.int64)])
        out, least = out[order], least[order]
    owner = np.repeat(np.arange(len(texts)), number)
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    sets = out[fresh], np.r_[0, np.cumsum(fresh)][ends]
    return sets if level is None else (*sets, least[fresh])


def shingles(text: str | None, width: int) -> np.ndarray:
    """:func:`shingle_sets` of one text."""
    return shingle_sets([text], width)[0]
