"""Word shingles of a text and the similarity of two texts by them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import xxhash


def shingle_texts(text: str | None, width: int) -> Iterator[bytes]:
    """The lower-cased (A-Z) words' shingles of ``width`` words in order; fewer words give one of all words, none give none."""
    words = (text or "").encode().lower().split()
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return (line[s : e - 1] for s, e in zip(starts, ends[width - 1 :] or ends[-1:]))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of :func:`shingle_texts`."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, 42) for x in shingle_texts(text, width)), "<u8")


def alike(a: str | None, b: str | None, width: int, percent: int) -> bool:
    """Whether the two texts' sets of shingles share ``percent`` of their union at least; never where one is empty."""
    x, y = set(shingle_texts(a, width)), set(shingle_texts(b, width))
    both = len(x & y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
