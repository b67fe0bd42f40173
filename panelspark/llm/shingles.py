"""Word shingles of whole documents as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from panelspark.llm.common import chunks, mix, prefix_hash, span_hash, text_bytes, word_spans

_STEP = np.random.Generator(np.random.PCG64(77)).integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column, size: int, lower: bool = True):
    """For each document of an Arrow text column, the sorted distinct hashes of its ``size``-word shingles.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A document with fewer words
    is one shingle of all of them; one without words (or without text) has the empty set.
    """
    data, offsets = text_bytes(column)
    for lo, hi in chunks(offsets):
        part = data[offsets[lo]:offsets[hi]]
        off = offsets[lo:hi + 1] - offsets[lo]
        starts, ends, words = word_spans(part, off)
        if not len(starts):
            for _ in range(lo, hi):
                yield np.zeros(0, np.uint64)
            continue
        h = span_hash(prefix_hash(part, lower), starts, ends)
        n = max(len(h) - size + 1, 0)
        joint = np.zeros(n, np.uint64)
        for j in range(size):
            joint += h[j:j + n] * _STEP[j]
        joint = mix(joint)
        for k in range(hi - lo):
            a, b = words[k], words[k + 1]
            if b - a >= size:
                yield np.unique(joint[a:b - size + 1])
            elif b > a:
                yield mix(np.array([(h[a:b] * _STEP[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
