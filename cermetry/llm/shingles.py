"""Word shingles of whole texts as 64-bit hashes, computed over a batch's bytes at once.

Words are runs of bytes other than blank and 0x09-0x0D; A-Z count as a-z.  A
word's hash is a polynomial over its (randomised) bytes modulo 2^64, a
shingle's a mix of its words' hashes in order.  A text with fewer words than a
shingle has its whole word sequence as its one shingle; a null text or one
without words has none.
"""

import numpy as np
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: fixed random values that stand for the 256 bytes
BYTES = _RNG.integers(1, 2**63, size=256, dtype=np.uint64)
BYTES[65:91] = BYTES[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_POWERS = {}


def powers(n):
    """BASE^i and BASE^-i for i < n, grown on demand."""
    if _POWERS.get("n", 0) < n:
        n = 1 << (n - 1).bit_length()
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


def mix(x):
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts):
    """Hashes of all words of a string array (nulls count as empty) and their number per text."""
    texts = pc.fill_null(texts, "")
    begin = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset).astype(np.int64)
    if begin[-1] == begin[0]:
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[begin[0]:begin[-1]]
    begin = begin - begin[0]
    inside = ~(((data >= 9) & (data <= 13)) | (data == 32))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[begin] = True
    start = inside & (edge[:-1] | ~np.append(False, inside[:-1]))
    end = inside & (edge[1:] | ~np.append(inside[1:], False))
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(BYTES[data] * up[:len(data)], dtype=np.uint64)))
    words = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return words, np.diff(np.searchsorted(start, begin))


def shingle_sets(texts, n):
    """One sorted array of distinct shingle hashes per text."""
    words, count = word_hashes(texts)
    total = np.zeros(len(words), dtype=np.uint64)
    for k in range(n):
        total[:max(len(words) - k, 0)] += mix(words[k:] + np.uint64(k + 1)) if k == 0 else mix(total[:max(len(words) - k, 0)] ^ words[k:])
    sets, at = [], 0
    for c in count.tolist():
        if c >= n:
            sets.append(np.unique(total[at:at + c - n + 1]))
        elif c:
            h = np.uint64(c)
            for w in words[at:at + c]:
                h = mix(np.array([h ^ w], dtype=np.uint64))[0]
            sets.append(np.array([h], dtype=np.uint64))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
        at += c
    return sets
