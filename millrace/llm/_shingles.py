"""Word shingles as 64-bit numbers, and their bucket tokens, in numpy over whole Arrow batches.

Words are runs of anything but the ASCII white space of the pattern ``[^\\x20\\x09-\\x0D]+``;
A-Z is lower-cased. A shingle is ``width`` words in a row; a text with fewer words has one
shingle, the whole sequence; a text without words has none.

A word's number folds its bytes, eight at a time, through a mixing function that is no sum, so
repetition and symmetry in texts can't cancel out; long words go by blake2b. A shingle's number
folds those of its words, in order, alike. For texts that weren't made against this very
function, two different shingles share a number with probability of about 2**-64.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, *range(9, 14)]] = True
_SEED = 0xD6E8FEB86659FD93
#: Bytes hashed at a time; a longer text is a block of its own.
BLOCK = 1 << 20
#: Words of more bytes go by blake2b.
LONG_WORD = 64
#: Masks that keep the first n of eight bytes.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: one-to-one on 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as a little-endian number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def spans_of_eight(words: np.ndarray, begin: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
    """Bytes ``at`` to ``at + 8`` of each span, zeros from its end on; ``words`` is what :func:`eights` gives."""
    left = np.clip(size - at, 0, 8)
    out = np.zeros(len(begin), dtype=_U)
    some = left > 0
    out[some] = words[begin[some] + at] & _FIRST[left[some]]
    return out


def span_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each span of ``data``."""
    words = eights(data)
    out = mix(size.astype(_U) * _U(_SEED))
    live = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(live):
        out[live] = mix(out[live] ^ spans_of_eight(words, begin[live], size[live], at)) + _U(_SEED)
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        found = hashlib.blake2b(data[begin[i] : begin[i] + size[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(found, "little")
    return mix(out)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts that stand one after the other in ``data``, and words by text.

    ``ends``: where each text ends. The result is the hashes in order and the number of words
    of each text.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~_GAP[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = np.concatenate(([0], ends[:-1]))
    first = first[first < n]
    starts[first] = inside[first]  # a word never reaches from one text into the next
    begin = np.flatnonzero(starts)
    if not len(begin):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    stops = np.flatnonzero(np.concatenate((inside[:-1] & (~inside[1:] | starts[1:]), inside[-1:]))) + 1
    hashes = span_hashes(_LOWER[data], begin, stops - begin)
    upto = np.searchsorted(begin, ends, side="left")
    return hashes, np.diff(np.concatenate(([0], upto)))


def _folded(columns: list[np.ndarray]) -> np.ndarray:
    """One number for the numbers that stand side by side in ``columns``, in that order."""
    out = np.full(len(columns[0]), len(columns), dtype=_U)
    for c in columns:
        out = mix(out ^ c) + _U(_SEED)
    return mix(out)


def shingle_sets(values, width: int):
    """The sorted distinct shingle numbers of each text of an Arrow string array; null: none."""
    import pyarrow as pa

    if values.type != pa.large_string():
        values = values.cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(values.buffers()[2], dtype=np.uint8) if values.buffers()[2] is not None else np.empty(0, np.uint8)
    i, n = 0, len(values)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        j = min(j, n)
        ends = offsets[i + 1 : j + 1] - offsets[i]
        hashes, counts = word_hashes(data[offsets[i] : offsets[j]], ends)
        long = max(len(hashes) - width + 1, 0)
        rolled = _folded([hashes[k : k + long] for k in range(width)])
        at = 0
        for c in counts.tolist():
            if c >= width:
                yield np.unique(rolled[at : at + c - width + 1])
            elif c:
                yield _folded([hashes[at + k : at + k + 1] for k in range(c)])
            else:
                yield np.empty(0, np.uint64)
            at += c
        i = j
    return


class Buckets:
    """Bucket tokens: a set cut into buckets, each bucket's content one number.

    For a pair of sets with sizes n >= s and Jaccard similarity of at least num/den, at most
    (n + s)(den - num)/(den + num) elements stand in one set alone, so at most as many
    buckets differ. A set that has more non-empty buckets than that shares a whole bucket
    with any partner; in any fixed order of the tokens, the first common one stands among
    the first (that number + 1) of either. Sets that have fewer get a wild token besides, on
    which they all meet. So sets that share no probed token are proven dissimilar.

    The order puts tokens of large buckets first: they are the most specific, so passages
    that many documents share make few meetings. The number of buckets is the same for both
    sets of a pair since it goes by the size class of the larger one; a set near the border
    of a class has tokens for both.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        share = 2 * (den - num) / (den + num)
        fill = 6.0
        while fill > 1 and (1 - np.exp(-fill)) / fill < 1.5 * share:
            fill -= 0.1
        self.fill, self.base = fill, 8

    def level(self, size: int) -> int:
        return max(0, int(size - 1).bit_length() - 3)

    def probes(self, h: np.ndarray) -> np.ndarray:
        n = len(h)
        if not n:
            return np.empty(0, np.uint64)
        num, den = self.num, self.den
        largest = n * den // num
        out = []
        for level in range(self.level(n), self.level(largest) + 1):
            top = self.base << level
            differ = (n + min(largest, top)) * (den - num) // (den + num)
            if not differ:
                continue  # only equal sets, which are one class already
            m = max(4, int(np.ceil(top / self.fill)))
            bucket = ((h >> _U(32)) * _U(m)) >> _U(32)  # h is sorted, so a bucket is a run
            begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            sizes = np.diff(np.concatenate((begin, [n])))
            tokens = mix(np.add.reduceat(mix(h), begin) + bucket[begin] * _U(0xA0761D6478BD642F) + _U(level))
            order = (_U(255) - np.minimum(sizes, 255).astype(np.uint64) << _U(56)) | (tokens >> _U(8))
            if len(tokens) > differ + 1:
                tokens = tokens[np.argpartition(order, differ)[: differ + 1]]
            elif len(tokens) <= differ:
                tokens = np.concatenate((tokens, mix(np.array([level + 1], np.uint64))))
            out.append(tokens)
        return np.concatenate(out) if out else np.empty(0, np.uint64)
