"""Word hashes and word shingles of whole texts, as array operations over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

WORDS = 5
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_WORD = _RNG.integers(1, 1 << 63, WORDS + 3, dtype=np.uint64) | _U(1)
#: Places that share one table of powers: ranges are hashed in chunks, which keeps a worker's tables small.
_CHUNK = 1 << 15
_ODD = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(2 * _CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _prefix(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=out[1:])
    return out


_POWER, _INVERSE = _powers(_ODD), _powers(pow(_ODD, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


#: Folding: ASCII punctuation and control characters part words.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def word_hashes(texts: list[str], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (maximal runs without ASCII white space), and each text's number of words.

    ``fold`` lowers case and lets ASCII punctuation part words.
    """
    if fold:
        data = [t.lower().encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts]
    else:
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
    buffer = np.frombuffer(b" ".join([b"", *data, b""]), np.uint8)
    inside = ~_SPACE[buffer]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    bounds = np.cumsum([1, *[len(d) + 1 for d in data]])
    counts = np.diff(np.searchsorted(starts, bounds))
    return range_hashes(_BYTE[buffer], starts, ends), counts


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``values[start:end]`` for ranges in order of start and of end, of any length; equal for equal contents."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + _CHUNK)))
        high = ends[stop - 1]
        if high - low > 2 * _CHUNK:  # one immense range
            out[at] = _long_range(values[low:high])
        else:
            prefix = _prefix(values[low:high] * _POWER[: high - low])
            a, b = starts[at:stop] - low, ends[at:stop] - low
            out[at:stop] = mix((prefix[b] - prefix[a]) * _INVERSE[a] + (b - a).astype(np.uint64))
        at = stop
    return out


def _long_range(values: np.ndarray) -> np.uint64:
    total = _U(len(values))
    with np.errstate(over="ignore"):
        for k in range(0, len(values), _CHUNK):
            part = values[k : k + _CHUNK]
            total = total * _U(_ODD) + np.sum(part * _POWER[: len(part)], dtype=np.uint64)
    return mix(np.array([total]))[0]


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles by text, and each text's number of them.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    total = int(n.sum())
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    at = np.arange(total) - np.repeat(begin - first, n)
    owner = np.repeat(np.arange(len(counts)), n)
    stop = first[owner] + counts[owner]
    out = np.zeros(total, np.uint64)
    for k in range(size):
        there = at + k < stop
        out[there] += mix(words[at[there] + k] * _WORD[k])
    return mix(out), n


def digests(words: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """16 bytes for each text: equal for equal sequences of words."""
    order = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    sums = []
    for seed in (_WORD[-1], _WORD[-2]):
        place = mix((order + 1).astype(np.uint64) * seed)
        sums.append(segment_sum(mix((words + place) * (seed + _U(2))), counts) + counts.astype(np.uint64) * seed)
    both = np.stack(sums, 1)
    return [row.tobytes() for row in both]


def segment_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    prefix = _prefix(values)
    ends = np.cumsum(counts)
    return prefix[ends] - prefix[ends - counts]


class Lookup:
    """Finds values of a sorted array: a bit table first, then a search."""

    BITS = 1 << 20

    def __init__(self, values: np.ndarray):
        self.values = values
        self.table = np.zeros(self.BITS, bool)
        self.table[(values & np.uint64(self.BITS - 1)).astype(np.intp)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``grams`` that are known, and which value each is."""
        if not len(self.values):
            return np.zeros(0, np.intp), np.zeros(0, np.intp)
        maybe = np.flatnonzero(self.table[(grams & np.uint64(self.BITS - 1)).astype(np.intp)])
        at = np.minimum(np.searchsorted(self.values, grams[maybe]), len(self.values) - 1)
        same = self.values[at] == grams[maybe]
        return maybe[same], at[same]
