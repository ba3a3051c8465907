"""Word and shingle hashes of Arrow batches of texts, straight from their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer text is cut between words.
BLOCK = 1 << 20
_ROOT = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Word hashes of texts. A word's hash is its bytes as a polynomial modulo 2**64 in an odd number, which
    differences of prefix sums give for all words at once, with its length mixed in."""

    def __init__(self, *, alnum: bool, lower: bool = True):
        self.apart, self.lower = (_NOT_ALNUM if alnum else _BLANK), lower
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            root, back = np.full(n, _ROOT), np.full(n, np.uint64(pow(int(_ROOT), -1, 1 << 64)))
            root[0] = back[0] = 1
            self.power, self.inverse = np.multiply.accumulate(root), np.multiply.accumulate(back)

    def grams(self, column: pa.Array, k: int) -> Iterator[np.ndarray]:
        """For each text the hashes of its k-grams, in order; of its whole sequence, as one, where it has fewer
        words; null texts have none. Grams of a block are made at once; those across texts are left out."""
        for hashes, cuts, null in self._blocks(column):
            made, none = grams(hashes, k), hashes[:0]
            for i in range(len(cuts) - 1):
                n = int(cuts[i + 1] - cuts[i])
                if null[i] or not n:
                    yield none
                elif n >= k:
                    yield made[cuts[i] : cuts[i + 1] - k + 1]
                else:
                    yield mix(grams(hashes[cuts[i] : cuts[i + 1]], n), 40 + n)

    def _blocks(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Word hashes of some texts, where each text's begin, and which texts are null."""
        column = column.cast(pa.large_string())
        n = len(column)
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        null = np.array(column.is_null())
        first = 0
        while first < n:
            last = first + 1
            while last < n and ends[last + 1] - ends[first] <= BLOCK:
                last += 1
            if ends[last] - ends[first] > BLOCK:
                words = np.concatenate([self._block(x, np.array([0, len(x)]))[0] for x in self._cut(data[ends[first] : ends[last]])])
                yield words, np.array([0, len(words)]), null[first:last]
            else:
                yield *self._block(data, ends[first : last + 1]), null[first:last]
            first = last

    def _cut(self, raw: np.ndarray) -> Iterator[np.ndarray]:
        """Stretches of a long text, cut between words."""
        at = 0
        while at < len(raw):
            stop, step = at + BLOCK, BLOCK
            if stop < len(raw):
                gaps = np.flatnonzero(self.apart[self._low(raw[at:stop])])
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                else:  # a word that is longer than a block
                    while stop < len(raw) and not self.apart[self._low(raw[stop : stop + step])].any():
                        stop += step
                    gaps = np.flatnonzero(self.apart[self._low(raw[stop : stop + step])])
                    stop += int(gaps[0]) + 1 if len(gaps) else step
            yield raw[at:stop]
            at = stop

    def _low(self, raw: np.ndarray) -> np.ndarray:
        return _LOWER[raw] if self.lower else raw

    def _block(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = self._low(data[ends[0] : ends[-1]])
        inside = ~self.apart[raw]
        # A word also ends where its text does.
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = ends[:-1] - ends[0]
        edges = edges[edges < len(raw)]
        begins[edges] = inside[edges]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.array([], np.uint64), np.zeros(len(ends), np.int64)
        stops_at = ~inside
        stop_marks = np.flatnonzero(stops_at)
        limit = np.append(stop_marks, len(raw))[np.searchsorted(stop_marks, starts)]
        limit = np.minimum(limit, np.append(starts[1:], len(raw)))
        self._powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)], out=sums[1:])
        hashes = mix((sums[limit] - sums[starts]) * self.inverse[starts] + (limit - starts).astype(np.uint64), 11)
        return hashes, np.searchsorted(starts, ends - ends[0])


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of word hashes, in order; none if there are fewer words."""
    if len(words) < k:
        return words[:0]
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = mix(out + words[j : len(words) - k + 1 + j], 12 + j)
    return out


def set_hash(s: np.ndarray, seed: int) -> np.uint64:
    """One hash of a sequence, or of a sorted set, of hashes."""
    places = np.arange(1, 2 * len(s), 2, dtype=np.uint64)
    return mix(np.array([(s * places).sum(dtype=np.uint64) + np.uint64(len(s))]), seed)[0]
