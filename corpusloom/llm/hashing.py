"""Hashes of the words of whole texts, with numpy, for code that runs inside tasks."""

from __future__ import annotations

import numpy as np

SPAN = 1 << 20
#: Longer words are hashed one by one.
LONG = 256
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Ones in the lowest bytes: as many as the index says.
_PART = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each ordered pair: scrambled between the two, so that no sum of parts cancels out."""
    with np.errstate(over="ignore"):
        return mix(mix(a * np.uint64(_ODD) + np.uint64(1)) ^ b)


def runs(hashes: np.ndarray, wide: int) -> np.ndarray:
    """The hash of each run of `wide` neighbours, from runs of half the width, then the rest; shorter input: none."""
    if len(hashes) < wide:
        return hashes[:0]
    have, width, out, done = hashes, 1, None, 0
    n = len(hashes) - wide + 1
    while True:
        if wide & width:
            part = have[done : done + n]
            out = part if out is None else joined(out, part)
            done += width
        width *= 2
        if width > wide:
            return out
        have = joined(have[: -(width // 2)], have[width // 2 :])


class Hasher:
    """64-bit hashes of words, eight bytes after eight, scrambled after each: seeds give independent ones."""

    def __init__(self, seed: int = 1):
        self.seed = seed

    def words(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word of each text, and how many words each text has. data: the texts' UTF-8 bytes, one after
        another from offsets. Done in spans of about SPAN bytes that end at a text's end or at white space."""
        hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
        at, stop = int(offsets[0]), int(offsets[-1])
        while at < stop:
            end = min(stop, at + SPAN)
            if end < stop:
                text = int(offsets[np.searchsorted(offsets, end, side="right") - 1])
                end = text if text > at else self._space(data, end, int(offsets[np.searchsorted(offsets, end, side="right")]))
            found, first = self._span(data[at:end], offsets[np.searchsorted(offsets, at, side="right") : np.searchsorted(offsets, end, side="left")] - at, lower)
            hashes.append(found)
            np.add.at(counts, np.searchsorted(offsets, first + at, side="right") - 1, 1)
            at = end
        return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts

    @staticmethod
    def _space(data: np.ndarray, at: int, stop: int) -> int:
        while at < stop:
            found = np.flatnonzero(_SPACE[data[at : at + 4096]])
            if len(found):
                return min(stop, at + int(found[0]))
            at += 4096
        return stop

    def _span(self, data: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        word = ~_SPACE[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] = word[cuts]
        ends[cuts - 1] = word[cuts - 1]
        starts = np.flatnonzero(begins)
        return self._hashed(_LOWER[data] if lower else data, starts, np.flatnonzero(ends) + 1), starts

    def _hashed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        import xxhash

        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        size = ends - starts
        with np.errstate(over="ignore"):
            # The length comes in first: words that only differ in closing zero bytes stay apart.
            out = mix(size.astype(np.uint64) + np.uint64(_ODD * (2 * self.seed + 1) & _MASK))
            out = mix(out ^ (eight[starts] & _PART[np.minimum(size, 8)]))
        more, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(more):
            rest = size[more] - at
            out[more] = joined(out[more], eight[starts[more] + at] & _PART[np.minimum(rest, 8)])
            more, at = more[rest > 8], at + 8
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), self.seed)
        return out


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow binary or string array (nulls: no bytes)."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays([column.cast(pa.large_binary())])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets
