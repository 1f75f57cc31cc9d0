"""Texts of an Arrow batch as flat byte arrays, so that numpy works on many texts at once.

A batch is cut into blocks of about ``BLOCK_BYTES`` at row borders (one long text may be a
larger block of its own): memory follows the block, not the batch. Hashes are 64-bit
polynomial hashes of random byte values with a final mix; two different strings share one
with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))

        def table(step: int) -> np.ndarray:
            steps = np.full(size, step, np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)

        powers, inverse = table(BASE), table(pow(BASE, -1, 1 << 64))
        if n > 4 * BLOCK_BYTES:  # a single huge text: not kept
            return powers, inverse
        _powers, _inverse = powers, inverse
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Some texts, one after the other, each followed by a line feed."""

    def __init__(self, first: int, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.first, self.buf, self.starts, self.ends = first, buf, starts, ends
        self._prefix: dict[bool, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, row: int) -> bytes:
        return self.buf[self.starts[row] : self.ends[row]].tobytes()

    def hashes(self, s: np.ndarray, e: np.ndarray, folded: bool = False) -> np.ndarray:
        """Of the byte strings from ``s`` to ``e``; ``folded``: A-Z count as a-z."""
        powers, inverse = _power_tables(len(self.buf) + 1)
        if folded not in self._prefix:
            values = (_FOLDED if folded else _VALUES)[self.buf]
            values *= powers[: len(values)]
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values, out=sums[1:])
            self._prefix[folded] = sums
        sums = self._prefix[folded]
        return mix((sums[e] - sums[s]) * inverse[s])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each run of bytes other than ASCII white space, and the first
        word of each text (one entry more than texts)."""
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[1:] = ~_WHITE[self.buf]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edges[0::2], edges[1::2]
        return s, e, np.append(np.searchsorted(s, self.starts), len(s))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each line-feed separated line; first line of each text."""
        e = np.flatnonzero(self.buf == 10)
        s = np.empty_like(e)
        if len(e):
            s[0] = 0
            s[1:] = e[:-1] + 1
        return s, e, np.append(np.searchsorted(s, self.starts), len(s))


def blocks(texts: pa.Array | pa.ChunkedArray, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column in blocks; NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
    n = len(texts)
    if not n:
        return
    if texts.type == pa.null():
        texts = texts.cast(pa.string())
    flat = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + n + 1]
    data = flat.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + block_bytes, side="right")) - 1)
        last = min(last, n)
        lengths = np.diff(at[row : last + 1])
        starts = np.zeros(last - row, np.int64)
        np.cumsum(lengths[:-1] + 1, out=starts[1:])
        ends = starts + lengths
        buf = np.full(int(ends[-1]) + 1, 10, np.uint8)
        for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            if e > s:
                buf[s:e] = raw[at[row + i] : at[row + i + 1]]
        yield Block(row, buf, starts, ends)
        row = last


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` items of one text, and the position of its first item."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(owner[: n] == owner[size - 1 :])
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        total = total * np.uint64(0xD1342543DE82EF95) + hashes[at + j]
    return mix(total), at


def shingles(block: Block, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text (ASCII letters folded). A
    text of fewer words has one shingle of all of them, a text without words none."""
    s, e, first = block.words()
    hashes = block.hashes(s, e, folded=True)
    grams, at = windows(hashes, first, size)
    cut = np.searchsorted(at, first)
    counts = np.diff(first)
    out = []
    for i in range(len(block)):
        if counts[i] >= size:
            out.append(np.unique(grams[cut[i] : cut[i + 1]]))
        elif counts[i]:
            few = hashes[first[i] : first[i + 1]]
            out.append(mix(windows(few, np.array([0, len(few)]), len(few))[0] + np.uint64(len(few))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
