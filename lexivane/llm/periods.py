"""Periodic runs of words, found by block convolution.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
identical) and a length of at least ``max(24, 3 q)`` that no neighbouring word extends.

All words of a batch form one sequence of integer ids with a separator between texts.

1. Scales: for a block length ``B`` (8, 16, 32, ...) periods from ``B`` to ``2 B - 1`` are looked
   for (at the least scale also those below). A run is so long that its part with a partner one
   period later holds a whole block of the grid of that scale.
2. Convolution: a block's sum of squared differences to the window behind it is taken at all
   distances at once by a number theoretic transform modulo a prime. Equal words give exactly 0,
   so no occurrence is missed; a multiple of the prime may pass, and falls to step 3. A block
   with a word that does not recur within ``2 B`` words can have no occurrence and is left out.
3. Extension: each (block, distance) is extended to both sides by bisection over polynomial
   hashes, all of them at once, and each run found is compared word by word. Of several periods
   of one stretch the least stays.

Words are told apart by 64-bit hashes. NULL and empty texts have no words and no runs; rows that
repeat are answered row by row; a NULL id counts as one whose text is not altered. An empty table
gives no rows; other columns play no part.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.ragged import Block, blocks

MIN_LENGTH = 24
MIN_EXPONENT = 3
LEAST_BLOCK = 8  # (MIN_LENGTH + 1) // 3: a run of any smaller period still holds such a block
PRIME, ROOT = 2013265921, 31  # 15 * 2**27 + 1 and a generator: transforms of up to 2**27 points
NTT_POINTS = 1 << 19  # points transformed together
PAIRS = 1 << 18  # (block, distance) pairs extended together


# --- exact convolution ----------------------------------------------------------------


@functools.lru_cache(maxsize=64)
def _roots(half: int, inverse: bool) -> np.ndarray:
    """Powers of the primitive root of order ``2 * half``."""
    root = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    out = np.ones(half, np.uint64)
    n = 1
    while n < half:
        take = min(n, half - n)
        out[n : n + take] = out[:take] * np.uint64(pow(root, n, PRIME)) % np.uint64(PRIME)
        n += take
    return out


def ntt(rows: np.ndarray) -> np.ndarray:
    """Transform of each row (a power of two long), in bit-reversed order."""
    p = np.uint64(PRIME)
    x, size = rows, rows.shape[1]
    half = size // 2
    while half:
        y = x.reshape(len(rows), -1, 2, half)
        a, b = y[:, :, 0], y[:, :, 1]
        out = np.empty_like(y)
        out[:, :, 0] = (a + b) % p
        out[:, :, 1] = (a + p - b) % p * _roots(half, False) % p
        x, half = out, half // 2
    return x.reshape(rows.shape)


def inverse_ntt(rows: np.ndarray) -> np.ndarray:
    """The inverse, from bit-reversed order."""
    p = np.uint64(PRIME)
    x, size, half = rows, rows.shape[1], 1
    while half < size:
        y = x.reshape(len(rows), -1, 2, half)
        a, b = y[:, :, 0], y[:, :, 1] * _roots(half, True) % p
        out = np.empty_like(y)
        out[:, :, 0] = (a + b) % p
        out[:, :, 1] = (a + p - b) % p
        x, half = out, half * 2
    return x.reshape(rows.shape) * np.uint64(pow(size, -1, PRIME)) % p


def zero_mismatches(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For rows of ``B`` and of ``2 B`` values below the prime: whether the short row meets the
    long one without mismatch at distances 0 to ``B``, by the sum of squared differences."""
    p = np.uint64(PRIME)
    n, size = short.shape
    turned = np.zeros((n, 2 * size), np.uint64)
    turned[:, 0] = short[:, 0]
    turned[:, size + 1 :] = short[:, :0:-1]
    cross = inverse_ntt(ntt(turned) * ntt(long) % p)[:, : size + 1]
    own = (short * short % p).sum(axis=1) % p
    sums = np.zeros((n, 2 * size + 1), np.uint64)
    np.cumsum(long * long % p, axis=1, out=sums[:, 1:])
    theirs = (sums[:, size:] - sums[:, : size + 1]) % p
    return (own[:, None] + theirs + np.uint64(2) * (p - cross)) % p == 0


# --- runs -----------------------------------------------------------------------------


class _Reach:
    """How far two places of a sequence agree, forwards and backwards, by hashed prefixes."""

    _STEP = 0x9E3779B97F4A7C15

    def __init__(self, ids: np.ndarray):
        steps = np.full(len(ids) + 1, self._STEP, np.uint64)
        steps[0] = 1
        self.powers = np.cumprod(steps, dtype=np.uint64)
        values = np.random.default_rng(11).integers(1, 1 << 63, int(ids.max()) + 1, dtype=np.uint64)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(values[ids] * self.powers[:-1], out=self.sums[1:])

    def same(self, at: np.ndarray, to: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether the stretch from ``at`` to ``to`` equals the one ``shift`` later."""
        here = (self.sums[to] - self.sums[at]) * self.powers[shift]
        return here == self.sums[to + shift] - self.sums[at + shift]


def _extend(reach: _Reach, n: int, at: np.ndarray, size: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (exclusive) of the stretch around each block that keeps period ``q``."""
    low, high = at + size, n - q  # the block itself agrees
    while (low < high).any():
        mid = (low + high + 1) >> 1
        good = reach.same(at, mid, q)
        low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
    end = low + q
    low, high = np.zeros_like(at), at.copy()
    while (low < high).any():
        mid = (low + high) >> 1
        good = reach.same(mid, at, q)
        low, high = np.where(good, low, mid + 1), np.where(good, mid, high)
    return low, end


def _recurrence(ids: np.ndarray) -> np.ndarray:
    """Distance from each place to the next one with the same id (the length if there is none)."""
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), len(ids), np.int64)
    again = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    gap[order[again]] = order[again + 1] - order[again]
    return gap


def _extend_plainly(ids: np.ndarray, at: np.ndarray, size: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by comparing ids, for sequences where hashes of different stretches agree."""
    start, end = np.empty_like(at), np.empty_like(at)
    for i, (x, d) in enumerate(zip(at.tolist(), q.tolist())):
        differ = np.flatnonzero(ids[:-d] != ids[d:])
        k = int(np.searchsorted(differ, x))
        start[i] = differ[k - 1] + 1 if k else 0
        end[i] = (differ[k] if k < len(differ) else len(ids) - d) + d
    return start, end


def find_runs(ids: np.ndarray, longest: int, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and least period of each run of a sequence of small non-negative ids, by start
    and period; ``longest``: words of the longest text, since no run crosses a separator."""
    n = len(ids)
    none = np.zeros(0, np.int64)
    if longest < MIN_LENGTH:
        return none, none, none
    gap = _recurrence(ids)
    reach: _Reach | None = None
    found: list[np.ndarray] = []
    size = LEAST_BLOCK
    while size == LEAST_BLOCK or MIN_EXPONENT * size <= longest:
        # grid of this scale; the window of the last blocks is filled up with a value of its own
        whole = n // size
        first = np.arange(whole) * size
        recurs = np.maximum.reduceat(gap[: whole * size], first) < 2 * size if whole else np.zeros(0, bool)
        first = first[recurs]
        from_ = 0 if size == LEAST_BLOCK else size
        per = max(1, NTT_POINTS // (2 * size))
        for i in range(0, len(first), per):
            some = first[i : i + per]
            short = ids[some[:, None] + np.arange(size)].astype(np.uint64)
            # two windows at the least scale: distances 0 to 8 and 8 to 16
            for offset in ((0, size) if size == LEAST_BLOCK else (from_,)):
                place = some[:, None] + offset + np.arange(2 * size)
                window = np.where(place < n, ids[np.minimum(place, n - 1)], PRIME - 1).astype(np.uint64)
                row, shift = np.nonzero(zero_mismatches(short, window))
                q = shift + offset
                good = (q > 0) & (q < 2 * size) & (some[row] + size + q <= n) & ~((offset == size) & (size == LEAST_BLOCK) & (shift == 0))
                row, q = row[good], q[good]
                for j in range(0, len(row), PAIRS):
                    if reach is None:
                        reach = _Reach(ids)
                    at, qs = some[row[j : j + PAIRS]], q[j : j + PAIRS].astype(np.int64)
                    true = reach.same(at, at + size, qs)  # a sum may be a multiple of the prime
                    at, qs = at[true], qs[true]
                    start, end = _extend(reach, n, at, size, qs) if hashed else _extend_plainly(ids, at, size, qs)
                    long_ = end - start >= np.maximum(MIN_LENGTH, MIN_EXPONENT * qs)
                    if long_.any():
                        found.append(np.unique(np.stack([start[long_], end[long_], qs[long_]], 1), axis=0))
        size *= 2
    if not found:
        return none, none, none
    runs = np.unique(np.concatenate(found), axis=0)  # by start, end, period
    least = np.ones(len(runs), bool)
    least[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[least]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    for s, e, q in runs.tolist():
        exact = np.array_equal(ids[s : e - q], ids[s + q : e])
        if not exact or (s and ids[s - 1] == ids[s - 1 + q]) or (e < n and ids[e] == ids[e - q]):
            return find_runs(ids, longest, hashed=False)  # different stretches share a hash
    return runs[:, 0], runs[:, 1], runs[:, 2]


# --- texts ----------------------------------------------------------------------------


def _altered(doc_ids: list, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Place of the word that stands at each place, once the texts that the ids name are made
    periodic from some word on."""
    place = np.arange(int(counts.sum()), dtype=np.int64)
    for i, doc_id in enumerate(doc_ids):
        n = int(counts[i])
        if not n or doc_id is None:
            continue
        h = zlib.crc32(str(doc_id).encode())
        if h % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        place[first[i] + a : first[i] + n] = first[i] + a + np.arange(n - a) % p
    return place


def _joined(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words one after the other, a space behind each, and where each one ends."""
    lengths = e - s + 1
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    from_ = np.arange(total) + np.repeat(s - (ends - lengths), lengths)
    out = buf[np.minimum(from_, len(buf) - 1)]
    out[ends - 1] = 32
    return out.tobytes(), ends


def _describe(block: Block, doc_ids: list, alter: bool) -> list[dict]:
    s, e, first = block.words()
    counts = np.diff(first)
    place = _altered(doc_ids, counts, first) if alter else np.arange(len(s), dtype=np.int64)
    words = len(s)
    # ids in the order of the words, after every text a separator that occurs once
    ids = np.unique(block.hashes(s, e), return_inverse=True)[1][place] if words else np.zeros(0, np.int64)
    texts = len(counts)
    owner = np.repeat(np.arange(texts), counts)
    at = np.arange(words) + owner
    sequence = np.empty(words + texts, np.int64)
    sequence[at] = ids
    sequence[first[1:] + np.arange(texts)] = words + np.arange(texts)
    base = first[:-1] + np.arange(texts)  # place of each text in the sequence
    start, end, period = find_runs(sequence, int(counts.max()) if texts else 0)
    # words behind the first period of a run go
    steps = np.zeros(len(sequence) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, end, -1)
    kept = np.cumsum(steps)[at] == 0
    src = place[kept]
    data, ends = _joined(block.buf, s[src], e[src])
    cut = np.append(0, ends)[np.append(0, np.cumsum(kept))[first]]
    run_text = np.searchsorted(base, start, side="right") - 1
    run_cut = np.searchsorted(run_text, np.arange(texts + 1))
    out = []
    for i in range(texts):
        low, high = int(cut[i]), int(cut[i + 1])
        runs = [
            (int(a - base[i]), int(b - a), int(q))
            for a, b, q in zip(*(x[run_cut[i] : run_cut[i + 1]].tolist() for x in (start, end, period)))
        ]
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
        listed = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
        out.append(
            {
                "doc_id": doc_ids[i],
                "n_runs": len(runs),
                "start": best[0],
                "length": best[1],
                "period": best[2],
                "exponent_milli": 1000 * best[1] // best[2] if runs else None,
                "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
                "collapsed_sha256": hashlib.sha256(data[low : max(low, high - 1)]).hexdigest(),
                "n_words": int(counts[i]),
                "runs": runs,
                "collapsed": data[low : max(low, high - 1)],
            }
        )
    return out


_DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long"


def _mapped(df: DataFrame, id_col: str, text_col: str, alter: bool, extra: str, columns: list[str]) -> DataFrame:
    picked = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, {_DIGEST}{extra}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for block in blocks(batch.column(1)):
                rows = _describe(block, doc_ids[block.first : block.first + len(block)], alter)
                arrays = [pa.array([r["doc_id"] for r in rows], batch.schema.field(0).type)]
                for name in columns:
                    values = [r[name] for r in rows]
                    if name == "runs":
                        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                        arrays.append(pa.array([[dict(zip(("start", "length", "period"), r)) for r in v] for v in values], kind))
                    elif name == "collapsed":
                        arrays.append(pa.array([v.decode() for v in values], pa.string()))
                    else:
                        arrays.append(pa.array(values, pa.string() if name.endswith("sha256") else pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *columns])

    return picked.mapInArrow(work, schema)


_COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]


def detect_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its runs (start, length, period, in words) and the text without repeated periods,
    its words joined by one space; one map, no shuffle."""
    extra = ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return _mapped(df, id_col, text_col, False, extra, [*_COLUMNS, "runs", "collapsed"])


def run_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same as figures and digests, over texts of which those that the id's checksum names are
    first made periodic from some word on."""
    return _mapped(df, id_col, text_col, True, "", _COLUMNS)
