"""Variable-capacity best-fit packing of documents into training sequences.

Texts are counted in tokens, cut into pieces of at most the largest permitted length, and the
pieces of a group are packed longest first. A piece goes into the open bin that it fills best.
If none has room, a bin opens whose length has the least cost per token that it can expect to
hold: the piece itself plus what shorter, still unpacked pieces can add. In the end each bin
shrinks to the least permitted length that holds its contents.

Counting is one map, and its result (id, digest, tokens) is written. Rows are then dealt by a
hash of id and text to as many groups as the corpus has ``GROUP_TOKENS`` tokens, so bins depend
neither on the layout of the files nor on how many there are, and each group's share of part-filled
bins is small. A task holds ids and lengths of one group; a bin is named after its group and a
counter. Rows that repeat id and text share a group; beyond ``HELD`` rows, which only such rows can
fill, a group is packed in several runs.

NULL and empty texts have no tokens: one row with piece 0, length 0 and no bin. Repeated rows
and NULL ids are packed like all others. An empty table gives no rows. A NULL in any other
column plays no part.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.tokens import n_tokens
from lexivane.session import scratch_path

LENGTHS = (512, 1024, 2048, 4096)
# A sequence of n tokens costs n + OVERHEAD + n * n / ATTENTION: its padding is paid for, few
# tokens make its fixed share dear, many its attention.
OVERHEAD = 64
ATTENTION = 65536
GROUP_TOKENS = 64_000_000  # of the rows packed together, on average
HELD = 4_000_000  # rows that a task holds


def cut_pieces(tokens: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece number, length) of every piece; a row without tokens has one of length 0."""
    n = np.maximum(1, -(-tokens // largest))
    row = np.repeat(np.arange(len(tokens)), n)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, number, np.minimum(largest, tokens[row] - number * largest)


def pack(lengths: np.ndarray, permitted: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, final length of the bin) of each piece; pieces of length 0 get bin -1."""
    sizes = sorted(permitted)
    costs = {c: c + overhead + c * c / attention for c in sizes}
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    # tokens in pieces up to each length that are not packed yet
    supply = np.bincount(lengths[order], minlength=sizes[-1] + 1) * np.arange(sizes[-1] + 1)
    below = np.cumsum(supply)
    taken = 0  # tokens of the longest pieces, packed so far; all of them are >= the current length
    bin_of, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # open bins by free tokens
    free = 0  # bit r is set if some bin has exactly r free tokens
    capacity: list[int] = []
    total = int(below[-1]) if len(below) else 0
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fits = free >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                free ^= 1 << left
        else:
            b, best = len(used), None
            for size in sizes[bisect.bisect_left(sizes, length) :]:
                more = min(int(below[min(size - length, length)]), total - taken - length)
                price = costs[size] / (length + max(0, min(size - length, more)))
                if best is None or price < best[0]:
                    best = (price, size)
            capacity.append(best[1])
            used.append(0)
            left = best[1]
        bin_of[i], offset[i] = b, used[b]
        used[b] += length
        taken += length
        if left > length:
            left -= length
            room[left].append(b)
            free |= 1 << left
    final = np.array([sizes[bisect.bisect_left(sizes, u)] for u in used] or [0], np.int64)
    return bin_of, offset, np.where(bin_of >= 0, final[bin_of], 0)


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    permitted: Sequence[int] = LENGTHS,
    overhead: int = OVERHEAD,
    attention: int = ATTENTION,
    group_tokens: int = GROUP_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, piece number, first token of the piece in its text, length, bin,
    offset in the bin, the bin's final length."""
    lengths = tuple(sorted(set(permitted)))
    if not lengths or lengths[0] < 1:
        raise ValueError("permitted lengths must be positive")
    text = F.col(text_col).cast("string")
    counted = scratch_path(df.sparkSession, "counted")
    df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), n_tokens(text, tokenizer).alias("n")).write.parquet(counted)
    rows = df.sparkSession.read.parquet(counted)
    groups = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // group_tokens))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "h"), F.lit(groups)))
    ordered = dealt.repartition("g").sortWithinPartitions("g", "doc_id", "h").select("g", "doc_id", "n")
    out = T.StructType(
        [rows.schema["doc_id"]]
        + [T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("first_token", "n_tokens", "bin_id", "bin_offset", "bin_length")]
    )

    def packed(ids: list[pa.Array], counts: list[np.ndarray], group: int, bins: int) -> tuple[pa.RecordBatch, int]:
        row, number, size = cut_pieces(np.concatenate(counts), lengths[-1])
        bin_of, offset, final = pack(size, lengths, overhead, attention)
        none = bin_of < 0
        columns = [
            pa.concat_arrays(ids).take(pa.array(row)),
            pa.array(number, pa.int32()),
            pa.array(number * lengths[-1], pa.int64()),
            pa.array(size, pa.int64()),
            pa.array(bin_of + bins + (group << 32), pa.int64(), mask=none),
            pa.array(offset, pa.int64(), mask=none),
            pa.array(final, pa.int64(), mask=none),
        ]
        return pa.RecordBatch.from_arrays(columns, names=out.names), bins + int(bin_of.max(initial=-1)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins, held = -1, 0, 0
        ids: list[pa.Array] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])) if len(numbers) else []
            for lo, hi in zip(edges, np.append(edges, len(numbers))[1:].tolist()):
                if numbers[lo] != group or held >= HELD:
                    if held:
                        result, bins = packed(ids, counts, group, bins)
                        yield result
                    bins = bins if numbers[lo] == group else 0
                    group, held, ids, counts = int(numbers[lo]), 0, [], []
                ids.append(batch.column(1).slice(lo, hi - lo))
                counts.append(batch.column(2).to_numpy(zero_copy_only=False)[lo:hi])
                held += hi - lo
        if held:
            yield packed(ids, counts, group, bins)[0]

    return ordered.mapInArrow(run, out)


def summarise(pieces: DataFrame) -> DataFrame:
    """Per final length: bins, tokens in them, and the share of the length that is filled."""
    bins = pieces.filter("bin_id is not null").groupBy("bin_id", "bin_length").agg(F.sum("n_tokens").alias("n"))
    return bins.groupBy("bin_length").agg(
        F.count("*").alias("n_bins"), F.sum("n").alias("n_tokens"), (F.sum("n") / (F.count("*") * F.col("bin_length"))).alias("fill")
    )
