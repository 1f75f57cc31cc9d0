"""Texts that hold a long passage of another text: more than fifty words in a row, word by word.

Windows of ``WORDS`` words are filed under the least hash of the ``GRAM``-word grams in them, so
equal windows are always filed alike; neighbouring windows under one hash form a region. Where
two texts have a region of the same words they share a passage. Regions that share only the hash
are compared window by window, and only under hashes that a text not yet settled has.

Texts that differ in nothing are copies, and share a passage if they are long enough. NULL and
empty texts and those of fewer words hold none. Words and windows are told apart by 64-bit
hashes, texts by 64-bit hashes as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.ragged import Block, blocks, mix, windows
from lexivane.llm.scratch import drop_scratch
from lexivane.session import cut, scratch_path

WORDS = 51
GRAM = 16


def regions(block: Block, words: int = WORDS, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, hash, digest of the words) of every region of a block;
    windows are numbered from the text's first word."""
    s, e, first = block.words()
    none = np.zeros(0, np.int64)
    if not len(first) or np.diff(first).max() < words:
        return none, none, none, none, none
    hashes = block.hashes(s, e)
    grams, at = windows(hashes, first, gram)
    every = np.zeros(len(s), np.uint64)  # of the gram from each word; those across texts are never asked for
    every[at] = grams
    width, span = words - gram + 1, 1
    least = every
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    owner = np.repeat(np.arange(len(block)), np.diff(first))[: len(least)]
    inside = np.arange(len(least)) + words <= first[owner + 1]
    new = np.append(True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1]))
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(least)) - 1
    low, high = low[inside[low]], high[inside[low]]
    sums = _sums(hashes)
    own = first[owner[low]]
    return owner[low], low - own, high - own, least[low].view(np.int64), _stretch(sums, low, high + words).view(np.int64)


def _sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step = 0x9E3779B97F4A7C15
    n = len(hashes) + 1
    tables = []
    for factor in (step, pow(step, -1, 1 << 64)):
        steps = np.full(n, factor, np.uint64)
        steps[0] = 1
        tables.append(np.cumprod(steps, dtype=np.uint64))
    sums = np.zeros(n, np.uint64)
    np.cumsum(hashes * tables[0][:-1], out=sums[1:])
    return sums, tables[1], tables[0]


def _stretch(sums: tuple[np.ndarray, ...], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of the words from ``low`` to ``high``."""
    return mix((sums[0][high] - sums[0][low]) * sums[1][low])


_REGION = T.StructType(
    [T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("m", T.LongType()), T.StructField("r", T.LongType())]
)


@F.arrow_udf(T.ArrayType(_REGION))
def _regions(texts: pa.Array) -> pa.Array:
    offsets, columns, done = [np.zeros(1, np.int64)], [], 0
    for block in blocks(texts):
        owner, *parts = regions(block)
        offsets.append(done + np.cumsum(np.bincount(owner, minlength=len(block))))
        done += len(owner)
        columns.append(parts)
    each = [np.concatenate([c[i] for c in columns]) if columns else np.zeros(0) for i in range(4)]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    flat = pa.StructArray.from_arrays([pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(each, types)], ["lo", "hi", "m", "r"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()), flat)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _window_hashes(texts: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    """Hashes of the windows of the asked regions."""
    out = []
    for block in blocks(texts):
        s, e, first = block.words()
        sums = _sums(block.hashes(s, e))
        for row in range(len(block)):
            a, b = low[block.first + row].as_py(), high[block.first + row].as_py()
            at = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(a, b)])) + first[row]
            out.append(_stretch(sums, at, at + WORDS).view(np.int64))
    return pa.array(out, pa.list_(pa.int64()))


def _repeated(rows: DataFrame, *by: str) -> DataFrame:
    """The values that two different texts have; a hot one shrinks map-side."""
    seen = rows.groupBy(*by).agg(F.min("k").alias("a"), F.max("k").alias("b"))
    return seen.filter("a <> b").select(*by)


def passage_keys(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(k)``: xxhash64 of each text that shares a passage with another row."""
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("k", F.xxhash64("text"))
    path = scratch_path(spark, "passages")
    texts.select("k", _regions("text").alias("g")).filter(F.size("g") > 0).write.parquet(path)
    rows = spark.read.parquet(path)
    copies = rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    every = rows.select("k", F.explode("g").alias("g")).select("k", "g.*")
    near = cut(every.join(_repeated(every, "m"), "m").select("m", "r", "k", "lo", "hi").distinct())
    alike = near.join(_repeated(near.select("m", "r", "k"), "m", "r"), ["m", "r"]).select("k")
    settled = cut(alike.unionByName(copies).distinct())
    # texts still open, and all that have a hash of theirs
    open_ = near.join(settled, "k", "left_anti").select("m").distinct()
    asked = near.join(open_, "m", "left_semi").groupBy("k").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    asked = cut(asked)
    wanted = texts.join(asked.select("k"), "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    some = wanted.join(asked, "k").select("k", F.explode(_window_hashes("text", "lo", "hi")).alias("w"))
    some = cut(some)
    # only texts still open are looked up, so a window of masses of settled ones makes no hot task
    met = some.join(settled, "k", "left_anti").join(_repeated(some, "w"), "w", "left_semi").select("k")
    found = cut(settled.unionByName(met).distinct())
    drop_scratch(spark, path)
    return found
