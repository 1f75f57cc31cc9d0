"""Benchmark decontamination: short test items inside long documents.

The similarity is containment: the share of an item's distinct five-word shingles (ASCII
letters folded, words between white space) that occur in the document, at least 0.8.

Items are partitioned by size. Each partition has a MinHash sketch length that follows from
its largest item: of ``n`` shingles a document with enough containment lacks at most
``slack = floor(0.2 n)``, so of the ``2 * slack + 2`` smallest hashes of the item it holds at
least ``slack + 2`` (all, if the item has fewer). Documents with too few shingles skip the partitions that cannot
fit. Candidates are thus complete; each is verified by its exact shingle containment.

Only the items travel: their distinct texts in blocks of a bounded size, each broadcast in turn,
so neither the items nor a popular passage cause a shuffle of the documents. The ids of equal
items are joined to the hits.

NULL and empty texts and items match nothing. An item of fewer than five words is one shingle
and matches only a document of just these words. Equal items are hit alike; repeated rows of
documents are reported row by row; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.ragged import blocks, shingles

THRESHOLD = 0.8
WORDS = 5
ITEM_BLOCK_BYTES = 4 << 20  # text of the items that one broadcast holds
_GATE_BITS = 20


def _needed(n: int, threshold: float) -> int:
    """Fewest shared shingles of ``n`` that reach the threshold."""
    return max(1, math.ceil(n * threshold - 1e-9))


class ItemIndex:
    """Sketches of a block of items by size partition, and their shingle sets."""

    def __init__(self, sets: list[np.ndarray], threshold: float = THRESHOLD):
        self.sets = sets
        sizes = np.array([len(x) for x in sets], np.int64)
        self.needed = np.array([_needed(n, threshold) if n else 1 << 40 for n in sizes.tolist()], np.int64)
        self.hits_needed = np.ones(len(sets), np.int64)
        self.partitions = []
        classes = np.where(sizes > 0, np.floor(np.log2(np.maximum(sizes, 1))), -1).astype(int)
        for c in sorted(set(classes.tolist()) - {-1}):
            items = np.flatnonzero(classes == c)
            largest = int(sizes[items].max())
            length = 2 * (largest - _needed(largest, threshold)) + 2
            values, owners = [], []
            for i in items.tolist():
                sketch = sets[i][:length]  # sets are sorted, so these are the smallest hashes
                self.hits_needed[i] = max(1, len(sketch) - (sizes[i] - self.needed[i]))
                values.append(sketch)
                owners.append(np.full(len(sketch), i))
            value, owner = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            gate = np.zeros(1 << _GATE_BITS, bool)
            gate[(value & np.uint64((1 << _GATE_BITS) - 1)).astype(np.int64)] = True
            self.partitions.append((int(self.needed[items].min()), value, owner, gate))

    def search(self, doc: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of every item that a document's shingle set contains."""
        found = []
        for least, value, owner, gate in self.partitions:
            if len(doc) < least:
                continue
            some = doc[gate[(doc & np.uint64((1 << _GATE_BITS) - 1)).astype(np.int64)]]
            lo, hi = np.searchsorted(value, some, "left"), np.searchsorted(value, some, "right")
            met = hi > lo
            if not met.any():
                continue
            hits = np.concatenate([owner[a:b] for a, b in zip(lo[met].tolist(), hi[met].tolist())])
            items, times = np.unique(hits, return_counts=True)
            for i in items[times >= self.hits_needed[items]].tolist():
                at = np.searchsorted(doc, self.sets[i])
                at[at == len(doc)] = 0
                shared = int((doc[at] == self.sets[i]).sum())
                if shared >= self.needed[i]:
                    found.append((i, shared))
        return sorted(found)


_HITS = T.ArrayType(T.StructType([T.StructField("item", T.IntegerType()), T.StructField("shared", T.LongType())]))


def _item_blocks(items: DataFrame, block_bytes: int):
    """Distinct texts of the items in parts of about ``block_bytes``, each collected in turn."""
    texts = items.select("key", "t").dropDuplicates(["key"])
    total = texts.select(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("key"), F.lit(parts)) if parts > 1 else F.lit(0)
    for i in range(parts):
        yield texts.filter(part == i)


def _hits(text: str | Column, index) -> Column:
    @F.arrow_udf(_HITS)
    def searched(texts: pa.Array) -> pa.Array:
        found = [[{"item": i, "shared": n} for i, n in index.value.search(d)] for b in blocks(texts) for d in shingles(b, WORDS)]
        return pa.array(found, pa.list_(pa.struct([("item", pa.int32()), ("shared", pa.int64())])))

    return searched(text)


def _keyed(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item_id, key, t)``: items with the digest of their text; copies share one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return items.select(F.col(id_col).alias("item_id"), F.unhex(F.md5(text)).alias("key"), text.alias("t"))


def _indexes(items: DataFrame, threshold: float, block_bytes: int):
    """(digests, sizes, broadcast index) of each block of distinct texts."""
    sc = items.sparkSession.sparkContext
    for part in _item_blocks(items, block_bytes):
        table = part.toArrow()
        sets = [s for b in blocks(table["t"]) for s in shingles(b, WORDS)]
        if any(len(s) for s in sets):
            yield table["key"].to_pylist(), [len(s) for s in sets], sc.broadcast(ItemIndex(sets, threshold))


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = ITEM_BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item that it contains: ids, shared and own shingles of the item."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    keyed = _keyed(items, item_id_col, item_text_col)
    found = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("key", T.BinaryType()),
            T.StructField("n_shared", T.LongType()),
            T.StructField("n_item", T.LongType()),
        ]
    )
    hits = spark.createDataFrame([], found)
    named = T.StructType([T.StructField("item", T.IntegerType()), *found.fields[1:2], *found.fields[3:]])
    for keys, sizes, index in _indexes(keyed, threshold, block_bytes):
        hit = docs.select(F.col(id_col).alias("doc_id"), F.explode(_hits(F.col(text_col).cast("string"), index)).alias("h"))
        names = spark.createDataFrame([(i, bytearray(x), n) for i, (x, n) in enumerate(zip(keys, sizes))], named)
        rows = hit.select("doc_id", "h.*").join(F.broadcast(names), "item")
        hits = hits.unionByName(rows.select("doc_id", "key", F.col("shared").alias("n_shared"), "n_item"))
    return hits.join(keyed.select("key", "item_id"), "key").select("doc_id", "item_id", "n_shared", "n_item")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = ITEM_BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item."""
    for _, _, index in _indexes(_keyed(items, item_id_col, item_text_col), threshold, block_bytes):
        docs = docs.filter(F.size(_hits(F.col(text_col).cast("string"), index)) == 0)
    return docs
