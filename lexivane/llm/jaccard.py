"""N-gram Jaccard join with Bayesian pruning of candidates.

Two texts are linked if the Jaccard similarity of their distinct five-word shingles (ASCII
letters folded, words between white space) is at least 0.8.

1. Copies of one text form a class with the text's digest as key; they become one row before
   anything is dealt by band or key, and only classes are compared.
2. Each text's MinHash values are cut into bands. Classes that share a band's value are joined
   to its least key (a star, not pairs); the components of these stars hold every candidate.
3. Members of a component meet in one task, or, in blocks of a bounded size, each pair of blocks
   in a task of its own; pairs with a common band are compared. A component so loose that its
   buckets are cheaper than all its pairs goes by bucket, where a pair counts only in the first
   band that it shares: the same pairs, counted once.
4. In a task the MinHash values of a pair are compared in growing prefixes. With a uniform
   prior the similarity given m matches of h has a Beta posterior; a pair is dropped once
   P(similarity >= threshold) < ``TOLERANCE``. What is left is verified by exact intersection.
5. A task emits per member its number of links and one edge of a spanning forest, never pairs.

A text without words links to nothing and is a class of its own, as NULL and empty ones are.
A text of fewer than five words has one shingle of all of them. Repeated rows are copies. Ids
may repeat or be NULL: they only name the classes. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.components import connected_components
from lexivane.llm.ragged import blocks, mix, shingles
from lexivane.llm.scratch import drop_scratch
from lexivane.session import cut, scratch_path

THRESHOLD = 0.8
WORDS = 5
BANDS, ROWS = 24, 4  # a pair at 0.8 shares no band with a chance of (1 - 0.8**4)**24 = 3e-6
STEPS = (16, 32, 64, BANDS * ROWS)  # MinHash values compared so far
TOLERANCE = 1e-9
BLOCK = 512  # members of a component that one side of a task holds
BLOCK_BYTES = 32 * 1024 * 1024  # and bytes of their texts, on average
_FACTORS = np.random.default_rng(77).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row per non-empty shingle set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), len(_FACTORS)), np.uint32)
    held = np.empty_like(flat)
    for j, factor in enumerate(_FACTORS):
        np.multiply(flat, factor, out=held)
        out[:, j] = np.minimum.reduceat(held, starts) >> np.uint64(32)
    return out


def band_values(sig: np.ndarray) -> np.ndarray:
    total = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        total = total * np.uint64(0xD1342543DE82EF95) + sig[:, r::ROWS].astype(np.uint64)
    return mix(total + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _set_blocks(texts):
    """Shingle sets of a column in parts, with their signatures (None without any shingle)."""
    for block in blocks(texts):
        sets = shingles(block, WORDS)
        full = [s for s in sets if len(s)]
        yield sets, signatures(full) if full else None


@F.arrow_udf(T.ArrayType(T.LongType()))
def _bands(texts: pa.Array) -> pa.Array:
    out: list = []
    for sets, sig in _set_blocks(texts):
        rows = iter(band_values(sig)) if sig is not None else iter(())
        out.extend(next(rows) if len(s) else np.zeros(0, np.int64) for s in sets)
    return pa.array(out, pa.list_(pa.int64()))


@functools.lru_cache
def fewest_matches(threshold: float) -> tuple[int, ...]:
    """Per step of h values, the fewest matches with P(similarity >= threshold) >= TOLERANCE.

    With a uniform prior that posterior tail of m matches is P(Binomial(h + 1, threshold) <= m).
    """
    out = []
    for h in STEPS:
        tail = 0.0
        for m in range(h + 1):
            tail += math.comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
            if tail >= TOLERANCE:
                break
        out.append(m)
    return tuple(out)


class _Members:
    """The texts of one task."""

    def __init__(self, texts: pa.ChunkedArray, threshold: float):
        sets, sigs = [], []
        for some, sig in _set_blocks(texts):
            sets += some
            sigs.append(sig)
        self.sets, self.sig, self.threshold = sets, np.concatenate(sigs), threshold
        self.bands = band_values(self.sig)
        self.sizes = np.array([len(s) for s in sets], np.int64)

    def _bitmaps(self, rows: np.ndarray) -> np.ndarray:
        """Per row the shingles that at least two of the rows have, as bits."""
        flat = np.concatenate([self.sets[r] for r in rows])
        owner = np.repeat(np.arange(len(rows)), self.sizes[rows])
        _, which, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times > 1
        column = (np.cumsum(shared) - 1)[which]
        use = shared[which]
        width = -(-max(1, int(shared.sum())) // 64)
        bits = np.zeros((len(rows), width), np.uint64)
        column, owner = column[use], owner[use]
        np.bitwise_or.at(bits, (owner, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
        return bits

    def links(self, left: np.ndarray, right: np.ndarray, same: bool, band: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs between two lists of rows (``same``: each pair within one list once)."""
        rows = left if same else np.concatenate([left, right])
        bits, bit_row = None, {r: i for i, r in enumerate(rows.tolist())}
        least = fewest_matches(self.threshold)
        a, b = [], []
        for i, x in enumerate(left.tolist()):
            alive = right[i + 1 :] if same else right
            n, m = self.sizes[x], self.sizes[alive]
            alive = alive[np.minimum(n, m) >= self.threshold * np.maximum(n, m) - 1e-9]
            if len(alive):  # pairs without a common band are none of the candidates, in a unit of any size
                equal = self.bands[alive] == self.bands[x]
                met = equal.any(axis=1)
                if band is not None:
                    met &= self.bands[x][np.argmax(equal, axis=1)] == band
                alive = alive[met]
            done, matches = 0, np.zeros(len(alive), np.int64)
            for h, fewest in zip(STEPS, least):
                if not len(alive):
                    break
                matches = matches + (self.sig[alive, done:h] == self.sig[x, done:h]).sum(axis=1)
                done = h
                keep = matches >= fewest
                alive, matches = alive[keep], matches[keep]
            if not len(alive):
                continue
            if len(rows) <= 2:
                both = np.array([len(np.intersect1d(self.sets[x], self.sets[alive[0]], assume_unique=True))])
            else:
                if bits is None:
                    bits = self._bitmaps(rows)
                mine = bits[bit_row[x]]
                used = np.flatnonzero(mine)
                others = bits[[bit_row[r] for r in alive.tolist()]][:, used]
                both = np.bitwise_count(others & mine[used]).sum(axis=1, dtype=np.int64)
            alive = alive[both >= self.threshold * (n + self.sizes[alive] - both) - 1e-9]
            a.append(np.full(len(alive), x))
            b.append(alive)
        none = np.zeros(0, np.int64)
        return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least row that each row is connected with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


_FOUND = T.StructType(
    [T.StructField("key", T.BinaryType()), T.StructField("add", T.LongType()), T.StructField("other", T.BinaryType())]
)


def _verifier(threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        members = _Members(table["text"], threshold)
        copies = table["copies"].to_numpy()
        unit = table["unit"].to_numpy()
        block, pi, pj = (table[c].to_numpy() for c in ("block", "pi", "pj"))
        band = table["band"].to_pylist()
        keys = table["key"].to_pylist()
        order = np.lexsort((np.arange(len(unit)), unit))
        cuts = np.flatnonzero(np.diff(unit[order], prepend=unit[order][:1] - 1)) if len(order) else order
        links = [
            members.links(
                rows[block[rows] == pi[rows[0]]], rows[block[rows] == pj[rows[0]]], bool(pi[rows[0]] == pj[rows[0]]), band[rows[0]]
            )
            for rows in np.split(order, cuts[1:])
        ]
        a, b = np.concatenate([x for x, _ in links]), np.concatenate([x for _, x in links])
        add = np.bincount(a, weights=copies[b], minlength=len(keys)) + np.bincount(b, weights=copies[a], minlength=len(keys))
        label = _forest(a, b, len(keys))
        rows = np.flatnonzero(add > 0).tolist()
        return pa.table(
            {
                "key": pa.array([keys[r] for r in rows], pa.binary()),
                "add": pa.array(add[rows].astype(np.int64), pa.int64()),
                "other": pa.array([keys[label[r]] for r in rows], pa.binary()),
            }
        )

    return verify


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.unhex(F.md5("text")))


_HAS_WORD = r"[^\x20\x09-\x0D]"


def _units(bands: DataFrame, member: DataFrame, block: int) -> DataFrame:
    """(unit, key, m, bytes, band) of what meets: whole components, or buckets of loose large
    ones. Either way the pairs with a common band are compared."""
    sizes = member.groupBy("comp").agg(F.count("*").alias("m"), F.sum("size").alias("bytes"))
    whole = member.join(sizes, "comp").select(
        F.xxhash64("comp").alias("unit"), "key", "m", "bytes", F.lit(None).cast("long").alias("band"), "comp"
    )
    large = sizes.filter(F.col("m") > block).select("comp", "m")
    if large.isEmpty():
        return whole
    pairs = cut(bands.join(member.join(large, "comp"), "key").select("comp", "m", "band", "key", "size").distinct())
    buckets = pairs.groupBy("comp", "band").agg(F.count("*").alias("s"), F.first("m").alias("m"), F.sum("size").alias("bytes"))
    cost = buckets.groupBy("comp").agg(F.sum(F.col("s").cast("double") * F.col("s")).alias("cost"), F.first("m").alias("m"))
    loose = cut(cost.filter(F.col("cost") < F.col("m").cast("double") * F.col("m")).select("comp"))
    if loose.isEmpty():
        return whole
    apart = (
        pairs.select("comp", "band", "key")
        .join(loose, "comp")
        .join(buckets.filter("s > 1").select("comp", "band", "s", "bytes"), ["comp", "band"])
        .select(F.xxhash64("comp", "band").alias("unit"), "key", F.col("s").alias("m"), "bytes", "band", "comp")
    )
    return whole.join(loose, "comp", "left_anti").select(apart.columns).unionByName(apart)


def _links(df: DataFrame, threshold: float, id_col: str, text_col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """((key, n_links), (node, root)) of all linked classes."""
    spark = df.sparkSession
    texts = _keyed(df, id_col, text_col)
    each, path = scratch_path(spark, "banded"), scratch_path(spark, "bands")
    texts.select("key", _bands("text").alias("bands"), F.octet_length("text").cast("long").alias("size")).write.parquet(each)
    # one row per text: its copies shrink map-side before anything is dealt by key or band
    once = spark.read.parquet(each).groupBy("key").agg(F.first("bands").alias("bands"), F.first("size").alias("size"), F.count("*").alias("copies"))
    once.write.parquet(path)
    drop_scratch(spark, each)
    known = spark.read.parquet(path)
    bands = known.select("key", F.explode("bands").alias("band"))
    stars = bands.groupBy("band").agg(F.min("key").alias("b"), F.max("key").alias("z")).filter("b <> z").select("band", "b")
    edges = bands.join(stars, "band").select(F.col("key").alias("a"), "b")
    roots = connected_components(edges).select(F.col("node").alias("key"), F.col("root").alias("comp"))
    member = cut(roots.join(known.select("key", "size", "copies"), "key"))
    units = _units(bands, member.drop("copies"), block)

    # a block has at most so many members and, on average, bytes
    parts = F.ceil(F.greatest(F.col("m") / block, F.col("bytes") / BLOCK_BYTES)).cast("int")
    units = units.withColumn("parts", F.least(parts, F.col("m").cast("int")))
    units = units.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    units = units.select(
        "unit", "band", "key", "block", F.least("block", "other").alias("pi"), F.greatest("block", "other").alias("pj"), "parts"
    )
    # small units share a group, large ones have one for each pair of blocks
    count, n_bytes = member.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = max(1, count // (block // 4), n_bytes // (BLOCK_BYTES // 4))
    small = F.col("parts") == 1
    units = units.withColumn(
        "group", F.when(small, F.pmod("unit", F.lit(groups))).otherwise(F.xxhash64("unit", "pi", "pj"))
    ).withColumn("small", small)
    reps = texts.join(member.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    reps = reps.join(member.select("key", "copies"), "key")
    ready = units.join(reps, "key").select("small", "group", "unit", "band", "block", "pi", "pj", "key", "copies", "text")
    found = cut(ready.groupBy("small", "group").applyInArrow(_verifier(threshold), _FOUND))
    drop_scratch(spark, path)
    roots = connected_components(found.select(F.col("key").alias("a"), F.col("other").alias("b")))
    return found.groupBy("key").agg(F.sum("add").alias("n_links")), roots


def classify(
    df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per row of ``df`` that has words: id, text digest ``key``, its class's ``root``
    key, the number of other rows it links to and the rows with the same text."""
    links, roots = _links(df, threshold, id_col, text_col, block)
    rows = _keyed(df, id_col, text_col).filter(F.col("text").rlike(_HAS_WORD)).select("id", "key")
    copies = rows.groupBy("key").agg(F.count("*").alias("n_copies"))
    keys = (
        copies.join(links, "key", "left")
        .join(roots.withColumnRenamed("node", "key"), "key", "left")
        .select(
            "key",
            F.coalesce("root", "key").alias("root"),
            (F.coalesce("n_links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"),
            "n_copies",
        )
    )
    return rows.join(keys, "key")


def near_duplicates(
    df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per row of ``df``: doc_id, class_id (least id of its class), n_links, n_copies."""
    rows = cut(classify(df, threshold, id_col, text_col, block))
    names = rows.groupBy("root").agg(F.min("id").alias("class_id"))
    judged = rows.join(names, "root").select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")
    wordless = _keyed(df, id_col, text_col).filter(~F.col("text").rlike(_HAS_WORD))
    one = F.lit(1).cast("long")
    alone = wordless.select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), (one - 1).alias("n_links"), one.alias("n_copies"))
    return judged.unionByName(alone)


def keep_one(
    df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """The rows of ``df``, all columns, less all but the least (id, text digest) of each class.

    Rows without words stay. Of rows that repeat both id and text one stays.
    """
    rows = cut(classify(df, threshold, id_col, text_col, block))
    best = rows.groupBy("root").agg(F.min(F.struct("id", "key")).alias("s")).select("s.id", "s.key")
    repeated = not rows.groupBy("id", "key").count().filter("count > 1").isEmpty()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ours = df.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), text.alias("t"))
    worded = ours.filter(F.col("t").rlike(_HAS_WORD)).select("row", "i", F.unhex(F.md5("t")).alias("k"))
    kept = worded.join(best, worded.i.eqNullSafe(best.id) & (worded.k == best.key), "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["i", "k"])
    return kept.select("row.*").unionByName(ours.filter(~F.col("t").rlike(_HAS_WORD)).select("row.*"))
