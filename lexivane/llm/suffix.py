"""Exact removal of long repeated byte strings with suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same
or another text, goes. Strings never cross texts and are judged on the input.

1. Copies: a text that occurs more than once and is long enough goes whole. From here on each
   distinct text is taken once.
2. Regions: each string is filed under the least hash of the short grams in it, so equal
   strings are always filed alike. Neighbouring strings under one hash form a region. A region
   whose hash no other region has, and which cannot repeat itself, holds no repeated string.
   Regions with equal bytes repeat whole; one of them stands for all.
3. Shards: the remaining regions are gathered by hash into shards of a bounded size. A shard's
   suffix array comes from Larsson-Sadakane refinement (groups that are still unsorted are split
   by the rank of what follows, doubling the depth), its common prefixes from Kasai's method,
   run in lanes. Strings next to an equal one are repeated.
4. Merging: a hash with very many regions is dealt over several shards. Each publishes its
   distinct strings as sorted fingerprints in ranges; a range of all shards is merged by binary
   search.

NULL and empty texts lose nothing. Rows that repeat id and text are copies of each other; NULL
ids are reported row by row. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.passages import passage_keys
from lexivane.llm.ragged import Block, blocks, mix
from lexivane.llm.scratch import drop_scratch
from lexivane.session import cut, scratch_path

LENGTH = 400
SHARD_BYTES = 1 << 20
HOT_REGIONS = 1500  # regions of one hash that one shard takes
PART_STRINGS = 500_000  # strings of one hash whose fingerprints are merged together
BROADCAST_KEYS = 500_000  # digests (16 bytes each) that are broadcast at most


def gram_of(length: int) -> int:
    """Bytes of the grams that file strings: short, but not so short that all texts share them."""
    return max(1, min(32, length // 4))


def regions(block: Block, length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, hash, digest of the bytes, may repeat itself) of every
    region of a block; starts count from the text's own start."""
    gram = gram_of(length)
    width = length - gram + 1
    n = len(block.buf)
    none = np.zeros(0, np.int64)
    if n < length or not len(block) or (block.ends - block.starts).max() < length:
        return none, none, none, none, none, none.astype(bool)
    at = np.arange(n - gram + 1)
    h = block.hashes(at, at + gram)
    least, span = h, 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        rest = width - span
        least = np.minimum(least[: len(least) - rest], least[rest:])
    # least[s] is of the string from s; only strings inside one text count
    owner = np.repeat(np.arange(len(block)), np.diff(np.append(block.starts, n)))[: len(least)]
    inside = np.arange(len(least)) + length <= block.ends[owner]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    # grams with the least hash: at the start of a string, at the end of one, both
    opens = h[: len(least)] == least
    closes = h[width - 1 : width - 1 + len(least)] == least
    both = np.zeros(len(least), bool)
    both[width - 1 :] = opens[width - 1 :] & closes[: max(0, len(least) - width + 1)]
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (opens, closes, both)]
    seen = sums[0][last + 1] - sums[0][first] + sums[1][last + 1] - sums[1][first]
    low = np.minimum(np.maximum(first + width - 1, first), last + 1)
    seen = seen - (sums[2][last + 1] - sums[2][low])
    digest = block.hashes(first, last + length)
    own = block.starts[owner[first]]
    return owner[first], first - own, last - own, least[first].view(np.int64), digest.view(np.int64), seen > 1


_REGION = T.StructType(
    [
        T.StructField("lo", T.IntegerType()),
        T.StructField("hi", T.IntegerType()),
        T.StructField("m", T.LongType()),
        T.StructField("r", T.LongType()),
        T.StructField("self", T.BooleanType()),
    ]
)


def _regions_of(length: int):
    @F.arrow_udf(T.ArrayType(_REGION))
    def found(texts: pa.Array) -> pa.Array:
        offsets, columns = [np.zeros(1, np.int64)], []
        done = 0
        for block in blocks(texts):
            owner, *parts = regions(block, length)
            offsets.append(done + np.cumsum(np.bincount(owner, minlength=len(block))))
            done += len(owner)
            columns.append(parts)
        each = [np.concatenate([c[i] for c in columns]) if columns else np.zeros(0) for i in range(5)]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        flat = pa.StructArray.from_arrays(
            [pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(each, types)], ["lo", "hi", "m", "r", "self"]
        )
        return pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()), flat)

    return found


def _eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, most significant first."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    two = (padded[:-1] << np.uint64(8)) | padded[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    eight = (four[:-4] << np.uint64(32)) | four[4:]
    return eight[: len(buf)]


def suffix_array(buf: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, which suffixes share ``depth / 2`` bytes or more with another one) by
    Larsson-Sadakane refinement: groups of suffixes that are equal so far are split by the rank
    of what follows them, which doubles the depth, until every suffix is alone."""
    n = len(buf)
    word = _eight(buf)
    sa = np.argsort(word, kind="stable")
    rank = np.empty(n, np.int64)

    def alone(order: np.ndarray, key: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Rank suffixes by the place of the first of their group; which are alone in it?"""
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        head = np.maximum.accumulate(np.where(new[:-1], np.arange(len(order)), 0))
        rank[order] = base[head]
        return new[:-1] & new[1:]

    place = np.flatnonzero(~alone(sa, word[sa], np.arange(n)))  # where unsorted suffixes stand
    tied = np.full(n, depth < 8)
    h = 8
    while len(place):
        some = sa[place]
        if h <= depth:
            tied[:] = False
            tied[some] = True
        follow = some + h
        key = rank[some] * (n + 1) + np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        some = some[order]
        sa[place] = some
        place = place[~alone(some, key[order], place)]
        h *= 2
    return sa, tied


def kasai(buf: np.ndarray, sa: np.ndarray, wanted: np.ndarray, limit: int, lane: int = 128) -> np.ndarray:
    """Common prefix of each wanted suffix with the one before it in the array, up to ``limit``.

    Kasai's bound, that a suffix shares at most one byte less than the suffix one byte to its
    left, carries the length along a lane of neighbouring suffixes; all lanes move together.
    """
    n = len(buf)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(wanted)
    if not len(at):
        return lcp
    word = np.concatenate([_eight(buf), np.zeros(limit + 8, np.uint64)])
    lanes = -(-len(at) // lane)
    grid = np.full(lanes * lane, -1, np.int64)
    grid[: len(at)] = at
    grid = grid.reshape(lanes, lane)
    carried, came = np.zeros(lanes, np.int64), np.full(lanes, -10, np.int64)
    for j in range(lane):
        here = grid[:, j]
        other = before[np.maximum(here, 0)]
        live = (here >= 0) & (other >= 0)
        known = np.where(live & (here == came + 1), np.maximum(carried - 1, 0), 0)
        size = np.where(live, known, 0)
        go = np.flatnonzero(live & (size < limit))
        while len(go):
            differ = word[here[go] + size[go]] ^ word[other[go] + size[go]]
            same = differ == 0
            size[go[same]] += 8
            stop = go[~same]
            top = differ[~same]
            for byte in range(1, 8):
                size[stop] += top < np.uint64(1 << (64 - 8 * byte))
            go = go[same]
            go = go[size[go] < limit]
        size = np.minimum(size, np.where(live, np.minimum(limit, n - np.maximum(here, other)), 0))
        lcp[here[live]] = size[live]
        carried, came = size, here
    return lcp


def repeated_starts(buf: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the starts marked valid (whose strings end inside their region): which have a string
    that starts at another valid place too; numbers that only equal strings have in common."""
    sa, tied = suffix_array(buf, length)
    common = kasai(buf, sa, tied, length)[sa]
    at = np.flatnonzero(valid[sa])  # a suffix of an invalid start is no string of its region
    order = sa[at]
    again, number = np.zeros(len(buf), bool), np.zeros(len(buf), np.int64)
    if len(order) > 1:
        # the prefix that two suffixes share is the least one on the way between them
        equal = np.minimum.reduceat(common, at[:-1] + 1)[: len(at) - 1] >= length
        last = int(common[at[-2] + 1 : at[-1] + 1].min())
        equal[-1] = last >= length
        again[order[1:][equal]] = True
        again[order[:-1][equal]] = True
        number[order[1:]] = np.cumsum(~equal)
    return again, number


def _runs(region: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, first, last) of runs of consecutive starts, given in order."""
    if not len(start):
        return region, start, start
    new = np.ones(len(start), bool)
    new[1:] = (region[1:] != region[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return region[first], start[first], start[last]


_SHARD_OUT = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("lo", T.IntegerType()),
        T.StructField("hi", T.IntegerType()),
        T.StructField("m", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("prints", T.ArrayType(T.LongType())),
        T.StructField("region", T.ArrayType(T.IntegerType())),
        T.StructField("start", T.ArrayType(T.IntegerType())),
        T.StructField("settled", T.ArrayType(T.BooleanType())),
        T.StructField("keys", T.ArrayType(T.BinaryType())),
    ]
)


def _arrow_schema() -> pa.Schema:
    i32, i64, raw = pa.int32(), pa.int64(), pa.binary()
    kinds = [raw, i32, i32, i64, i32, pa.list_(i64), pa.list_(i32), pa.list_(i32), pa.list_(pa.bool_()), pa.list_(raw)]
    return pa.schema(list(zip(_SHARD_OUT.names, kinds)))


def _intervals(keys: list, region: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[dict]:
    return [{"key": keys[r], "lo": a, "hi": b} for r, a, b in zip(region.tolist(), first.tolist(), last.tolist())]


def _sharder(length: int):
    def run(table: pa.Table) -> pa.Table:
        keys = table["key"].to_pylist()
        low = table["lo"].to_numpy()
        parts = int(table["parts"][0].as_py())
        raw = table["bytes"].to_pylist()
        sizes = np.array([len(x) for x in raw])
        buf = np.frombuffer(b"".join(raw), np.uint8)
        base = np.cumsum(sizes) - sizes
        region = np.repeat(np.arange(len(raw)), sizes)
        inside = np.arange(len(buf)) - base[region]
        valid = inside + length <= sizes[region]
        again, number = repeated_starts(buf, valid, length)
        at = np.flatnonzero(again)
        rows = _intervals(keys, *_runs(region[at], low[region[at]] + inside[at]))
        if parts:  # one hash in several shards: publish one of each distinct string
            at = np.flatnonzero(valid)
            _, one = np.unique(number[at], return_index=True)
            at = at[one]
            block = Block(0, buf, np.zeros(1, np.int64), np.array([len(buf)]))
            prints = block.hashes(at, at + length)
            part = (mix(prints + np.uint64(3)) % np.uint64(parts)).astype(int)
            order = np.lexsort((prints, part))
            at, prints, part = at[order], prints[order].view(np.int64), part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                a = slice(cuts[p], cuts[p + 1])
                used, spot = np.unique(region[at[a]], return_inverse=True)
                rows.append(
                    {
                        "m": int(table["m"][0].as_py()),
                        "part": p,
                        "prints": prints[a],
                        "region": spot,
                        "start": low[region[at[a]]] + inside[at[a]],
                        "settled": again[at[a]],
                        "keys": [keys[r] for r in used.tolist()],
                    }
                )
        return pa.Table.from_pylist(rows, _arrow_schema())

    return run


_FOUND = T.StructType(_SHARD_OUT.fields[:3])


def _merge(table: pa.Table) -> pa.Table:
    """Strings of one shard that another shard of the same hash has too."""
    shards = []
    for row in range(table.num_rows):
        get = lambda c: table[c][row].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
        shards.append((get("prints").view(np.uint64), get("region"), get("start"), get("settled"), table["keys"][row].as_py()))
    merged = np.sort(np.concatenate([s[0] for s in shards]))
    rows: list[dict] = []
    for prints, region, start, settled, keys in shards:
        times = np.searchsorted(merged, prints, "right") - np.searchsorted(merged, prints, "left")
        hit = np.flatnonzero((times > 1) & ~settled)
        order = hit[np.lexsort((start[hit], region[hit]))]
        rows += _intervals(keys, *_runs(region[order], start[order]))
    return pa.Table.from_pylist(rows, pa.schema([("key", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())]))


_CUT = T.ArrayType(T.BinaryType())


@F.arrow_udf(_CUT)
def _cut_bytes(texts: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    """Bytes of each text from ``low`` to ``high``, arrays of the same size."""
    out = []
    for text, a, b in zip(texts, low, high):
        raw = text.as_py().encode()
        out.append([raw[x:y] for x, y in zip(a.as_py(), b.as_py())])
    return pa.array(out, pa.list_(pa.binary()))


_LEFT = T.StructType(
    [T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]
)


def cover(raw: bytes, low: np.ndarray, high: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs, bytes kept) without the byte ranges."""
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    gone = np.cumsum(edge)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()


@F.arrow_udf(_LEFT)
def _removed(texts: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    found = [cover(t.as_py().encode(), np.array(a.as_py(), int), np.array(b.as_py(), int)) for t, a, b in zip(texts, low, high)]
    columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
    return pa.StructArray.from_arrays(columns, ["n_removed", "n_spans", "kept"])


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("key", F.unhex(F.md5("text")))


def repeated_spans(
    df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES,
    hot_regions: int = HOT_REGIONS, part_strings: int = PART_STRINGS,
) -> DataFrame:
    """(key, low, high, text): byte ranges of repeated strings of each distinct text that has some."""
    spark = df.sparkSession
    texts = _keyed(df, id_col, text_col).filter(F.octet_length("text") >= length)
    path = scratch_path(spark, "regions")
    texts.select("key", F.explode(_regions_of(length)("text")).alias("g")).select("key", "g.*").write.parquet(path)
    every = spark.read.parquet(path)

    # hashes with two regions of different texts or places, or one that may repeat itself
    place = F.xxhash64("key", "lo")
    shared = every.groupBy("m").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("self").alias("self"))
    shared = shared.filter("a <> b or self").select("m")
    near = cut(every.join(shared, "m").select("m", "r", "key", "lo", "hi", "self").distinct())

    by_bytes = near.groupBy("m", "r").agg(F.count("*").alias("n"), F.min(F.struct("key", "lo", "hi")).alias("one"), F.max("self").alias("self"))
    by_bytes = cut(by_bytes)
    by_hash = by_bytes.groupBy("m").agg(F.count("*").alias("different"), F.max("self").alias("self"))
    by_hash = by_hash.filter("different > 1 or self").select("m", "different")

    whole = near.join(by_bytes.filter("n > 1").select("m", "r"), ["m", "r"]).select("key", "lo", "hi")
    sorted_ = by_bytes.join(by_hash, "m").select("m", "r", "different", "one.*")
    sorted_ = cut(sorted_)
    total = sorted_.select(F.sum(F.col("hi") - F.col("lo") + length)).first()[0] or 0
    shards = max(1, total // shard_bytes)
    hot = F.col("different") > hot_regions
    salt = F.pmod(F.xxhash64("r"), F.ceil(F.col("different") / hot_regions))
    parts = F.when(hot, F.ceil(F.col("different") * length / 2 / part_strings)).otherwise(0).cast("int")
    asked = sorted_.select(
        "key", "lo", (F.col("hi") + length).alias("end"), "m", parts.alias("parts"), hot.alias("hot"),
        F.when(hot, F.xxhash64("m", salt)).otherwise(F.pmod(F.xxhash64("m"), F.lit(shards))).alias("shard"),
    )

    drop_scratch(spark, path)
    keys = cut(whole.select("key").unionByName(asked.select("key")).distinct())
    few = keys.count() <= BROADCAST_KEYS
    wanted = texts.join(F.broadcast(keys) if few else keys, "key", "left_semi")
    store = scratch_path(spark, "texts")
    wanted.groupBy("key").agg(F.first("text").alias("text")).write.parquet(store)
    own = spark.read.parquet(store)

    per_text = asked.groupBy("key").agg(F.collect_list(F.struct("lo", "end", "m", "parts", "hot", "shard")).alias("g"))
    pieces = own.join(per_text, "key").select("key", "g", _cut_bytes("text", "g.lo", "g.end").alias("raw"))
    pieces = pieces.select("key", F.explode(F.arrays_zip("g", "raw")).alias("z")).select("key", "z.g.*", F.col("z.raw").alias("bytes"))
    found = cut(pieces.groupBy("hot", "shard").applyInArrow(_sharder(length), _SHARD_OUT))
    spans = found.filter("key is not null").select("key", "lo", "hi")
    published = found.filter("key is null")
    crossed = published.groupBy("m", "part").applyInArrow(_merge, _FOUND)
    spans = spans.unionByName(crossed).unionByName(whole)
    ranges = spans.groupBy("key").agg(
        F.collect_list(F.struct("lo", (F.col("hi") + length).alias("end"))).alias("s")
    )
    return own.join(ranges, "key").select("key", F.col("s.lo").alias("low"), F.col("s.end").alias("high"), "text")


def dedup_substrings(
    df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **limits
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that stay; and whether
    the text holds more than fifty words in a row of another row's, which may be fewer bytes."""
    spans = repeated_spans(df, length, id_col, text_col, **limits)
    left = spans.select("key", _removed("text", "low", "high").alias("c"))
    left = cut(left.select("key", "c.n_removed", "c.n_spans", F.sha2("c.kept", 256).alias("sha")))
    rows = _keyed(df, id_col, text_col).select(
        "doc_id", "key", F.xxhash64("text").alias("k"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own_sha")
    )
    shared = passage_keys(df, text_col).withColumn("shares_passage", F.lit(True))
    copied = rows.filter(F.col("n_bytes") >= length).groupBy("key").count().filter("count > 1").select("key", F.lit(True).alias("copied"))
    return rows.join(left, "key", "left").join(copied, "key", "left").join(shared, "k", "left").select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copied"), hashlib.sha256().hexdigest()).otherwise(F.coalesce("sha", "own_sha")).alias("kept_sha256"),
        F.coalesce("shares_passage", F.lit(False)).alias("shares_passage"),
    )
