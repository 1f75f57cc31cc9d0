"""Alignment of two tokenizers' tokens by the bytes they cover.

Each text is encoded by both sides (A: space and text; B adds the space itself). Tokens of a
batch are rows of two tables with document, first byte and last byte. ``merge_asof``, keyed by
document, finds for each A token the B token that covers its first byte and the other way
round; the union of both directions is all overlapping pairs. Pairs with equal ends are links,
and cut the text into groups. Links are counted over the corpus by Spark.

Texts that are NULL or empty, or whose joined token bytes on either side differ from space and
text, have no tokens: zeros and an empty digest. Strings of special tokens are plain text. Rows
that repeat are answered row by row, NULL ids stay; an empty table gives no rows; other columns
play no part.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.lookups import look_up
from lexivane.llm.tokens import _byte_letters
from lexivane.session import scratch_path

BATCH_BYTES = 1 << 20  # text aligned together; a longer text is a batch of its own
# Fixed value: how the byte-level vocabulary splits text before its merges.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# letter classes beyond these blocks may depend on the library's tables
_BEYOND = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u20ac]").search


class ByteSide:
    """A byte-level vocabulary in the format of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        byte = {c: b for b, c in enumerate(_byte_letters())}
        self.tokens = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            if all(c in byte for c in token):
                self.tokens[i] = bytes(map(byte.__getitem__, token))
        self.fast = self._by_rank(spec, vocab)

    def _by_rank(self, spec: dict, vocab: dict):
        """A faster encoder if ids are in the order of the merges and the split is the plain one."""
        pre = spec.get("pre_tokenizer") or {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if not plain or spec.get("normalizer") or made != sorted(made) or spec["model"].get("ignore_merges"):
            return None
        import tiktoken

        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {t: i for i, t in enumerate(self.tokens) if t and i not in special}
        return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list:
        if self.fast is None:
            return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return [
            self.library.encode(t, add_special_tokens=False).ids if _BEYOND(t) else self.fast.encode_ordinary(t) for t in texts
        ]


class PieceSide:
    """A ``sentencepiece`` model, which adds the space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        pieces = map(self.library.id_to_piece, range(size))
        self.tokens = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]

    def encode(self, texts: list[str]) -> list:
        return self.library.encode([t[1:] for t in texts], num_threads=1)


@functools.lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[ByteSide, PieceSide, np.ndarray, np.ndarray]:
    """Both encoders and the byte length of each of their tokens; once per worker process."""
    a, b = ByteSide(path_a), PieceSide(path_b)
    return a, b, np.array(list(map(len, a.tokens)), np.int64), np.array(list(map(len, b.tokens)), np.int64)


def _flat(lists: list, lengths: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """One row per token: document, first and last byte (in the batch), number; tokens per text."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(counts.sum()))
    end = np.cumsum(lengths[ids])
    doc = np.repeat(np.arange(len(lists)), counts)
    return pd.DataFrame({"doc": doc, "start": end - lengths[ids], "end": end, "token": ids, "row": np.arange(len(ids))}), counts


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and B tokens that share a byte: each token's first byte lies in one token
    of the other side. Pairs that begin together come from the first direction alone."""
    a, b = a[["doc", "start", "row"]], b[["doc", "start", "row"]]
    into_b = pd.merge_asof(a, b, on="start", by="doc", suffixes=("_a", "_b"))
    into_a = pd.merge_asof(b, a, on="start", by="doc", suffixes=("_b", "_a"), allow_exact_matches=False)
    alone = into_b["row_b"].to_numpy()  # a B token that begins with an A token is known
    row_a, row_b = into_a["row_a"].to_numpy(), into_a["row_b"].to_numpy()
    together = np.zeros(len(b), bool)
    together[alone[a["start"].to_numpy() == b["start"].to_numpy()[alone]]] = True
    new = ~together
    return np.append(into_b["row_a"].to_numpy(), row_a[new].astype(np.int64)), np.append(alone, row_b[new])


def _align(texts: list[str], path_a: str, path_b: str) -> dict:
    """Figures per text, and its distinct links with their numbers."""
    side_a, side_b, len_a, len_b = sides(path_a, path_b)
    spaced = [" " + t if t else "" for t in texts]
    asked = [t for t in spaced if t]
    given = iter(zip(side_a.encode(asked), side_b.encode(asked)))
    lists_a, lists_b = [], []
    for t in spaced:
        ids_a, ids_b = next(given) if t else ([], [])
        whole = t.encode()
        if b"".join(map(side_a.tokens.__getitem__, ids_a)) != whole or b"".join(map(side_b.tokens.__getitem__, ids_b)) != whole:
            ids_a, ids_b = [], []
        lists_a.append(ids_a)
        lists_b.append(ids_b)
    a, n_a = _flat(lists_a, len_a)
    b, n_b = _flat(lists_b, len_b)
    n = len(texts)
    out = {"n_a": n_a, "n_b": n_b}
    met_a, met_b = overlaps(a, b)
    end_a, end_b, doc_a = a["end"].to_numpy(), b["end"].to_numpy(), a["doc"].to_numpy()
    token_a, token_b = a["token"].to_numpy(), b["token"].to_numpy()
    joint = end_a[met_a] == end_b[met_b]
    row_a, row_b = np.sort(met_a[joint]), np.sort(met_b[joint])  # both in the order of the text
    doc = doc_a[row_a]
    out["n_groups"] = np.bincount(doc, minlength=n)  # each common end closes one group
    out["n_links"] = out["n_groups"]
    # place of each token in the list of groups: A before B in each of them
    closes_a, closes_b = np.zeros(len(token_a), np.int64), np.zeros(len(token_b), np.int64)
    closes_a[row_a], closes_b[row_b] = 1, 1
    before_a = np.append(0, row_b + 1)[np.cumsum(closes_a) - closes_a]
    before_b = np.append(row_a + 1, 0)[np.cumsum(closes_b) - closes_b]
    width = max(len(side_a.tokens), len(side_b.tokens))
    keys = np.empty(len(token_a) + len(token_b), np.int64)
    keys[a["row"].to_numpy() + before_a] = token_a + width * closes_a
    keys[b["row"].to_numpy() + before_b] = token_b + 2 * width * closes_b
    names = _names(width)
    cut = np.append(0, np.cumsum(n_a + n_b))
    listed = keys.tolist()
    out["groups"] = ["".join(map(names.__getitem__, listed[s:e]))[:-1] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())]
    out["met"], out["doc_of_a"] = (met_a, met_b), doc_a
    out["first_a"], out["first_b"] = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
    pair = token_a[row_a] * len(side_b.tokens) + token_b[row_b]
    order = np.argsort(pair)
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]  # few distinct values: by radix
    pair, doc = pair[order], doc[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    out["pair"], out["pair_n"] = pair[at], np.diff(np.append(at, len(pair)))
    out["pair_cut"] = np.searchsorted(doc[at], np.arange(n + 1))
    return out


@functools.lru_cache(maxsize=2)
def _names(width: int) -> list[str]:
    """Each id in decimals with what follows it: inside a side, at the end of A, at the end of B."""
    return [f"{i}{mark}" for mark in (",", "|", ";") for i in range(width)]


def _batches(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size, some = 0, 0, []
    for i, t in enumerate(texts):
        some.append(t)
        size += len(t)
        if size > BATCH_BYTES:
            yield first, some
            first, size, some = i + 1, 0, []
    if some:
        yield first, some


_FIGURES = "n_a long, n_b long, n_groups long, n_links long"


def _aligned(df: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """Per row of ``df``, with a number of its own: figures, digest and links; ``whole``: groups
    and overlaps as well."""
    picked = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    schema = f"uid long, doc_id {kind}, {_FIGURES}, groups_sha256 string, links array<struct<pair: long, n: long>>"
    if whole:
        schema += ", groups string, overlaps array<struct<a: long, b: long>>"

    def pairs_list(cut: np.ndarray, names: tuple[str, str], one: np.ndarray, two: np.ndarray) -> pa.Array:
        values = pa.StructArray.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], list(names))
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for first, some in _batches(texts):
                got = _align(some, path_a, path_b)
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in got["groups"]]
                arrays = [batch.column(0).slice(first, len(some)), batch.column(1).slice(first, len(some))]
                arrays += [pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                arrays += [pa.array(digests, pa.string()), pairs_list(got["pair_cut"], ("pair", "n"), got["pair"], got["pair_n"])]
                names = ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
                if whole:
                    a, b = got["met"]
                    order = np.lexsort((b, a))
                    a, b = a[order], b[order]
                    doc = got["doc_of_a"][a]
                    cut = np.searchsorted(doc, np.arange(len(some) + 1))
                    arrays += [pa.array(got["groups"], pa.string()), pairs_list(cut, ("a", "b"), a - got["first_a"][doc], b - got["first_b"][doc])]
                    names += ["groups", "overlaps"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return picked.mapInArrow(work, schema)


def align_tokens(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: figures, the groups as text (``a1,a2|b1;a3|b2,b3``), distinct links (A id times B's
    vocabulary plus B id, and how often) and the numbers of overlapping tokens; one map."""
    return _aligned(df, path_a, path_b, id_col, text_col, True).drop("uid")


def alignment_counts(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: figures and digest, and its links weighed by how often the corpus links the same two
    ids. Frequent pairs are looked up by broadcast, the others by a shuffle."""
    spark = df.sparkSession
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    path = scratch_path(spark, "aligned")
    _aligned(df, path_a, path_b, id_col, text_col, False).write.parquet(path)
    docs = spark.read.parquet(path)
    links = docs.select("uid", F.explode("links").alias("l")).select("uid", "l.pair", "l.n")
    counted = scratch_path(spark, "pairs")
    links.groupBy("pair").agg(F.sum("n").alias("count")).write.parquet(counted)
    pairs = spark.read.parquet(counted).withColumn("b", F.col("pair") % size_b)
    best = pairs.groupBy("b").agg(F.max("count").alias("most"))
    judged = pairs.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    total = pairs.agg(F.sum("count")).first()[0] or 0
    weighed = look_up(links, judged, "pair", "count", total)
    sums = weighed.groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")
    )
    return docs.join(sums, "uid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )
