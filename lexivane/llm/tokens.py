"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch that are not in the worker's cache are held as one flat symbol array
with a start per sequence. Each round finds the lowest-ranked pair of every sequence, merges
all its occurrences in all sequences at once, and retires sequences without a pair that can
be merged; the surviving symbols of a sequence are its tokens.

NULL and empty texts have no tokens. Strings of special tokens inside a text count as one
token each, as the library does by default. Other columns are left alone.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_WORDS = 500_000  # bound of a worker's memory of counted words; refilled when reached
BATCH_WORDS = 200_000  # bound of the words that are merged together
_NEVER = np.int64(1 << 40)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {}, 256
    for b in range(256):
        letters[b] = chr(b if b in shown else spare)
        spare += b not in shown
    return [letters[b] for b in range(256)]


class WordMerger:
    """Counts tokens of pre-tokens under one merge table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.letter_byte = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # in a hash table of open slots: one lookup costs one or two reads
        self.bits = int(np.ceil(np.log2(len(keys)))) + 2
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, _NEVER, np.int64)
        self.slot_made = np.zeros(1 << self.bits, np.int64)
        self.probes = 1
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):  # rounds of first come, first served
            free = self.slot_key[slot[left]] == -1
            winners, at = np.unique(slot[left[free]], return_index=True)
            chosen = left[free][at]
            self.slot_key[winners] = keys[chosen]
            self.slot_rank[winners] = chosen
            self.slot_made[winners] = made[chosen]
            left = np.setdiff1d(left, chosen)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache: dict[str, int] = {}
        self.path = path

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self._slot(keys)
        rank = np.full(len(keys), _NEVER, np.int64)
        made = np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.slot_key[slot[open_]]
            hit = found == keys[open_]
            rank[open_[hit]] = self.slot_rank[slot[open_[hit]]]
            made[open_[hit]] = self.slot_made[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return rank, made

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each (non-empty) word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        sym = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        counts = np.ones(len(words), np.int64)
        who = np.arange(len(words))
        last = np.zeros(len(sym), bool)
        last[ends - 1] = True
        rank = np.full(len(sym), _NEVER, np.int64)
        made = np.zeros(len(sym), np.int64)
        at = np.flatnonzero(~last)
        rank[at], made[at] = self._lookup(sym[at] * self.width + sym[at + 1])
        while len(who):
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(sym)))
            going = lowest < _NEVER
            counts[who[~going]] = lengths[~going]
            if not going.all():  # retire what cannot be merged any more
                stay = np.repeat(going, lengths)
                sym, rank, made, last = sym[stay], rank[stay], made[stay], last[stay]
                who, lengths, lowest = who[going], lengths[going], lowest[going]
                starts = np.cumsum(lengths) - lengths
                if not len(who):
                    break
            hit = rank == np.repeat(lowest, lengths)
            at = np.flatnonzero(hit)
            near = np.flatnonzero(np.diff(at) == 1)
            if len(near):  # a run such as aaa: every second pair from its left end
                opens = np.ones(len(at), bool)
                opens[near + 1] = False
                run_start = np.maximum.accumulate(np.where(opens, at, 0))
                at = at[(at - run_start) % 2 == 0]
            sym[at] = made[at]
            last[at] = last[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            removed = np.add.reduceat((~keep).astype(np.int64), starts)
            sym, rank, made, last = sym[keep], rank[keep], made[keep], last[keep]
            lengths = lengths - removed
            starts = np.cumsum(lengths) - lengths
            spot = place[at]
            rank[spot[last[spot]]] = _NEVER
            before = spot[spot > 0] - 1
            again = np.concatenate([spot[~last[spot]], before[~last[before]]])
            rank[again], made[again] = self._lookup(sym[again] * self.width + sym[again + 1])
        return counts

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def chunks(self, text: str) -> list[str]:
        """Runs without white space, lower case, of a text without special tokens; no
        pre-token crosses white space."""
        if text.isascii() or not _BEYOND(text) and unicodedata.is_normalized("NFC", text):
            if not _CONTROL(text):
                return text.lower().split()
            return _SPACE(text.lower())
        # scripts where case, normal forms or classes may depend on the library's tables
        return _SPACE(self.library.normalizer.normalize_str(text))

    def learn(self, chunks: list[str]) -> None:
        """Count chunks of which the cache has none."""
        for i in range(0, len(chunks), BATCH_WORDS):
            some = chunks[i : i + BATCH_WORDS]
            words = _WORDS("\n".join(some) + "\n")
            pieces = list(set(words) - {"\n"})
            tokens = dict(zip(pieces, self.merge([w.encode() for w in pieces]).tolist())) if pieces else {}
            tokens["\n"] = -1  # the end of a chunk
            each = np.fromiter(map(tokens.__getitem__, words), np.int64, len(words))
            ends = np.flatnonzero(each < 0)
            each[ends] = 0
            self.cache.update(zip(some, np.diff(np.cumsum(each)[ends], prepend=0).tolist()))

    def learn_beyond(self, chunks: list[str]) -> None:
        """The same where letter classes may depend on the library's tables."""
        for c in chunks:
            found = self.library.pre_tokenizer.pre_tokenize_str(c)
            words = [bytes(map(self.letter_byte.__getitem__, w)) for w, _ in found]
            self.cache[c] = int(self.merge(words).sum()) if words else 0

    def counts(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        held: list[tuple[int, list[str]]] = []
        unseen: set[str] = set()

        def settle() -> None:
            beyond = list(filter(_BEYOND, unseen))
            self.learn_beyond(beyond)
            self.learn(list(unseen.difference(beyond)))
            unseen.clear()
            known = self.cache.__getitem__
            out.extend(extra + sum(map(known, words)) for extra, words in held)
            held.clear()
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()

        size = 0
        for text in texts:
            extra, words = 0, []
            if text:
                if self.special_re is not None and "<|" in text:
                    parts = self.special_re.split(text)
                    extra = len(parts) - 1
                    for part in parts:
                        words += self.chunks(part)
                else:
                    words = self.chunks(text)
            unseen |= set(words).difference(self.cache)
            held.append((extra, words))
            size += len(words)
            if size > BATCH_WORDS:
                settle()
                size = 0
        settle()
        return out


# The vocabulary's pre-token pattern (white space as Unicode defines it), and
# the line feed between chunks.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|\n|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}]+").findall
_BEYOND = re.compile("[^\\x00-\\u024f]").search
_CONTROL = re.compile("[\\x1c-\\x1f]").search
_SPACE = regex.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").findall


@functools.lru_cache(maxsize=2)
def merger(path: str) -> WordMerger:
    """One per worker process and vocabulary."""
    return WordMerger(path)


def n_tokens(text: str | Column, path: str) -> Column:
    """Tokens of each text under the vocabulary file ``path`` (a byte-level BPE with word ends)."""

    @F.arrow_udf(T.LongType())
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(merger(path).counts(texts.to_pylist()), pa.int64())

    return counted(text)


def count_tokens(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens, whether they exceed ``limit``; one map, no shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = df.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, path).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


