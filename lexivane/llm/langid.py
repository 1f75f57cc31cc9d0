"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (one to three code points, ASCII
letters folded), each text of length 1. Document frequencies are counted over all rows that
may be learned from. The weights are fitted on a bounded sample of them, with the same quota for
every language, so that rare ones stay learnable at any size (of more languages than the sample
has rows, those whose first text has the least hash), by follow-the-regularised-leader with
elastic-net penalties, which sets most weights to zero; a temperature is then fitted on rows of
the sample that the weights have not seen.

The prediction of a text that is NULL or has no letter is ``und`` with score 0, and so is
every prediction if there is nothing to learn from. With one language that one is predicted.
Rows with NULL language are not learned from. Repeated rows count as often as they occur;
NULL ids are predicted like others. Only the text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.ragged import blocks

BUCKETS = 1 << 14
GRAMS = (1, 2, 3)
SAMPLE_ROWS = 4000  # bound of the rows that weights and temperature are fitted on
SAMPLE_VALUES = 6_000_000  # and of their feature values together
BROADCAST_LANGUAGES = 100_000  # names and numbers of rows that are broadcast at most
UNKNOWN = "und"
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 2e-3, 1e-3, 3


def counts(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, how often) of the n-grams of each text, buckets ascending."""
    for block in blocks(texts):
        starts = np.flatnonzero((block.buf & 0xC0) != 0x80)
        points = np.append(starts, len(block.buf))
        lo, hi = np.searchsorted(starts, block.starts), np.searchsorted(starts, block.ends)
        grams = []
        for n in GRAMS:
            s, e = points[: max(0, len(points) - n)], points[n:]
            grams.append((block.hashes(s, e, folded=True) & np.uint64(BUCKETS - 1)).astype(np.int64))
        for a, b in zip(lo.tolist(), hi.tolist()):
            own = np.concatenate([g[a : max(a, b - n + 1)] for n, g in zip(GRAMS, grams)])
            if len(own) < BUCKETS // 32:
                yield np.unique(own, return_counts=True)
            else:
                every = np.bincount(own, minlength=BUCKETS)
                some = np.flatnonzero(every)
                yield some, every[some]


def weigh(buckets: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(times)) * idf[buckets]
    norm = np.sqrt((value * value).sum())
    return value / norm if norm else value


class LanguageModel(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages, mostly zero
    bias: np.ndarray
    temperature: float

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        raw = []
        for b, t in counts(texts):
            raw.append(weigh(b, t, self.idf) @ self.weights[b] + self.bias)
        chance = softmax(np.array(raw).reshape(len(raw), len(self.languages)) / self.temperature)
        best = chance.argmax(axis=1) if len(raw) else np.zeros(0, int)
        return [self.languages[i] for i in best.tolist()], chance.max(axis=1, initial=0.0)


def softmax(raw: np.ndarray) -> np.ndarray:
    up = np.exp(raw - raw.max(axis=-1, keepdims=True))
    return up / up.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, n_labels: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts by per-coordinate FTRL, one row a step, classes weighing alike."""
    z, n = np.zeros((BUCKETS + 1, n_labels)), np.zeros((BUCKETS + 1, n_labels))
    share = len(label) / (n_labels * np.maximum(1, np.bincount(label, minlength=n_labels)))

    def current(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)).tolist():
            at, value = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)
            w = current(at)
            slope = softmax(value @ w)
            slope[label[i]] -= 1
            g = value[:, None] * (slope * share[label[i]])[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    every = current(np.arange(BUCKETS + 1))
    return every[:-1], every[-1]


def fit_temperature(raw: np.ndarray, label: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    def loss(log_t: float) -> float:
        return -np.log(np.maximum(1e-12, softmax(raw / np.exp(log_t))[np.arange(len(label)), label])).mean()

    a, b, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(df: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """(texts, texts with each bucket). A task sends one row per bucket at most."""
    out = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)  # the last one counts the texts
        for batch in batches:
            for b, _ in counts(batch.column(0)):
                total[b] += 1
                total[-1] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=out.names)

    summed = df.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, out).groupBy("bucket").agg(F.sum("n").alias("n"))
    table = summed.toArrow()
    total = np.zeros(BUCKETS + 1, np.int64)
    total[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return int(total[-1]), total[:-1]


def _sample(df: DataFrame, text_col: str, lang_col: str, rows: int, values: int) -> tuple[list, list[str]]:
    """Features and language of distinct texts, those of each language with the least hashes."""
    features = T.StructType(
        [T.StructField("b", T.ArrayType(T.IntegerType())), T.StructField("t", T.ArrayType(T.IntegerType()))]
    )

    @F.arrow_udf(features)
    def counted(texts: pa.Array) -> pa.Array:
        pairs = list(counts(texts))
        return pa.StructArray.from_arrays(
            [pa.array([b for b, _ in pairs], pa.list_(pa.int32())), pa.array([t for _, t in pairs], pa.list_(pa.int32()))], ["b", "t"]
        )

    text = F.col(text_col).cast("string")
    some = df.select(text.alias("x"), F.col(lang_col).cast("string").alias("l"), F.xxhash64(text, F.lit(5)).alias("o"))
    # every language has the same quota, so none vanishes among many rows of others
    by_lang = some.groupBy("l").agg(F.count("*").alias("n"))
    n_langs = by_lang.count()
    quota = max(1, rows // max(1, n_langs))
    by_lang = F.broadcast(by_lang) if n_langs <= BROADCAST_LANGUAGES else by_lang  # the texts stay where they are
    share = F.least(F.lit(1.0), F.lit(2.0 * quota + 100) / F.col("n"))  # a range of hashes that holds enough rows
    some = some.join(by_lang, "l").filter(F.col("o") <= (share * float((1 << 64) - 4096) - float(1 << 63)).cast("long"))
    some = some.select("x", "l", "o").dropDuplicates(["o", "l"])
    some = some.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("o"))).filter(F.col("r") <= quota)
    some = some.orderBy("r", "o", "l").limit(rows).select("l", "o", "r", counted("x").alias("f"))
    # the bound on values holds before anything is collected; the first text is always taken
    size = F.size("f.b")
    some = some.withColumn("used", F.sum(size).over(W.orderBy("r", "o", "l"))).filter((F.col("used") <= values) | (F.col("used") == size))
    kept, langs = [], []
    for batch in some.orderBy("r", "o", "l").toArrow().to_batches():
        for lang, f in zip(batch["l"].to_pylist(), batch["f"]):
            kept.append((f["b"].values.to_numpy(zero_copy_only=False).astype(np.int64), f["t"].values.to_numpy(zero_copy_only=False)))
            langs.append(lang)
    return kept, langs


def train(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, values: int = SAMPLE_VALUES
) -> LanguageModel | None:
    """From rows with text and language; None if there are none."""
    usable = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    n, frequency = document_frequencies(usable, text_col)
    found, langs = _sample(usable, text_col, lang_col, rows, values)
    if not found:
        return None
    languages = sorted(set(langs))
    idf = np.log((1 + n) / (1 + frequency)) + 1
    label = np.array([languages.index(x) for x in langs])
    vectors = [(b, weigh(b, t, idf)) for b, t in found]
    unseen = np.arange(len(found)) % 5 == 4
    seen = np.flatnonzero(~unseen)
    weights, bias = fit_ftrl([vectors[i] for i in seen.tolist()], label[seen], len(languages))
    check = np.flatnonzero(unseen)
    temperature = 1.0
    if len(check):
        raw = np.array([vectors[i][1] @ weights[vectors[i][0]] + bias for i in check.tolist()])
        temperature = fit_temperature(raw, label[check])
    return LanguageModel(languages, idf, weights, bias, temperature)


def predict(df: DataFrame, model: LanguageModel | None, text_col: str = "text") -> Column:
    """Struct (lang, score) for each row of ``df``."""
    out = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(out)
    def predicted(texts: pa.Array) -> pa.Array:
        langs, scores = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    text = F.col(text_col).cast("string")
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return none
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\p{L}"), predicted(text)).otherwise(none)


def held_out(id_col: str, of: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves a remainder; false for NULL."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == remainder, F.lit(False))


def identify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2
) -> DataFrame:
    """Train on all but one fold, predict all rows: doc_id, held_out, lang_pred, score."""
    out = held_out(id_col, folds, fold)
    model = train(df.filter(~out), text_col, lang_col)
    judged = df.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), predict(df, model, text_col).alias("p"))
    return judged.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
