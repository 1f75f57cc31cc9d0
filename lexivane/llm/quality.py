"""Quality classifier: a factorisation machine over words, structure and metadata.

The features of a text are its hashed words (log counts of length 1 together) and standardised
figures about its structure and size. The machine adds a linear part and the low-rank pairwise
interactions of all features, scored in linear time: the sum over pairs of ``<v_i, v_j> x_i x_j`` is half
of ``(sum v_i x_i)^2 - sum (v_i x_i)^2``, summed over the ranks.

It is fitted on a bounded sample of the labelled rows, chosen by hash of the id. Labels that
are NULL or contradict each other for one id are left out. NULL and empty texts are scored by
the intercept and the figures of an empty text. With labels of one kind every score is that
label, with none it is 0.5. Repeated rows and NULL ids are scored row by row. Labels,
language, source and id are no inputs of a score.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.langid import held_out
from lexivane.llm.ragged import Block, blocks
from lexivane.llm.rules import measure

BUCKETS = 1 << 14
RANK = 8
SAMPLE_ROWS = 6000  # bound of the labelled rows that the machine is fitted on
SAMPLE_VALUES = 4_000_000  # and of their feature values together
FIGURES = 12
THRESHOLD = 0.3


def figures(block: Block, distinct: np.ndarray) -> np.ndarray:
    """Structure and size of each text, one row of ``FIGURES`` numbers."""
    m = measure(block)
    words, lines = np.maximum(1, m["n_words"]), np.maximum(1, m["n_lines"])
    size = block.ends - block.starts
    high = np.concatenate([[0], np.cumsum(block.buf >= 128)])
    return np.stack(
        [
            np.log1p(m["n_words"]),
            m["word_chars"] / words,
            np.log1p(m["n_symbols"] / words),
            m["n_dup_lines"] / lines,
            m["n_repeat_words"] / words,
            m["n_upper_words"] / words,
            m["n_letter_words"] / words,
            distinct / words,
            np.log1p(m["n_lines"]),
            np.log1p(m["n_words"] / lines),
            np.log1p(size),
            (high[block.ends] - high[block.starts]) / np.maximum(1, size),
        ],
        axis=1,
    )


class Rows(NamedTuple):
    """Features of some texts: flat (row, bucket, value), and the figures."""

    row: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    figures: np.ndarray


def featurize(block: Block) -> Rows:
    s, e, first = block.words()
    owner = np.repeat(np.arange(len(block)), np.diff(first))
    bucket = (block.hashes(s, e, folded=True) & np.uint64(BUCKETS - 1)).astype(np.int64)
    key, times = np.unique(owner * BUCKETS + bucket, return_counts=True)
    row, bucket = key // BUCKETS, key % BUCKETS
    value = 1 + np.log(times)
    norm = np.sqrt(np.bincount(row, value * value, len(block)))
    return Rows(row, bucket, value / norm[row], figures(block, np.bincount(row, minlength=len(block))))


class FactorisationMachine(NamedTuple):
    bias: float
    linear: np.ndarray  # buckets, then figures
    factors: np.ndarray  # the same x rank
    mean: np.ndarray
    scale: np.ndarray

    def score(self, rows: Rows) -> np.ndarray:
        """Chance of label 1 of each row."""
        n = len(rows.figures)
        dense = standard(rows.figures, self.mean, self.scale)
        raw = self.bias + np.bincount(rows.row, rows.value * self.linear[rows.bucket], n) + dense @ self.linear[BUCKETS:]
        for f in range(self.factors.shape[1]):
            v = self.factors[:, f]
            part = rows.value * v[rows.bucket]
            inner = dense * v[BUCKETS:]
            total = np.bincount(rows.row, part, n) + inner.sum(axis=1)
            squares = np.bincount(rows.row, part * part, n) + (inner * inner).sum(axis=1)
            raw = raw + 0.5 * (total * total - squares)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -4, 4) / 2


def fit(
    rows: Rows, label: np.ndarray, rank: int = RANK, epochs: int = 12, batch: int = 64, rate: float = 0.1, l2: float = 1e-4, seed: int = 5
) -> FactorisationMachine:
    """By AdaGrad on the log loss."""
    n = len(label)
    mean, scale = rows.figures.mean(axis=0), rows.figures.std(axis=0) + 1e-6
    dense = standard(rows.figures, mean, scale)
    order = np.argsort(rows.row, kind="stable")
    cuts = np.searchsorted(rows.row[order], np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(BUCKETS + FIGURES), rng.normal(0, 0.05, (BUCKETS + FIGURES, rank))
    share = np.clip(label.mean(), 0.01, 0.99)
    bias = float(np.log(share / (1 - share)))
    seen_w, seen_v, seen_b = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    for _ in range(epochs):
        shuffled = rng.permutation(n)
        for start in range(0, n, batch):
            some = shuffled[start : start + batch]
            at = np.concatenate([order[cuts[i] : cuts[i + 1]] for i in some.tolist()])
            k = len(some)
            who = np.concatenate([np.repeat(np.arange(k), cuts[some + 1] - cuts[some]), np.repeat(np.arange(k), FIGURES)])
            feature = np.concatenate([rows.bucket[at], np.tile(np.arange(BUCKETS, BUCKETS + FIGURES), k)])
            x = np.concatenate([rows.value[at], dense[some].ravel()])
            used, spot = np.unique(feature, return_inverse=True)
            vx = v[feature] * x[:, None]
            total = np.zeros((k, rank))
            np.add.at(total, who, vx)
            squares = np.zeros((k, rank))
            np.add.at(squares, who, vx * vx)
            raw = bias + np.bincount(who, w[feature] * x, k) + 0.5 * (total * total - squares).sum(axis=1)
            slope = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - label[some]) / k
            gw = np.bincount(spot, slope[who] * x, len(used)) + l2 * w[used]
            gv = np.zeros((len(used), rank))
            np.add.at(gv, spot, (slope[who] * x)[:, None] * (total[who] - vx))
            gv += l2 * v[used]
            gb = slope.sum()
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            seen_b += gb * gb
            w[used] -= rate * gw / np.sqrt(seen_w[used])
            v[used] -= rate * gv / np.sqrt(seen_v[used])
            bias -= rate * gb / np.sqrt(seen_b)
    return FactorisationMachine(bias, w, v, mean, scale)


def _features() -> T.StructType:
    return T.StructType(
        [
            T.StructField("b", T.ArrayType(T.IntegerType())),
            T.StructField("v", T.ArrayType(T.FloatType())),
            T.StructField("d", T.ArrayType(T.DoubleType())),
        ]
    )


@F.arrow_udf(_features())
def _featurized(texts: pa.Array) -> pa.Array:
    b, v, d = [], [], []
    for block in blocks(texts):
        rows = featurize(block)
        cuts = np.searchsorted(rows.row, np.arange(1, len(block)))
        b += np.split(rows.bucket.astype(np.int32), cuts)
        v += np.split(rows.value.astype(np.float32), cuts)
        d += list(rows.figures)
    return pa.StructArray.from_arrays(
        [pa.array(b, pa.list_(pa.int32())), pa.array(v, pa.list_(pa.float32())), pa.array(d, pa.list_(pa.float64()))], ["b", "v", "d"]
    )


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows: int = SAMPLE_ROWS,
    values: int = SAMPLE_VALUES,
) -> FactorisationMachine | float:
    """From the rows whose id has a label (0 or 1); the constant score if one kind is missing."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")
    )
    n = marks.count()
    share = min(1.0, (2 * rows + 100) / max(1, n))  # a range of hashes that holds enough ids
    marks = marks.withColumn("h", F.xxhash64("i", F.lit(9))).filter(F.col("h") <= int(-(1 << 63) + share * ((1 << 64) - 1025)))
    agreed = marks.groupBy("i", "h").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z")
    chosen = agreed.orderBy("h", "i").limit(rows)
    text = F.col(text_col).cast("string")
    found = docs.select(F.col(id_col).alias("i"), text.alias("x")).join(F.broadcast(chosen), "i")
    # repeated ids may bring more rows than labels
    found = found.select("y", F.xxhash64("i", "x").alias("h"), "x").orderBy("h", "y").limit(rows).select("h", "y", _featurized("x").alias("f"))
    # the bound on values holds before anything is collected; the first text is always taken
    size = F.size("f.b")
    found = found.withColumn("used", F.sum(size).over(W.orderBy("h", "y"))).filter((F.col("used") <= values) | (F.col("used") == size))
    table = found.orderBy("h", "y").toArrow()
    sizes, label, parts = [], [], []
    for y, f in zip(table["y"].to_pylist(), table["f"].combine_chunks() if table.num_rows else []):
        b = f["b"].values.to_numpy(zero_copy_only=False)
        sizes.append(len(b))
        label.append(y)
        parts.append((b, f["v"].values.to_numpy(zero_copy_only=False), f["d"].values.to_numpy(zero_copy_only=False)))
    if not label:
        return 0.5
    y = np.array(label, float)
    if y.min() == y.max():
        return float(y[0])
    flat = Rows(
        np.repeat(np.arange(len(sizes)), sizes),
        np.concatenate([b for b, _, _ in parts]).astype(np.int64),
        np.concatenate([v for _, v, _ in parts]).astype(float),
        np.array([d for _, _, d in parts]),
    )
    return fit(flat, y)


def quality_score(df: DataFrame, model: FactorisationMachine | float, text_col: str = "text") -> Column:
    """Chance of label 1 of each row of ``df``."""
    if isinstance(model, float):
        return F.lit(model)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        parts = [shared.value.score(featurize(b)) for b in blocks(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return scored(F.col(text_col).cast("string"))


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fold: int = 0
) -> DataFrame:
    """Train on labelled rows of all but one fold, score all: doc_id, held_out, score, predicted."""
    out = held_out(id_col, folds, fold)
    model = train(docs.filter(~out), labels.filter(~out), id_col, text_col, label_col)
    judged = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), quality_score(docs, model, text_col).alias("score"))
    return judged.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
