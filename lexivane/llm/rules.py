"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per text; the ledger stores one bit per failed rule together
with the measurements behind it. A policy is a named, versioned choice of rules (a mask), so
policies are applied, compared and ablated on the ledger without reading a text again.

NULL and empty texts have no words and fail ``few_words`` only. Repeated rows are judged row
by row; NULL ids stay NULL. Only the id and the text are read, whatever other columns there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.ragged import Block, blocks, mix, windows

# name -> failing condition over the measurements, in integers so that every engine agrees
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 2 * n_words",
    "shouting": "10 * n_upper_words > 4 * n_words",
    "repeated_lines": "10 * n_dup_lines > 5 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)",
    "few_letters": "10 * n_letter_words < 7 * n_words",
}
BASE_RULES = ("few_words", "repeated_windows")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_letter_words")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[97:123] = 1
_LETTER = _UPPER + _LOWER
_LETTER[128:] = 1
_POINT = np.ones(256, np.int64)
_POINT[128:192] = 0


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules."""

    version: str
    rules: tuple[str, ...] = tuple(RULES)

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE_POLICY = Policy("base", BASE_RULES)
DEFAULT_POLICY = Policy("v1")


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each text."""
    _, at = np.unique(keys + mix(owner.astype(np.uint64)), return_index=True)
    return np.bincount(owner[at], minlength=n)


def measure(block: Block) -> dict[str, np.ndarray]:
    """All measurements of each text of a block."""
    n, buf = len(block), block.buf
    s, e, first = block.words()
    owner = np.repeat(np.arange(n), np.diff(first))

    def spread(table: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(table[buf])])

    points, upper, lower, letters, symbols = map(spread, (_POINT, _UPPER, _LOWER, _LETTER, _SYMBOL))
    ls, le, line_first = block.lines()
    worded = np.searchsorted(s, le) > np.searchsorted(s, ls)
    line_owner = np.repeat(np.arange(n), np.diff(line_first))[worded]
    n_lines = np.bincount(line_owner, minlength=n)
    grams, at = windows(block.hashes(s, e), first, 3)
    covered = np.zeros(len(s) + 1, np.int64)
    if len(grams):
        _, which, times = np.unique(grams + mix(owner[at].astype(np.uint64)), return_inverse=True, return_counts=True)
        again = at[times[which] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + 3, -1)
    repeated = np.cumsum(covered)[:-1] > 0

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=flags, minlength=n).astype(np.int64)

    return {
        "n_words": np.diff(first),
        "word_chars": per_text(points[e] - points[s]),
        "n_symbols": symbols[block.ends] - symbols[block.starts],
        "n_dup_lines": n_lines - _distinct(block.hashes(ls[worded], le[worded]), line_owner, n),
        "n_repeat_words": per_text(repeated),
        "n_lines": n_lines,
        "n_upper_words": per_text((upper[e] - upper[s] > 1) & (lower[e] == lower[s])),
        "n_letter_words": per_text(letters[e] > letters[s]),
    }


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measured(texts: pa.Array) -> pa.Array:
    parts = [measure(b) for b in blocks(texts)]
    columns = [np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64) for m in MEASURES]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))


def rule_bits() -> Column:
    """Failure bits from columns named as the measurements; bit i is rule i."""
    return F.expr(" + ".join(f"CASE WHEN {test} THEN {1 << i}L ELSE 0L END" for i, test in enumerate(RULES.values())))


def rule_ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, measurements, failure bits. One map, no shuffle."""
    measured = df.select(F.col(id_col).alias("doc_id"), _measured(F.col(text_col).cast("string")).alias("m"))
    return measured.select("doc_id", "m.*").withColumn("fail_bits", rule_bits())


def passes(policy: Policy, bits: str | Column = "fail_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(ledger: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to a ledger."""
    return ledger.withColumn("base_failed", ~passes(BASE_POLICY)).withColumn(
        "kept", ~F.col("base_failed") & passes(policy)
    )


def ablate(ledger: DataFrame, policies: list[Policy]) -> DataFrame:
    """Per policy and rule: rows failing it, rows that only this rule rejects, and rows the
    policy rejects in all. The ledger is reduced to its distinct bit patterns first."""
    spark = ledger.sparkSession
    patterns = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    names = list(RULES)
    chosen = spark.createDataFrame(
        [(p.version, p.mask, r, 1 << names.index(r)) for p in policies for r in p.rules],
        "policy string, mask long, rule string, bit long",
    )
    bits, mask, bit = F.col("fail_bits"), F.col("mask"), F.col("bit")
    counted = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias
    hit = bits.bitwiseAND(mask) != 0
    return (
        F.broadcast(chosen)
        .join(patterns, hit, "left")
        .groupBy("policy", "rule")
        .agg(
            counted(bits.bitwiseAND(bit) != 0)("n_failed"),
            counted(bits.bitwiseAND(mask) == bit)("n_only"),
            counted(hit)("n_rejected"),
        )
    )


def keep_good(df: DataFrame, policy: Policy = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that the policy and the base rules keep."""
    m = _measured(F.col(text_col).cast("string"))
    name = "_measured"
    while name in df.columns:
        name += "_"
    both = Policy("both", tuple(r for r in RULES if r in (*BASE_RULES, *policy.rules)))
    bits = [F.expr(_on(test, name)).cast("long") * F.lit(1 << i) for i, test in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return df.withColumn(name, m).filter(passes(both, total)).drop(name)


def _on(test: str, struct: str) -> str:
    """A rule's condition over the fields of a struct column."""
    for x in MEASURES:
        test = test.replace(x, f"`{struct}`.{x}")
    return test
