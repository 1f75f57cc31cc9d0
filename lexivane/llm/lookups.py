"""Looking up facts of very frequent and of rare keys without a hot task or an unbounded broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 16


def is_hot(weight: str | Column, total: int, slots: int = SLOTS) -> Column:
    """Whether a key has at least its ``slots``-th share of the total weight: at most ``slots``
    keys can have one, at any size of the data."""
    return (F.col(weight) if isinstance(weight, str) else weight) * slots >= F.lit(total)


def look_up(uses: DataFrame, facts: DataFrame, key: str, weight: str, total: int, slots: int = SLOTS) -> DataFrame:
    """Each row of ``uses`` with the columns of ``facts`` (one row per key; ``weight`` adds up to
    ``total`` there). Hot keys are met where the rows are, the others after a shuffle in which no
    key has more than its ``slots``-th share of the weight."""
    hot = facts.where(is_hot(weight, total, slots))
    near = uses.join(F.broadcast(hot), key)
    far = uses.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(~is_hot(weight, total, slots)), key)
    return near.unionByName(far)
