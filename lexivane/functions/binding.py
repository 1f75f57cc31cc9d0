"""Naming an intermediate result inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it several times inside one expression.

    As separate projections such steps would be copied into every filter that the
    optimizer pushes down through them, each copy repeating the whole computation.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
