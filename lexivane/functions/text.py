"""Text composition and stable hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lead-ins of the embedded document and of a query.
DOCUMENT_TEMPLATE = "receita de {name}. ingredientes: {ingredients}. modo de preparo: {instructions}"
QUERY_PREFIX = "receita de "


def filled(name: str | Column) -> Column:
    """Missing text counts as empty text."""
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))


def compose(template: str, columns: dict[str, str | Column] | None = None) -> Column:
    """Fill ``{slot}`` marks from columns (by default the column of that name)."""
    columns = columns or {}
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        literal, _, tail = rest.partition("{")
        slot, _, rest = tail.partition("}")
        if literal:
            parts.append(F.lit(literal))
        parts.append(filled(columns.get(slot, slot)))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def hash_percent(key: str | Column) -> Column:
    """0..99 from the md5 of a key: stable across runs, partitionings and engines."""
    key = F.col(key) if isinstance(key, str) else key
    prefix = F.substring(F.md5(key.cast("string").cast("binary")), 1, 8)
    return F.conv(prefix, 16, 10).cast("long") % 100
