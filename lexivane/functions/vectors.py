"""Vector arithmetic on array columns, evaluated inside the JVM in doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vec_literal(values: Sequence[float]) -> Column:
    """A constant vector (model weights, a query); its size is set by the caller."""
    return F.lit([float(v) for v in values])


def vec_dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Sum of products. Vectors of unequal length give NULL."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def vec_norm(a: ColumnOrName) -> Column:
    squares = F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def vec_sqdist(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Squared Euclidean distance."""
    squares = F.zip_with(
        _col(a),
        _col(b),
        lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")),
    )
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def vec_cosine(
    a: ColumnOrName,
    b: ColumnOrName,
    norm_a: ColumnOrName | None = None,
    norm_b: ColumnOrName | None = None,
) -> Column:
    """Cosine similarity; NULL when a vector has no length. Stored norms are reused."""
    na = vec_norm(a) if norm_a is None else _col(norm_a)
    nb = vec_norm(b) if norm_b is None else _col(norm_b)
    return F.try_divide(vec_dot(a, b), na * nb)


def gaussian_noise(key: ColumnOrName, position: Column, seed: int) -> Column:
    """Standard normal draw that depends only on (key, position, seed).

    Box-Muller over two hashes, so a retried task or another partitioning gives the
    same noise, which ``randn`` does not.
    """
    resolution = 2**52

    def uniform(salt: int) -> Column:
        bits = F.pmod(F.xxhash64(_col(key), position, F.lit(seed), F.lit(salt)), F.lit(resolution))
        return (bits + F.lit(0.5)) / F.lit(float(resolution))

    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(1)))
    return radius * F.cos(F.lit(2.0) * F.pi() * uniform(2))
