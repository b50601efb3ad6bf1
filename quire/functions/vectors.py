"""Vector arithmetic on arrays, accumulated in double precision."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a.cast("array<float>"))


def literal(vector: Sequence[float]) -> Column:
    """A vector as one literal, parsed at once."""
    each = [float(x) for x in vector]
    return F.expr(f"array({', '.join(f'{x!r}D' if math.isfinite(x) else f'double({str(x)!r})' for x in each)})" if each else "cast(array() as array<double>)")
