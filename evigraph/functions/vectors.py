"""Vector functions as columns, computed in double precision."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.functions.text import ColumnLike, col


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    """Scalar product over the shorter of two vectors."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    products = F.zip_with(F.slice(col(a), F.lit(1), n), F.slice(col(b), F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: ColumnLike) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    """Cosine similarity; 0 if either norm is 0 (B13); 1 minus it is the distance."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def literal(a: ColumnLike) -> Column:
    """'[x,y]' with eight decimals, null elements left out.

    Decimals are rounded from the number's exact value, ties to even, as C does; Java's
    formats round its shortest digits instead, ties up.
    """

    @F.arrow_udf("string")
    def text(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else "[" + ",".join(["%.8f" % y for y in x if y is not None]) + "]" for x in v.to_pylist()], pa.string())

    return text(col(a).cast("array<double>"))
