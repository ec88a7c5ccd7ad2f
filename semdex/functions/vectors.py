"""Vector algebra on ``array<float|double>`` columns (V1, V2, V3).

Everything here is a Catalyst expression (higher-order functions), so it runs
inside the JVM next to the scan. Derived quantities that feed a lambda (a
norm used to scale every element) are materialised as a column first: a
lambda that references an outer expression would re-evaluate it per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Sum of element products in double precision, left to right."""
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def sumsq(a) -> Column:
    return F.aggregate(_col(a), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm(a) -> Column:
    return F.sqrt(sumsq(a))


def scale(a, factor_col: str) -> Column:
    """Multiply every element by a scalar *column* (materialise it first)."""
    return F.transform(_col(a), lambda x: x.cast("double") * F.col(factor_col))


def with_l2_normalized(df: DataFrame, vec: str, out: str | None = None) -> DataFrame:
    """V1: ``vec / ||vec||``; a zero vector stays zero (sklearn ``normalize``)."""
    out = out or vec
    tmp = f"__{out}_norm"
    return (df.withColumn(tmp, norm(vec))
              .withColumn(out, F.transform(F.col(vec), lambda x: x.cast("double") /
                                           F.when(F.col(tmp) == 0, F.lit(1.0)).otherwise(F.col(tmp))))
              .drop(tmp))


def cosine_from_parts(dot_col, na_col, nb_col, zero_value=0.0) -> Column:
    """V2 with the sklearn rule: cosine is ``zero_value`` when a norm is 0."""
    den = _col(na_col) * _col(nb_col)
    return F.when(den == 0, F.lit(zero_value)).otherwise(_col(dot_col) / den)
