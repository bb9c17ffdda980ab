"""Rounding of computed doubles by one formula in both engines, so that ties fall alike and other orders of summing agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_up(value: Column, places: int) -> Column:
    return F.floor(value * float(10**places) + 0.5) / float(10**places)


def half_up_sql(value: str, places: int) -> str:
    return f"floor(({value})::double * 1e{places} + 0.5) / 1e{places}"


def rounded(df: DataFrame, places: int = 5) -> DataFrame:
    """Double columns rounded, and without a negative zero."""
    return df.select(*[half_up(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(*names: str, places: int = 5) -> str:
    """Columns rounded as ``rounded`` does, under their names."""
    return ", ".join(f"{half_up_sql(n, places)} as {n}" for n in names)
