"""Small shared helpers for column code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(v: Column | str | int | float) -> Column:
    """A column from a column, a column name or a plain number."""
    return F.lit(v) if isinstance(v, (int, float)) else col(v)


def clip(v: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(v, num(low)), num(high))


def blank_to_null(c: ColumnOrName) -> Column:
    """Trimmed text, NULL when nothing is left."""
    t = F.trim(col(c))
    return F.when(t != "", t)


def first_non_empty(*cols: ColumnOrName) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def prefer_existing(old: ColumnOrName, new: ColumnOrName) -> Column:
    """The old value unless it is blank; then the new one, or empty text."""
    o = col(old)
    return F.coalesce(F.when(F.trim(o) != "", o), col(new), F.lit(""))


def staged(df: DataFrame, *layers: dict[str, Column]) -> DataFrame:
    """Apply column layers in turn; helper columns (``__`` prefix) of all layers
    but the last are dropped.

    A value used by later formulas is computed once per row: the optimizer does
    not merge a projection whose costly result is read more than once.
    """
    temp: list[str] = []
    for layer in layers:
        df = df.withColumns(layer)
        temp += [n for n in layer if n.startswith("__")]
    return df.drop(*[n for n in temp if n not in layers[-1]])


def let(value: Column, body) -> Column:
    """Bind a value once for a higher-order expression that reads it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def beside_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Each row with the columns of a table that has exactly one row (a total)."""
    key = F.lit(1)
    return df.withColumn("__one", key).join(F.broadcast(one.withColumn("__one", key)), "__one").drop("__one")
