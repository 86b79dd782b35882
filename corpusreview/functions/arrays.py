"""Rows out of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def rows_of(df: DataFrame, keys, structs: Column, required: str) -> DataFrame:
    """One row per struct of an array column; ``required`` is a field that is never NULL.

    The outer form is used on purpose: for the inner one the optimizer adds a ``size(array) > 0`` filter and pushes it
    below the projection, which would compute the whole array twice.
    """
    return df.select(*keys, F.inline_outer(structs)).filter(F.col(required).isNotNull())


def computed_once(df: DataFrame, keys, **columns: Column) -> DataFrame:
    """``keys`` and ``columns``, such that later filters read the finished columns.

    A filter is normally pushed below a projection by copying the column's expression into it, so a dear column would be
    computed for the filter and again for the result.  Filters are not pushed below a generator.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keys, F.inline_outer(F.array(row)))


def numbered_rows(df: DataFrame, keys, values: Column, name: str, number: str = "seq") -> DataFrame:
    """One row per array element with its 1-based ``number``."""
    rows = df.select(*keys, F.posexplode_outer(values).alias("_pos", name)).filter(F.col("_pos").isNotNull())
    return rows.select(*keys, (F.col("_pos") + 1).alias(number), name)
