"""Columns that the optimizer must not repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with columns that are computed once: a generator keeps the optimizer from repeating their
    expressions wherever later columns and filters use them."""
    once = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("_once")
    return df.select("*", once).select("*", "_once.*").drop("_once")
