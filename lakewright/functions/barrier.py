"""A guard against repeated evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hold(df: DataFrame, *columns: Column) -> DataFrame:
    """Adds columns that are computed once per row, whatever is built on them.

    A generator of one row: unlike a projection the optimizer doesn't paste its expressions into each of their uses, nor into
    filters that it moves down.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))
