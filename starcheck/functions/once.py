"""Columns that are computed exactly once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator.

    A later filter on a plain computed column is pushed down with the whole expression in it,
    once per reference, so a chain of such columns is worked out again and again. The optimizer
    leaves a filter on generated columns above the generator.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(row)))
