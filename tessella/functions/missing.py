"""Missing-value normalisation: NaN, +inf and -inf become NULL at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(c: Column | str) -> Column:
    """NULL for NaN and both infinities, else the value.

    Spark orders NaN above every number, so a comparison on an uncleaned column
    would take NaN for a very large value.
    """
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clean_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: clean(c) for c in columns})
