"""Small models for Arrow kernels: every partition's first row carries them, the other rows carry null.

A model of bounded size (weights of a fixed width, a schedule of T steps) is one row of a DataFrame.  As a
scalar subquery it is computed once by Spark; here it is attached to the first row of every partition only, so a
kernel reads it there once per task, no row repeats it, and nothing passes through the Python driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROW_IN_PARTITION = (1 << 33) - 1           # low bits of monotonically_increasing_id


def first_row_only(df: DataFrame, *columns: str) -> DataFrame:
    """Null the columns but in every partition's first row."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_PARTITION)) == 0
    marked = df.withColumn("_first_row", first)
    return marked.select(*[F.when(F.col("_first_row"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def with_model(df: DataFrame, **models: DataFrame) -> DataFrame:
    """Add one column per model (a DataFrame of one row and one column); non-null in a partition's first row only.

    Pass the result straight to ``mapInArrow`` / ``mapInPandas``: a filter or shuffle in between may drop the row.
    """
    return first_row_only(df.withColumns({n: m.scalar() for n, m in models.items()}), *models)
