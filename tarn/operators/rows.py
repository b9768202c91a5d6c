"""Fan a row out, aggregate what comes back, keep the row: in one pass over the input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_row(df: DataFrame, fan: Callable[[DataFrame], DataFrame], **found: Column) -> DataFrame:
    """``df`` with the columns ``found``, aggregates over the rows that ``fan`` makes of each row.

    Rows get an id that is read once; joining a second reading of the frame to it would not be safe, as ids follow
    the order in which a plan happens to give rows.
    """
    keyed = df.select("*", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_r"), F.monotonically_increasing_id().alias("_row"))
    out = fan(keyed).groupBy("_row").agg(F.first("_r").alias("_r"), *[c.alias(n) for n, c in found.items()])
    return out.select(*[F.col(f"_r.`{c}`").alias(c) for c in df.columns if c not in found], *found)
