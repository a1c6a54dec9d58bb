"""Deliveries: which row of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, version: Column | str | None = None) -> DataFrame:
    """One row per ``key``: that of the greatest ``version``, any of several alike.

    Rows with a null key are left out; a null version counts as the oldest.  The
    rows end up partitioned by ``key``, which later steps on the key reuse.
    """
    order = F.lit(1) if version is None else (F.col(version) if isinstance(version, str) else version)
    mark = "__version_rank"
    window = Window.partitionBy(key).orderBy(order.desc_nulls_last())
    return df.where(F.col(key).isNotNull()).withColumn(mark, F.row_number().over(window)).where(F.col(mark) == 1).drop(mark)
