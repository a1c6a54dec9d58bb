"""Running totals over groups of any size.

The rows are range-partitioned by group and order, so that a huge group spans
many partitions; a total per (group, partition) gives each partition its offset.
No task ever sees more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import cut


def running_totals(df: DataFrame, group: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before it in its group.

    ``order`` must be total within a group.  The ranges are written before use, as
    their bounds come from a sample and must be the same for offsets and rows.
    Null values count as 0; an empty table gives an empty result.
    """
    part, before = "__range", "__before"
    amount = F.coalesce(F.col(value), F.lit(0))
    ranged = cut(df.repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()))
    offsets = (
        ranged.groupBy(*group, part)
        .agg(F.sum(amount).alias("__sum"))
        .withColumn(before, F.sum("__sum").over(Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)))
        .select(*group, part, F.coalesce(before, F.lit(0)).alias(before))
    )
    within = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(offsets, [*group, part])
        .withColumn(out, F.coalesce(F.sum(amount).over(within), F.lit(0)) + F.col(before))
        .drop(part, before)
    )
