"""Labelled sets: blind-sampled segments in proportion to the hours of each group, and what a set covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How many queries of each task a labelled set should have.
MINIMUM = {"kis": 10, "qa": 5, "trake": 5}


def group_hours(keyframes: DataFrame) -> DataFrame:
    """(grp, hours) of the video groups, from each video's last keyframe."""
    ends = keyframes.where("pts_time is not null").groupBy("video_id").agg(F.max("pts_time").alias("s"))
    return ends.groupBy(F.substring_index("video_id", "_", 1).alias("grp")).agg((F.sum("s") / 3600.0).alias("hours"))


def allotment(hours: DataFrame, total: int) -> DataFrame:
    """(grp, n): ``total`` shared out by hours, rounded half to even; the last group takes what is left.  Groups are few."""
    order = Window.orderBy("grp")
    all_hours, last = F.sum("hours").over(Window.partitionBy()), F.lead("grp").over(order).isNull()
    n = F.bround(total * F.col("hours") / all_hours, 0).cast("long")
    before = F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return hours.withColumn("n", n).withColumn("before", before).withColumn("last", last).select("grp", F.greatest(F.lit(0), F.when(F.col("last"), total - F.col("before")).otherwise(F.col("n"))).alias("n"))


def sample_targets(keyframes: DataFrame, counts: dict[str, int], seed: int = 2026, seconds: float = 10.0) -> DataFrame:
    """(task, video_id, n, frame, start_frame, end_frame): segments around keyframes drawn by hash within each group's allotment."""
    framed = keyframes.where("frame_idx is not null and fps > 0").select("video_id", "n", F.col("frame_idx").alias("frame"), "fps", F.substring_index("video_id", "_", 1).alias("grp"))
    out = None
    for task, total in counts.items():
        lot = F.xxhash64(F.lit(seed), F.lit(task), "video_id", "n")
        drawn = framed.withColumn("lot", lot).withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("lot", "video_id", "n"))).where(F.col("k") <= total)
        half = F.ceil(F.lit(seconds / 2) * F.col("fps")).cast("int")
        part = drawn.join(F.broadcast(allotment(group_hours(keyframes), total)).withColumnRenamed("n", "most"), "grp").where("k <= most").select(F.lit(task).alias("task"), "video_id", "n", "frame", F.greatest(F.lit(0), F.col("frame") - half).alias("start_frame"), (F.col("frame") + half).alias("end_frame"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no task to sample for")
    return out


def coverage_report(truths: DataFrame) -> DataFrame:
    """(task, queries, annotated, minimum, enough) of a labelled set."""
    least = F.create_map(*(F.lit(x) for kv in MINIMUM.items() for x in kv))
    by = truths.groupBy("task").agg(F.count("*").alias("queries"), F.count_if(F.col("video_id") != "").alias("annotated"))
    return by.withColumn("minimum", F.coalesce(least[F.col("task")], F.lit(0))).withColumn("enough", F.col("annotated") >= F.col("minimum"))
