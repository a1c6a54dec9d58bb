"""Keyframes and shots: boundaries, splits, windows, interval and nearest joins, checks.

``video_id`` is the partition of every window; a video's keyframes are bounded by
its length.  Intervals are closed on both ends.  Rows with a null frame_idx are
left out, as by the keyframe reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_to_frame(pts: Column, fps: Column, convention: str = "floor") -> Column:
    """floor (the corpus's own), round (half to even) or ceil of pts * fps; null where fps is not positive or pts negative."""
    x = pts * fps
    value = {"floor": F.floor(x), "round": F.bround(x, 0).cast("long"), "ceil": F.ceil(x)}[convention]
    return F.when((fps > 0) & (pts >= 0), value)


def frame_to_time(frame: Column, fps: Column, at_center: bool = False) -> Column:
    return F.when(fps > 0, (frame + (0.5 if at_center else 0.0)) / fps)


def seconds_to_frames(seconds: Column, fps: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(seconds * fps))


def shots_from_keyframes(keyframes: DataFrame, last_frames: DataFrame | None = None) -> DataFrame:
    """(video_id, shot_id, start_frame, end_frame, keyframes, kind): keyframes of equal frame_idx begin one shot.

    A shot ends before the next begins; the last one at ``last_frames`` (video_id,
    last_frame) if that is not before its start, else after the previous gap.
    """
    starts = keyframes.where(F.col("frame_idx").isNotNull()).groupBy("video_id", F.col("frame_idx").alias("start_frame")).agg(F.array_sort(F.collect_set("n")).alias("keyframes"))
    if last_frames is None:
        starts = starts.withColumn("last_frame", F.lit(None).cast("int"))
    else:
        starts = starts.join(last_frames.groupBy("video_id").agg(F.max("last_frame").alias("last_frame")), "video_id", "left")
    w = Window.partitionBy("video_id").orderBy("start_frame")
    start, previous, following = F.col("start_frame"), F.lag("start_frame").over(w), F.lead("start_frame").over(w)
    end = F.coalesce(following - 1, F.when(F.col("last_frame") >= start, F.col("last_frame")), start + (start - previous) - 1, start)
    return starts.select("video_id", (F.row_number().over(w) - 1).alias("shot_id"), "start_frame", end.cast("int").alias("end_frame"), "keyframes", F.lit("shot").alias("kind"))


def split_long_shots(shots: DataFrame, longest_seconds: float = 20.0, part_seconds: float = 10.0) -> DataFrame:
    """Shots over the longest length cut into parts; the first part keeps the keyframes; ids are numbered anew.

    ``shots`` has an fps column.
    """
    length = F.col("end_frame") - F.col("start_frame") + 1
    part = seconds_to_frames(F.lit(part_seconds), F.col("fps")).cast("int")
    parts = F.when(length > seconds_to_frames(F.lit(longest_seconds), F.col("fps")), F.ceil(length / part)).otherwise(F.lit(1)).cast("int")
    each = shots.withColumn("part", part).withColumn("parts", parts).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    start = F.when(F.col("parts") > 1, F.col("start_frame") + F.col("k") * F.col("part")).otherwise(F.col("start_frame"))
    stop = F.when(F.col("parts") > 1, F.least(F.col("start_frame") + (F.col("k") + 1) * F.col("part") - 1, F.col("end_frame"))).otherwise(F.col("end_frame"))
    cut_up = each.select("video_id", start.cast("int").alias("start_frame"), stop.cast("int").alias("end_frame"), F.when(F.col("k") == 0, F.col("keyframes")).otherwise(F.array().cast("array<int>")).alias("keyframes"), F.when(F.col("parts") > 1, F.lit("split")).otherwise(F.col("kind")).alias("kind"))
    return cut_up.withColumn("shot_id", F.row_number().over(Window.partitionBy("video_id").orderBy("start_frame")) - 1)


def build_shots(keyframes: DataFrame, media: DataFrame | None = None, split: bool = True) -> DataFrame:
    """The shot table: last frames from the media length where it is sensible, long shots split by each video's fps."""
    fps = keyframes.where(F.col("fps") > 0).groupBy("video_id").agg(F.max("fps").alias("fps"))
    last = None
    if media is not None:
        length = media.where(F.col("length_seconds") > 0).groupBy("video_id").agg(F.max("length_seconds").alias("s"))
        last = length.join(fps, "video_id").select("video_id", F.try_add(F.floor(F.col("s") * F.col("fps")), F.lit(0)).cast("int").alias("last_frame"))
    shots = shots_from_keyframes(keyframes, last)
    if not split:
        return shots
    return split_long_shots(shots.join(fps, "video_id", "left").withColumn("fps", F.coalesce("fps", F.lit(25.0)))).select("video_id", "shot_id", "start_frame", "end_frame", "keyframes", "kind")


def sliding_windows(keyframes: DataFrame, seconds: float = 30.0, step: float = 15.0) -> DataFrame:
    """(video_id, shot_id, start_frame, end_frame) of overlapping windows over each video's frames."""
    spans = keyframes.where("frame_idx is not null and fps > 0").groupBy("video_id").agg(F.max("frame_idx").alias("last"), F.max("fps").alias("fps"))
    wide, stride = seconds_to_frames(F.lit(seconds), F.col("fps")).cast("int"), seconds_to_frames(F.lit(step), F.col("fps")).cast("int")
    each = spans.withColumn("wide", wide).withColumn("stride", stride).select("video_id", "last", "wide", F.posexplode(F.sequence(F.lit(0), F.col("last"), F.col("stride"))).alias("shot_id", "start_frame"))
    return each.select("video_id", "shot_id", "start_frame", F.least(F.col("start_frame") + F.col("wide") - 1, F.col("last")).alias("end_frame"))


def _looked_up(frames: DataFrame, frame: str, look) -> DataFrame:
    """``frames`` joined with what ``look`` finds for its distinct (video_id, frame) pairs.

    However many rows point into one video, its distinct frames are bounded by its
    length: they are combined before the per-video window, and the rows come back by
    video and frame, so no task holds a hot video's rows.
    """
    pairs = frames.where(F.col("video_id").isNotNull() & F.col(frame).isNotNull()).select("video_id", F.col(frame).alias("__at")).distinct()
    return frames.join(look(pairs).withColumnRenamed("__at", frame), ["video_id", frame], "left")


def frames_to_shots(frames: DataFrame, shots: DataFrame, frame: str = "frame") -> DataFrame:
    """``frames`` with shot_id of the shot that holds each frame, null in a gap; a null frame has none.

    Shots of a video are disjoint, so the last one that starts by the frame is the
    only one that can hold it: one window over both tables instead of a range join.
    """
    w = Window.partitionBy("video_id").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = shots.select("video_id", F.col("start_frame").cast("long").alias("__at"), F.lit(0).alias("__kind"), F.struct("shot_id", "end_frame").alias("__shot"))

    def look(pairs: DataFrame) -> DataFrame:
        both = pairs.withColumn("__kind", F.lit(1)).unionByName(marks, allowMissingColumns=True).withColumn("__shot", F.last("__shot", ignorenulls=True).over(w)).where("__kind = 1")
        return both.select("video_id", "__at", F.when(F.col("__at") <= F.col("__shot.end_frame"), F.col("__shot.shot_id")).alias("shot_id"))

    return _looked_up(frames, frame, look)


def nearest_keyframes(frames: DataFrame, keyframes: DataFrame, frame: str = "frame") -> DataFrame:
    """``frames`` with nearest_n and nearest_frame: the closest keyframe of the video, on a tie the earlier, then the smaller n."""
    marks = keyframes.where(F.col("frame_idx").isNotNull()).groupBy("video_id", F.col("frame_idx").alias("f")).agg(F.min("n").alias("n")).select("video_id", F.col("f").cast("long").alias("__at"), F.lit(0).alias("__kind"), F.struct("f", "n").alias("__mark"))
    before = Window.partitionBy("video_id").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("video_id").orderBy(F.desc("__at"), "__kind").rowsBetween(Window.unboundedPreceding, 0)

    def look(pairs: DataFrame) -> DataFrame:
        rows = pairs.withColumn("__kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
        both = rows.withColumn("__b", F.last("__mark", ignorenulls=True).over(before)).withColumn("__a", F.last("__mark", ignorenulls=True).over(after)).where("__kind = 1")
        take_before = F.col("__b").isNotNull() & (F.col("__a").isNull() | (F.col("__at") - F.col("__b.f") <= F.col("__a.f") - F.col("__at")))
        best = both.withColumn("__best", F.when(take_before, F.col("__b")).otherwise(F.col("__a")))
        return best.select("video_id", "__at", F.col("__best.n").alias("nearest_n"), F.col("__best.f").alias("nearest_frame"))

    return _looked_up(frames, frame, look)


def gaps(keyframes: DataFrame) -> DataFrame:
    """(video_id, n, gap) between consecutive keyframes."""
    w = Window.partitionBy("video_id").orderBy("n")
    return keyframes.where("frame_idx is not null").select("video_id", "n", (F.col("frame_idx") - F.lag("frame_idx").over(w)).alias("gap")).where("gap is not null")


def gap_stats(keyframes: DataFrame) -> DataFrame:
    """Mean, median, p90, p99 (linear interpolation) and greatest gap."""
    q = F.percentile("gap", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return gaps(keyframes).agg(F.avg("gap").alias("mean"), q.alias("q"), F.max("gap").alias("longest")).select(F.round("mean", 6).alias("mean"), F.round(F.col("q")[0], 6).alias("median"), F.round(F.col("q")[1], 6).alias("p90"), F.round(F.col("q")[2], 6).alias("p99"), "longest")


def shot_stats(shots: DataFrame) -> DataFrame:
    """Per kind of shot: count, mean length, median and p90 as the element at int(p * n) of the sorted lengths."""
    rows = shots.select("kind", (F.col("end_frame") - F.col("start_frame") + 1).alias("length"))
    # Counts per length first: the distinct lengths are few, whatever the number of shots.
    by = rows.groupBy("kind", "length").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("kind").orderBy("length"))
    n = F.sum("c").over(Window.partitionBy("kind"))
    at = by.withColumn("upto", upto).withColumn("n", n)
    pick = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * F.lit(p)), F.col("length")))
    return at.groupBy("kind").agg(F.sum("c").alias("shots"), F.round(F.sum(F.col("length") * F.col("c")) / F.sum("c"), 6).alias("mean"), pick(0.5).alias("median"), pick(0.9).alias("p90"))


def shot_length_shares(shots: DataFrame, fps: DataFrame, short: float = 2.0, long: float = 20.0) -> DataFrame:
    """(shots, mean_s, median_s, p90_s, p99_s, longest_s, under_pct, over_pct) of shot lengths in seconds; medians and such as the element at int(p * n)."""
    rows = shots.join(fps.select("video_id", "fps"), "video_id", "left").select(F.round((F.col("end_frame") - F.col("start_frame") + 1) / F.coalesce("fps", F.lit(25.0)), 6).alias("s"))
    by = rows.groupBy("s").agg(F.count("*").alias("c"))
    # The distinct lengths are few and in one order: their running count is one small window.
    at = by.withColumn("upto", F.sum("c").over(Window.orderBy("s"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    pick = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * F.lit(p)), F.col("s")))
    share = lambda where: F.round(100.0 * F.sum(F.when(where, F.col("c")).otherwise(0)) / F.sum("c"), 6)
    return at.agg(
        F.sum("c").alias("shots"), F.round(F.sum(F.col("s") * F.col("c")) / F.sum("c"), 6).alias("mean_s"), pick(0.5).alias("median_s"), pick(0.9).alias("p90_s"), pick(0.99).alias("p99_s"), F.max("s").alias("longest_s"),
        share(F.col("s") < short).alias("under_pct"), share(F.col("s") > long).alias("over_pct"),
    )


def window_hit_rate(keyframes: DataFrame, window: int = 10) -> DataFrame:
    """(rate): how likely a window of so many frames holds a keyframe, by the mean gap."""
    return gaps(keyframes).agg(F.round(F.least(F.lit(1.0), window / F.avg("gap")), 6).alias("rate"))


def vector_shapes(vectors: DataFrame) -> DataFrame:
    """(dim, kind, videos, vectors): how many videos and vectors of each length; a null vector has none."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    return vectors.groupBy(F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"), F.lit(kind).alias("kind")).agg(F.countDistinct("video_id").alias("videos"), F.count("*").alias("vectors"))


def check_convention(keyframes: DataFrame) -> DataFrame:
    """Per video: keyframes, matches of floor, round and ceil, distinct fps, repeated frame_idx, and whether pts rises."""
    w = Window.partitionBy("video_id").orderBy("n")
    rows = keyframes.withColumn("back", F.col("pts_time") < F.lag("pts_time").over(w))
    match = lambda c: F.count_if(F.col("frame_idx") == time_to_frame(F.col("pts_time"), F.col("fps"), c))
    return rows.groupBy("video_id").agg(
        F.count("*").alias("keyframes"), match("floor").alias("floor"), match("round").alias("round"), match("ceil").alias("ceil"),
        F.countDistinct("fps").alias("rates"), (F.count("frame_idx") - F.countDistinct("frame_idx")).alias("repeated"), F.count_if("back").alias("backward"),
    )


def grid_alignment(keyframes: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Share of keyframes whose pts is off the frame grid, and the greatest deviation in frames."""
    off = F.abs(F.col("pts_time") * F.col("fps") - F.bround(F.col("pts_time") * F.col("fps"), 0))
    return keyframes.where("pts_time is not null and fps > 0").agg(F.round(F.avg((off > tolerance / 10).cast("double")), 6).alias("off_grid"), F.round(F.max(off), 6).alias("greatest"))


def duplicate_frames(keyframes: DataFrame) -> DataFrame:
    """(video_id, frame_idx, ns) of frames with several keyframes."""
    by = keyframes.where("frame_idx is not null").groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_set("n")).alias("ns"))
    return by.where(F.size("ns") > 1)
