"""What a caller may ask for, checked on the driver before any plan is made, and rows ready to show."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.config import MAX_ANSWERS, TASKS

MAX_TEXT, MAX_BATCH = 2000, 50
_VIDEO = re.compile(r"L\d+_V\d+")


def video_id(value: str) -> str:
    if not _VIDEO.fullmatch(value or ""):
        raise ValueError(f"no video id: {value!r}")
    return value


def query_id(value: str) -> str:
    plain = (value or "").strip()
    if not re.fullmatch(r"[\w.-]{1,64}", plain):
        raise ValueError(f"no query id: {value!r}")
    return plain


def batch(spark: SparkSession, requests: list[dict], top: int = MAX_ANSWERS) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(queries, answers, pins) of requests {query_id, text[, english, task, answers, pins]}; raises on what the engine would not take.

    Answers are texts or {text, prob}; probabilities lie in [0, 1].
    """
    if not 1 <= len(requests) <= MAX_BATCH:
        raise ValueError(f"a batch has 1 to {MAX_BATCH} queries")
    if not 1 <= top <= MAX_ANSWERS:
        raise ValueError(f"top is 1 to {MAX_ANSWERS}")
    queries, answers, pins, seen = [], [], [], set()
    for r in requests:
        key, words = query_id(r.get("query_id", "")), " ".join((r.get("text") or "").split())
        if key in seen:
            raise ValueError(f"repeated query id: {key}")
        seen.add(key)
        if not 0 < len(words) <= MAX_TEXT:
            raise ValueError(f"{key}: a text has 1 to {MAX_TEXT} characters")
        if r.get("task") not in (None, *TASKS):
            raise ValueError(f"{key}: no task {r['task']!r}")
        queries.append((key, (r["text"]).strip(), r.get("english")))
        for a in r.get("answers") or []:
            text, prob = (a, 1.0) if isinstance(a, str) else (str(a["text"]), float(a.get("prob", 1.0)))
            if not 0 <= prob <= 1:
                raise ValueError(f"{key}: probability {prob}")
            answers.append((key, text, prob))
        for k, p in enumerate(r.get("pins") or [], 1):
            if int(p["frame"]) < 0:
                raise ValueError(f"{key}: frame {p['frame']}")
            pins.append((key, k, video_id(p["video_id"]), int(p["frame"]), p.get("answer")))
    return (
        spark.createDataFrame(queries, "query_id string, raw string, english string"),
        spark.createDataFrame(answers, "query_id string, answer string, prob double") if answers else None,
        spark.createDataFrame(pins, "query_id string, pos int, video_id string, frame int, answer string") if pins else None,
    )


def shown(solved: DataFrame, keyframes: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """Answers with nearest keyframe, seconds, time code and title, numbers rounded to 6 digits."""
    from sightline.functions.text import timecode
    from sightline.operators.shots import nearest_keyframes

    rows = nearest_keyframes(solved.withColumn("at", F.coalesce("frame", F.get("frames", F.lit(0)))), keyframes, "at")
    fps = keyframes.groupBy("video_id").agg(F.max(F.when(F.col("fps") > 0, F.col("fps"))).alias("fps"))
    rows = rows.join(fps, "video_id", "left").withColumn("seconds", F.round(F.col("at") / F.coalesce("fps", F.lit(25.0)), 6)).withColumn("timecode", timecode(F.col("seconds")))
    if media is not None:
        rows = rows.join(media.groupBy("video_id").agg(F.max("title").alias("title")), "video_id", "left")
    return rows.withColumn("gain", F.round("gain", 6)).withColumn("cumulative", F.round("cumulative", 6)).drop("at", "fps")


def video_info(keyframes: DataFrame, media: DataFrame, video: str) -> DataFrame:
    """One row about a video: keyframes, last frame, seconds, title."""
    of = keyframes.where(F.col("video_id") == video_id(video)).agg(F.count("*").alias("keyframes"), F.max("frame_idx").alias("last_frame"), F.max("pts_time").alias("seconds"))
    about = media.where(F.col("video_id") == video).agg(F.max("title").alias("title"), F.max("author").alias("author"))
    return of.join(F.broadcast(about), F.lit(True))
