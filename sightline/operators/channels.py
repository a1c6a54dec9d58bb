"""From ranked channels to candidates: weighted reciprocal rank fusion and what follows it.

Channels are rows hits(query_id, channel, video_id, shot_id, rank, score).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline import config
from sightline.operators.grouped import whole_groups

KEY = ["query_id", "video_id", "shot_id"]


def key_text() -> Column:
    """The text that orders equal items: numbers compare as text."""
    return F.format_string("('%s', %d)", F.col("video_id"), F.col("shot_id"))


def fuse(hits: DataFrame, weights: DataFrame | None = None, eta: float = 60.0, depth: int = 2000, top_k: int | None = None) -> DataFrame:
    """(query_id, video_id, shot_id, fused_score, n_channels, ranks, raw, rank).

    Weight-0 channels are skipped; the depth cut comes before in-channel repeats are
    dropped, without renumbering; channels without a weight count 1.  ``weights`` is
    (channel, weight) or (query_id, channel, weight).  ``top_k`` None or 0 keeps all.
    """
    if eta <= 0:
        raise ValueError("eta must be positive")
    rows = hits.where(F.col("rank") <= depth).groupBy(*KEY, "channel").agg(F.min(F.struct("rank", "score")).alias("best"))
    if weights is not None:
        rows = rows.join(weights, [c for c in ("query_id", "channel") if c in weights.columns], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    part = F.col("weight") / (F.lit(eta) + F.col("best.rank"))
    fused = rows.where("weight <> 0").groupBy(*KEY).agg(
        F.round(F.sum(part), 12).alias("fused_score"), F.count("*").alias("n_channels"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.col("best.rank").alias("rank"))))).alias("ranks"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.col("best.score").alias("score"))))).alias("raw"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), F.desc("n_channels"), key_text())
    placed = fused.withColumn("rank", F.row_number().over(order))
    return placed.where(F.col("rank") <= top_k) if top_k else placed


def video_hits(hits: DataFrame) -> DataFrame:
    """Each channel's ranking of videos: a video's first row counts, ranks are numbered anew; shot_id is 0."""
    first = hits.groupBy("query_id", "channel", "video_id").agg(F.min("rank").alias("first"), F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "channel").orderBy("first", "video_id")
    return first.select("query_id", "channel", "video_id", F.lit(0).alias("shot_id"), F.row_number().over(order).alias("rank"), "score")


def cap_per_video(fused: DataFrame, most: int = 12, limit: int = 500) -> DataFrame:
    """The first ``most`` shots of each video in fused order, and of those the first ``limit`` per query."""
    within = Window.partitionBy("query_id", "video_id").orderBy("rank")
    kept = fused.withColumn("in_video", F.row_number().over(within)).where(F.col("in_video") <= most)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= limit).drop("place")


def video_scores(candidates: DataFrame, sharpness: float = 3.0, score: str = "fused_score") -> DataFrame:
    """(query_id, video_id, raw, pi): rank-discounted sum of a video's scores, sharpened and normalised per query."""
    place = F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy(F.desc(score)))
    raw = candidates.withColumn("n", place).groupBy("query_id", "video_id").agg(F.sum(F.col(score) / F.col("n")).alias("raw"))
    sharp = raw.withColumn("sharp", F.pow("raw", F.lit(sharpness)))
    total = F.sum("sharp").over(Window.partitionBy("query_id"))
    return sharp.select("query_id", "video_id", "raw", F.coalesce(F.try_divide(F.col("sharp"), total), F.lit(0.0)).alias("pi"))


def prior(video_id: Column, task: Column, hints: Column, strength: float = 1.0) -> Column:
    """Multiplier of a video's probability by its group's genre and the query's hints."""
    domain = F.coalesce(F.create_map(*(F.lit(x) for kv in config.GROUP_DOMAIN.items() for x in kv))[F.substring_index(video_id, "_", 1)], F.lit("unknown"))
    friendly = F.coalesce(F.create_map(*(F.lit(x) for kv in config.TRAKE_FRIENDLY.items() for x in kv))[domain], F.lit(config.UNKNOWN_FRIENDLINESS))
    clamp = lambda m: F.lit(1.0) if strength <= 0 else F.greatest(F.lit(config.PRIOR_FLOOR), F.least(F.lit(config.PRIOR_CEILING), 1.0 + strength * (m - 1.0)))
    by_hint = F.when(F.size(F.coalesce(hints, F.array().cast("array<string>"))) == 0, F.lit(1.0)).when(F.array_contains(hints, domain), clamp(F.lit(config.HINT_HIT))).otherwise(clamp(F.lit(config.HINT_MISS)))
    return by_hint * F.when(task == "trake", clamp(0.4 + 2.1 * friendly)).otherwise(1.0)


def apply_prior(scores: DataFrame, queries: DataFrame, strength: float = 1.0) -> DataFrame:
    """Tilt pi by ``prior`` and normalise again; no video is added.  ``queries`` is (query_id, task, domain_hints)."""
    tilted = scores.join(queries, "query_id", "left").withColumn("pi", F.col("pi") * prior(F.col("video_id"), F.col("task"), F.col("domain_hints"), strength))
    total = F.sum("pi").over(Window.partitionBy("query_id"))
    return tilted.withColumn("pi", F.coalesce(F.try_divide(F.col("pi"), total), F.lit(0.0))).drop("task", "domain_hints")


def diagnostics(candidates: DataFrame) -> DataFrame:
    """Per query: candidates, videos, candidates that two or more channels agree on."""
    return candidates.groupBy("query_id").agg(F.count("*").alias("candidates"), F.countDistinct("video_id").alias("videos"), F.count_if(F.size("ranks") >= 2).alias("agreed"))


def recall_scores(base_hits: DataFrame, eta: float = 60.0, weights: DataFrame | None = None) -> DataFrame:
    """(query_id, video_id, video_rank, score): every video that any whole-corpus channel found, by the fusion of their video rankings; scores add up to 1."""
    fused = fuse(video_hits(base_hits), weights, eta)
    return fused.select("query_id", "video_id", F.col("rank").alias("video_rank"), (F.col("fused_score") / F.sum("fused_score").over(Window.partitionBy("query_id"))).alias("score"))


def recall_pool(base_hits: DataFrame, candidates: DataFrame, videos: int = 300, eta: float = 60.0, weights: DataFrame | None = None) -> DataFrame:
    """(query_id, video_id, video_rank, shot_id, fused_score, ranks, raw, recall_only): the first shot, in fused order, of each of the first videos."""
    pool = recall_scores(base_hits, eta, weights).where(F.col("video_rank") <= videos).select("query_id", "video_id", "video_rank")
    place = F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy("rank"))
    shots = fuse(base_hits, weights, eta).withColumn("n", place).where("n = 1").select("query_id", "video_id", "shot_id", "fused_score", "ranks", "raw")
    known = candidates.select("query_id", "video_id").distinct().withColumn("known", F.lit(True))
    return pool.join(shots, ["query_id", "video_id"]).join(known, ["query_id", "video_id"], "left").withColumn("recall_only", F.col("known").isNull()).drop("known")


def leader_clusters(candidates: DataFrame, threshold: float = 0.92) -> DataFrame:
    """``candidates`` with cluster_id: in fused order, the first earlier leader that is similar takes a candidate.

    A query has at most n_candidates rows, so one group is small.  ``embedding`` is
    the nearest keyframe's vector; a candidate without one is its own cluster.
    """
    schema = T.StructType([*candidates.schema.fields, T.StructField("cluster_id", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches, ["query_id"]):
            column = g["embedding"].combine_chunks()
            there = np.flatnonzero(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) > 0)
            unit = np.zeros((0, 0))
            if len(there):
                v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(there), -1)
                norm = np.linalg.norm(v, axis=1)
                there, unit = there[norm > 0], v[norm > 0] / norm[norm > 0, None]
            # Whoever is free when its turn comes leads, and takes all later ones that are free and similar.
            leader = np.arange(g.num_rows)
            free = np.ones(len(there), bool)
            for k in range(len(there)):
                if free[k]:
                    near = np.flatnonzero(free[k:] & (unit[k:] @ unit[k] >= threshold)) + k
                    free[near] = False
                    free[k] = False
                    leader[there[near]] = there[k]
            leads = leader == np.arange(g.num_rows)
            ids = (np.cumsum(leads) - 1)[leader].astype(np.int32)
            yield from g.append_column("cluster_id", pa.array(ids)).combine_chunks().to_batches()

    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return candidates.repartition(tasks, "query_id").sortWithinPartitions("query_id", "rank").mapInArrow(run, schema)


def union_recall(p: Column) -> Column:
    """1 - prod(1 - p) over an array of recalls; a certain channel gives 1."""
    return 1.0 - F.aggregate(p, F.lit(1.0), lambda s, x: s * (1.0 - x))


def series_recall(p: Column) -> Column:
    return F.aggregate(p, F.lit(1.0), lambda s, x: s * x)


