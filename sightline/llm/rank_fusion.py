"""One ranking from several differently scaled scores: reciprocal rank fusion.

Within a query each channel ranks the items that it scored (larger is better,
equal scores share the better rank); an item's total is the sum of
``weight / (eta + rank)`` over the channels that scored it.  Only ranks enter, so
no channel prevails because of its range.

Null, NaN and absent scores say nothing: they neither take a rank nor add to a
total.  An item without any score has total 0 and comes last.  Items with a null
query belong to no ranking and are left out, and so are rows without an item.  Equal totals are ordered by the
smaller item id.  Columns other than query, item and scores are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.prefix import running_totals
from sightline.session import cut

#: A query with more rows than this is ranked by range partitions instead of in one window.
HOT_ROWS = 500_000
#: At most so many hot queries can exist above the threshold that hot_queries() uses.
MOST_HOT = 65_536
SALTS = 16


def channels_of(df: DataFrame, scores: str) -> list[str]:
    """The channel names in a map column, in order; there are as many as the engine has channels."""
    names = [r[0] for r in df.select(F.explode(F.map_keys(scores)).alias("c")).distinct().limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 channels: these keys are not channel names")
    return sorted(names)


def hot_queries(df: DataFrame, query: str, hot_rows: int = HOT_ROWS) -> list:
    """Queries too large for one window.  The threshold rises with the table, so at most MOST_HOT exceed it."""
    counts = cut(df.groupBy(query).count())
    limit = max(hot_rows, (counts.agg(F.sum("count")).first()[0] or 0) // MOST_HOT)
    return [r[0] for r in counts.where((F.col("count") > limit) & F.col(query).isNotNull()).collect()]


def _total(ranks: list[Column], weights: list[float], eta: float) -> Column:
    # In one fixed order, so that equal rank sets give equal totals to the last bit.
    parts = [F.coalesce(F.lit(w) / (F.lit(eta) + r), F.lit(0.0)) for r, w in zip(ranks, weights, strict=True)]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def fuse_wide(rows: DataFrame, query: str, item: str, score_columns: list[str], weights: dict[str, float] | None = None, eta: float = 60.0, hot: list | None = None) -> DataFrame:
    """(query, item, fused_score) from one column per channel.

    Ordinary queries: one exchange by query, then a rank window per channel on it.
    ``hot`` queries: ranks over distinct scores by range-partitioned running totals.
    """
    if eta <= 0:
        raise ValueError("eta must be positive")
    rows = rows.where(F.col(query).isNotNull() & F.col(item).isNotNull())
    if not score_columns:
        return rows.select(query, item, F.lit(0.0).alias("fused_score"))
    w = [float((weights or {}).get(c, 1.0)) for c in score_columns]
    clean = rows.select(query, item, *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in score_columns))
    plain = clean.where(~F.col(query).isin(hot)) if hot else clean
    ranks = [F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy(query).orderBy(F.col(c).desc_nulls_last()))) for c in score_columns]
    result = plain.select(query, item, *(r.alias(c) for r, c in zip(ranks, score_columns, strict=True))).select(query, item, _total([F.col(c) for c in score_columns], w, eta).alias("fused_score"))
    if hot:
        result = result.unionByName(_fuse_hot(clean.where(F.col(query).isin(hot)), query, item, score_columns, w, eta))
    return result


def _fuse_hot(rows: DataFrame, query: str, item: str, score_columns: list[str], weights: list[float], eta: float) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(k).alias("channel"), F.col(c).cast("double").alias("score")) for k, c in enumerate(score_columns)))
    long = rows.select(query, item, F.explode(pairs).alias("p")).select(query, item, "p.channel", "p.score")
    scored = long.where(F.col("score").isNotNull())
    distinct = scored.groupBy(query, "channel", "score").agg(F.count("*").alias("n"))
    ranks = running_totals(distinct, [query, "channel"], [F.col("score").desc()], "n", "above").select(query, "channel", "score", (F.col("above") + 1).alias("rank"))
    # Many items may share one score: both sides are salted.
    spread = ranks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ranked = scored.withColumn("salt", F.pmod(F.xxhash64(item), F.lit(SALTS)).cast("int")).join(spread, [query, "channel", "score", "salt"])
    none = rows.select(query, item, F.lit(-1).alias("channel"), F.lit(None).cast("long").alias("rank"))
    per_item = ranked.select(query, item, "channel", "rank").unionByName(none).groupBy(query, item).agg(*(F.max(F.when(F.col("channel") == k, F.col("rank"))).alias(c) for k, c in enumerate(score_columns)))
    return per_item.select(query, item, _total([F.col(c) for c in score_columns], weights, eta).alias("fused_score"))


def fuse_maps(rows: DataFrame, query: str, item: str, scores: str, weights: dict[str, float] | None = None, eta: float = 60.0, hot_rows: int = HOT_ROWS, prepare=None) -> DataFrame:
    """(query, item, fused_score) from a map column channel -> score.

    ``prepare`` is applied to the rows once their scores are plain columns (for
    example to keep the latest delivery); it must keep query, item and scores.
    """
    names = channels_of(rows, scores)
    columns = [f"__score_{k}" for k in range(len(names))]
    wide = rows.withColumns({c: F.try_element_at(scores, F.lit(n)).cast("double") for c, n in zip(columns, names, strict=True)}).drop(scores)
    hot = hot_queries(rows, query, hot_rows)
    by_column = {c: (weights or {}).get(n, 1.0) for c, n in zip(columns, names, strict=True)}
    return fuse_wide(prepare(wide) if prepare else wide, query, item, columns, by_column, eta, hot)


def heads(fused: DataFrame, query: str, item: str) -> DataFrame:
    """The first item of each query; ties go to the smaller id.  Combines before it shuffles."""
    best = F.max(F.struct(F.col("fused_score"), (-F.col(item)).alias("minus"))).alias("best")
    return fused.groupBy(query).agg(best).select(query, (-F.col("best.minus")).alias(item))
