"""Top N items of every group, by merging sorted runs with a loser tree.

1. Each task sorts its rows by (group, score descending, item) into runs and
   keeps at most N per group in a run: nothing after them can be among the top.
   A huge group is thereby cut to N rows per run before anything is shuffled.
2. The runs are stored in buckets by group (the shuffle), a bucket's rows in order
   of group and, within it, run by run.
3. A bucket is read as a stream: a loser tree merges the runs of a group, and after
   N rows the reader seeks to the next group.  What is held is one batch and one
   group, which has at most N rows a run.

Null and NaN scores, null groups and null items are left out.  Equal scores are ordered by
the smaller item.  A group with fewer rows comes out whole; repeated (group,
score, item) rows count as rows.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one task sorts at a time; a larger partition gives several runs.
RUN_ROWS = 1 << 20


def _run_maker(n: int, run_rows: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, rows, number = [], 0, TaskContext.get().partitionId() << 24

        def run() -> pa.RecordBatch:
            nonlocal held, rows, number
            t = pa.Table.from_batches(held).combine_chunks()
            t = t.take(pc.sort_indices(t, sort_keys=[("g", "ascending"), ("s", "descending"), ("i", "ascending")]))
            codes = pc.dictionary_encode(t["g"].combine_chunks()).indices.to_numpy()
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            within = np.arange(len(codes)) - np.repeat(first, np.diff(np.r_[first, len(codes)]))
            t = t.filter(pa.array(within < n)).append_column("run", pa.array(np.full(int((within < n).sum()), number)))
            held, rows, number = [], 0, number + 1
            return t

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= run_rows:
                yield from run().to_batches()
        if rows:
            yield from run().to_batches()

    return make


class LoserTree:
    """Merges sorted runs given as lists; inner nodes hold the losers of their matches."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.leaves = k = max(1, len(runs))
        self.heads = [r[0] if r else None for r in runs] or [None]
        self.losers = [-1] * k
        for r in range(k):
            self._play(r, filling=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def _play(self, r: int, filling: bool = False) -> None:
        losers, node = self.losers, (r + self.leaves) >> 1
        while node:
            other = losers[node]
            if other < 0 and filling:
                losers[node] = r
                return
            if not self._beats(r, other):
                losers[node], r = r, other
            node >>= 1
        losers[0] = r

    @property
    def winner(self) -> int:
        return self.losers[0]

    def move(self, r: int, to: int) -> None:
        """Put run ``r`` at position ``to`` and replay its matches."""
        self.at[r] = to
        run = self.runs[r]
        self.heads[r] = run[to] if to < len(run) else None
        self._play(r)


def merge_top(runs: list[list[tuple]], n: int) -> Iterator[tuple[int, int]]:
    """(run, position) of the first ``n`` entries of sorted runs, merged."""
    tree = LoserTree(runs)
    for _ in range(n):
        r = tree.winner
        if tree.heads[r] is None:
            return
        yield r, tree.at[r]
        tree.move(r, tree.at[r] + 1)


def _merger(n: int):
    def groups(t: pa.Table) -> pa.RecordBatch:
        """Rows of whole groups, each in the order of its runs: the first ``n`` of each."""
        codes, run = pc.dictionary_encode(t["g"].combine_chunks()).indices.to_numpy(), t["run"].to_numpy()
        new = codes[1:] != codes[:-1]
        starts = np.flatnonzero(np.r_[True, new])
        ends = np.r_[starts[1:], len(codes)]
        cuts = np.flatnonzero(np.r_[True, new | (run[1:] != run[:-1])])  # where a run of a group begins
        first, last = np.searchsorted(cuts, starts), np.searchsorted(cuts, ends)
        single = last - first == 1
        within = np.arange(len(codes)) - np.repeat(starts, ends - starts)
        rows = [np.flatnonzero(np.repeat(single, ends - starts) & (within < n))]
        score, item = t["s"].to_numpy(), t["i"].to_numpy()
        for k in np.flatnonzero(~single).tolist():
            begins = cuts[first[k] : last[k]].tolist()
            stops = [*begins[1:], int(ends[k])]
            runs = [list(zip((-score[a:b]).tolist(), item[a:b].tolist(), strict=True)) for a, b in zip(begins, stops, strict=True)]
            rows.append(np.array([begins[r] + at for r, at in merge_top(runs, n)], np.int64))
        taken = np.concatenate(rows)
        place = np.concatenate([within[rows[0]], *(np.arange(len(x)) for x in rows[1:])]) + 1
        out = t.select(["g", "s", "i"]).take(pa.array(taken)).append_column("r", pa.array(place.astype(np.int32)))
        return out.combine_chunks()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            codes = pc.dictionary_encode(t["g"].combine_chunks()).indices.to_numpy()
            at = int(np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])[-1])  # the last group may go on
            if at:
                yield from groups(t.slice(0, at).combine_chunks()).to_batches()
            held = t.slice(at)
        if held is not None:
            yield from groups(held.combine_chunks()).to_batches()

    return merge


def top_n(rows: DataFrame, group: str, score: str, item: str, n: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """(group, item, score, rank) of the ``n`` highest-scoring items of each group.

    ``score`` is numeric, ``item`` integral, ``group`` a string or integral column.
    The number of buckets is spark.sql.shuffle.partitions.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = rows.sparkSession
    kind = rows.schema[group].dataType
    kept = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(F.col(group).alias("g"), F.col(score).cast("double").alias("s"), F.col(item).cast("long").alias("i"))
    shape = [T.StructField("g", kind), T.StructField("s", T.DoubleType()), T.StructField("i", T.LongType())]
    runs = kept.mapInArrow(_run_maker(n, run_rows), T.StructType([*shape, T.StructField("run", T.LongType())]))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = runs.repartition(buckets, "g").sortWithinPartitions("g", "run", F.col("s").desc(), "i")
    merged = stored.mapInArrow(_merger(n), T.StructType([*shape, T.StructField("r", T.IntegerType())]))
    return merged.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("r").alias("rank"))
