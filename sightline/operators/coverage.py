"""How much of where an answer may lie a list of frames covers, and the greedy choice of frames.

Set-based: loci(query_id, video_id, locus_id, start_frame, end_frame, weight),
beliefs(query_id, video_id, pi), frames(query_id, video_id, frame).
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.config import MAX_ANSWERS, THRESHOLDS
from sightline.operators.grouped import matrix, over_groups
from sightline.session import cut


def interval_union(intervals: DataFrame, keys: list[str], start: str = "start_frame", end: str = "end_frame") -> DataFrame:
    """(keys, measure): integers in the union of closed intervals; empty ones count nothing."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = intervals.where(F.col(start) <= F.col(end)).withColumn("__new", (F.col(start) > F.coalesce(reached + 1, F.col(start) - 1)).cast("int"))
    islands = new.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = islands.groupBy(*keys, "__island").agg((F.max(end) - F.min(start) + 1).alias("m"))
    return each.groupBy(*keys).agg(F.sum("m").alias("measure"))


def kappa(loci: DataFrame, frames: DataFrame, answer_len: int = 25) -> DataFrame:
    """(query_id, video_id, kappa): weighted share of the loci that the frames' answer spans cover; 0 without frames."""
    key = ["query_id", "video_id", "locus_id"]
    some = loci.where("weight > 0")
    clipped = some.join(frames.select("query_id", "video_id", "frame").distinct(), ["query_id", "video_id"]).select(*key, F.greatest(F.col("frame") - (answer_len - 1), "start_frame").alias("s"), F.least("frame", "end_frame").alias("e"))
    covered = interval_union(clipped, key, "s", "e")
    share = some.join(covered, key, "left").withColumn("part", F.coalesce("measure", F.lit(0)) / (F.col("end_frame") - F.col("start_frame") + 1))
    return share.groupBy("query_id", "video_id").agg(F.least(F.lit(1.0), F.sum(F.col("weight") * F.col("part")) / F.sum("weight")).alias("kappa"))


def hit_probability(beliefs: DataFrame, kappas: DataFrame) -> DataFrame:
    """(query_id, probability): sum of pi * kappa, at most 1."""
    joined = beliefs.join(kappas, ["query_id", "video_id"], "left")
    return joined.groupBy("query_id").agg(F.least(F.lit(1.0), F.sum(F.col("pi") * F.coalesce("kappa", F.lit(0.0)))).alias("probability"))


def covering_frames(start: Column, end: Column, answer_len: int, last: Column | None = None) -> Column:
    """Frames whose answer spans cover [start, end], none past ``last``, repeats dropped."""
    n = F.greatest(F.lit(1), F.ceil((end - start + 1) / answer_len)).cast("int")
    clamp = lambda x: F.greatest(F.lit(0), F.least(x, end) if last is None else F.least(x, end, F.coalesce(last, end)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: clamp(start + i * answer_len - 1)))


def spread_frames(start: Column, end: Column, step: int) -> Column:
    """start + step // 2 and on by ``step``; the middle of a shorter locus."""
    first = start + step // 2
    return F.when(first <= end, F.sequence(first, end, F.lit(step))).otherwise(F.array(((start + end) / 2).cast("int")))


def anchor_first(anchor: Column, frames: Column) -> Column:
    """Frames by distance from the anchor, then by frame."""
    pairs = F.transform(frames, lambda f: F.struct(F.abs(f - anchor).alias("d"), f.alias("f")))
    return F.transform(F.array_sort(pairs), lambda p: p["f"])


def expand_locus(start: Column, end: Column, pad: Column | int, last: Column | None = None) -> tuple[Column, Column]:
    lo = F.greatest(F.lit(0), start - pad)
    hi = end + pad if last is None else F.least(end + pad, F.coalesce(last, end + pad))
    return lo, F.greatest(lo, hi)


def build_loci(candidates: DataFrame, fps: DataFrame, pad_seconds: float = 0.5) -> DataFrame:
    """(query_id, video_id, locus_id, start_frame, end_frame, weight, anchor) of candidates with cluster_id.

    Ranges are padded within [0, last frame]; weight is the fused score shared out
    over the candidates of a cluster within one video.  ``fps`` is (video_id, fps, last_frame).
    """
    share = F.count("*").over(Window.partitionBy("query_id", "video_id", "cluster_id"))
    rows = candidates.join(fps, "video_id", "left").withColumn("pad", F.greatest(F.lit(1), F.ceil(pad_seconds * F.coalesce("fps", F.lit(25.0)))).cast("int"))
    lo, hi = expand_locus(F.col("start_frame"), F.col("end_frame"), F.col("pad"), F.col("last_frame"))
    locus = F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy("rank")) - 1
    return rows.select("query_id", "video_id", locus.alias("locus_id"), lo.alias("start_frame"), hi.alias("end_frame"), (F.greatest("fused_score", F.lit(1e-9)) / share).alias("weight"), "anchor")


def coverage_of(frames: list[int], start: int, end: int, answer_len: int) -> float:
    """Share of the closed range that the answer spans of ``frames`` cover."""
    covered = set().union(*(range(max(start, f - answer_len + 1), min(end, f) + 1) for f in frames))
    return len(covered) / (end - start + 1) if end >= start else 0.0


def slots_needed(loci: DataFrame, fps: DataFrame, answer_len: int = 25) -> DataFrame:
    """(query_id, video_id, locus_id, frames, seconds, slots): how many answers a locus takes until it is covered for certain."""
    length = F.col("end_frame") - F.col("start_frame") + 1
    rows = loci.join(fps.select("video_id", "fps"), "video_id", "left")
    return rows.select("query_id", "video_id", "locus_id", length.alias("frames"), F.round(length / F.coalesce("fps", F.lit(25.0)), 6).alias("seconds"), F.greatest(F.lit(1), F.ceil(length / answer_len)).cast("int").alias("slots"))


def frame_pool(loci: DataFrame, beliefs: DataFrame, answer_len: int = 25, least: int = MAX_ANSWERS, per_locus: int | None = None) -> DataFrame:
    """(query_id, video_id, frame, score): frames that cover each locus, the anchor first; the best score of a frame counts.

    A query whose pool is smaller than ``least`` is spread again at half the step, and
    so on down to 1; only such queries are laid out again.  ``per_locus`` keeps that
    many frames of a locus.
    """
    rows = loci.join(beliefs, ["query_id", "video_id"]).select("query_id", "video_id", "start_frame", "end_frame", "weight", "anchor", "pi")
    inside = F.col("anchor").between(F.col("start_frame"), F.col("end_frame"))

    def laid_out(rows: DataFrame, step: int) -> DataFrame:
        frames = covering_frames(F.col("start_frame"), F.col("end_frame"), step)
        listed = F.when(inside, F.array_distinct(F.concat(F.array("anchor"), frames))).otherwise(frames)
        if per_locus is not None:
            listed = F.slice(listed, 1, per_locus)
        each = rows.select("query_id", "video_id", "pi", "weight", F.posexplode(listed).alias("k", "frame"))
        return each.groupBy("query_id", "video_id", "frame").agg(F.max(F.col("pi") * F.col("weight") / (F.col("k") + 1)).alias("score"))

    step, pool = answer_len, laid_out(rows, answer_len)
    while step > 1 and least > 1:
        step //= 2
        pool = cut(pool)
        small = cut(pool.groupBy("query_id").count().where(F.col("count") < least).select("query_id"))
        if small.isEmpty():
            break
        pool = pool.join(small, "query_id", "left_anti").unionByName(laid_out(rows.join(small, "query_id", "left_semi"), step))
    return pool


class _Covered:
    """What covering each frame of one video would still add, under growing sets of answers.

    A locus spreads its weight evenly over its frames; an answer takes what lies on
    the ``answer_len`` frames up to its own, for all loci at once.
    """

    def __init__(self, start: np.ndarray, end: np.ndarray, weight: np.ndarray, answer_len: int):
        use = (weight > 0) & (end >= start)
        start, end, weight = start[use].astype(np.int64), end[use].astype(np.int64), weight[use].astype(np.float64)
        self.length, self.total = answer_len, float(weight.sum())
        self.first = int(start.min()) if len(start) else 0
        size = int(end.max()) - self.first + 1 if len(end) else 0
        steps, held = np.zeros(size + 1), np.zeros(size + 1, np.int64)
        for at, sign in ((start - self.first, 1), (end - self.first + 1, -1)):
            np.add.at(steps, at, sign * weight / (end - start + 1))
            np.add.at(held, at, sign)
        self.worth = np.where(np.cumsum(held) > 0, np.cumsum(steps), 0.0)[:size]

    def copy(self) -> _Covered:
        """A state of its own, as far as this one came."""
        other = object.__new__(_Covered)
        other.__dict__ = self.__dict__ | {"worth": self.worth.copy()}
        return other

    def _span(self, frame):
        size = len(self.worth)
        return np.clip(frame - self.length + 1 - self.first, 0, size), np.clip(frame + 1 - self.first, 0, size)

    def gains(self, frames: np.ndarray) -> np.ndarray:
        """Of each frame on its own, all at once."""
        upto = np.r_[0.0, np.cumsum(self.worth)]
        a, b = self._span(frames)
        return np.round((upto[b] - upto[a]) / self.total, 12) if self.total else np.zeros(len(frames))

    def gain(self, frame: int) -> float:
        a, b = max(0, frame - self.length + 1 - self.first), max(0, frame + 1 - self.first)
        return round(float(self.worth[a:b].sum()) / self.total, 12) if self.total else 0.0

    def add(self, frame: int) -> None:
        a, b = max(0, frame - self.length + 1 - self.first), max(0, frame + 1 - self.first)
        self.worth[a:b] = 0.0


def lazy_greedy(candidates: list[tuple], gain_of, take, budget: int, seeds: list[int] = (), start: list[float] | None = None) -> list[tuple[int, float, str]]:
    """Greedy by (gain, score, order of entry) with re-evaluation only at the top of the heap.

    ``candidates`` are (score, ...); an entry is taken only when its gain was worked
    out after the latest choice.  ``seeds`` come first; ``start`` has the gains before
    any choice where those are known.  Gives (index, gain, source).
    """
    chosen, done = [], set()
    for k in list(dict.fromkeys(seeds))[:budget]:
        chosen.append((k, gain_of(k), "seed"))
        take(k)
        done.add(k)
    # Gains only shrink, so those from before the seeds are bounds and are looked at again at the top.
    when = 0 if start is not None else len(chosen)
    heap = [(-(start[k] if start is not None else gain_of(k)), -candidates[k][0], k, when) for k in range(len(candidates)) if k not in done]
    heapq.heapify(heap)
    while heap and len(chosen) < budget:
        gain, score, k, when = heapq.heappop(heap)
        if when == len(chosen):
            chosen.append((k, -gain, "greedy"))
            take(k)
        else:
            heapq.heappush(heap, (-gain_of(k), score, k, len(chosen)))
    return chosen


def localized_seeds(candidates: DataFrame, beliefs: DataFrame, pool: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, video_id, frame, seed): answers to place first, one a video and at most ``most`` a query.

    Anchors of candidates that the localised channel found, in its order; places left
    go to the best frames in ``pool`` of the likeliest other videos.
    """
    rank = F.try_element_at("ranks", F.lit("dense_localized"))
    best = candidates.where(rank.isNotNull()).groupBy("query_id", "video_id").agg(F.min(F.struct(rank.alias("rank"), (-F.col("fused_score")).alias("minus"), "shot_id", "anchor")).alias("b"))
    exact = best.select("query_id", "video_id", F.col("b.anchor").alias("frame"), F.lit(0).alias("kind"), F.col("b.rank").cast("double").alias("a"), F.col("b.minus").alias("b"))
    top = pool.groupBy("query_id", "video_id").agg(F.max_by("frame", F.struct("score", (-F.col("frame")).alias("minus"))).alias("frame"))
    other = beliefs.join(best.select("query_id", "video_id"), ["query_id", "video_id"], "left_anti").join(top, ["query_id", "video_id"])
    both = exact.unionByName(other.select("query_id", "video_id", "frame", F.lit(1).alias("kind"), (-F.col("pi")).alias("a"), F.lit(0.0).alias("b")))
    order = Window.partitionBy("query_id").orderBy("kind", "a", "b", "video_id")
    return both.withColumn("seed", F.row_number().over(order)).where(F.col("seed") <= most).select("query_id", "video_id", "frame", "seed")


ALLOCATION = "query_id string, rank int, video_id string, frame int, answer string, gain double, cumulative double, source string"


class _Strand:
    """One video's frames for one answer, in greedy order as far as anybody asks: gains do not depend on other strands."""

    def __init__(self, state: _Covered, frames: list[int], weights: list[float], gains: list[float]):
        self.state, self.frames, self.weights = state, frames, weights
        # Entries come by score and order of entry, so their number decides among equal gains.
        self.heap = [(-w * g, k, 0) for k, (w, g) in enumerate(zip(weights, gains, strict=True))]
        heapq.heapify(self.heap)
        self.order: list[tuple[int, float]] = []

    def take(self, k: int) -> float:
        gain = self.weights[k] * self.state.gain(self.frames[k])
        self.state.add(self.frames[k])
        return gain

    def at(self, i: int) -> tuple[int, float] | None:
        """(entry, gain) of the i-th choice."""
        while len(self.order) <= i and self.heap:
            gain, k, when = heapq.heappop(self.heap)
            if when == len(self.order) + 1:
                self.order.append((k, -gain))
                self.state.add(self.frames[k])
            else:
                heapq.heappush(self.heap, (-self.weights[k] * self.state.gain(self.frames[k]), k, len(self.order) + 1))
        return self.order[i] if i < len(self.order) else None


def allocate(pool: DataFrame, loci: DataFrame, beliefs: DataFrame, answer_len: int = 25, budget: int = MAX_ANSWERS, seeds: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """Ordered answers per query by greatest gain in the probability of a hit.

    ``pool`` is (query_id, video_id, frame, score[, answer, prob]): with answers the
    gain is pi * prob * what the frame adds for that (video, answer), as answers
    exclude each other.  pi is normalised first; cumulative is at most 1.
    ``answers`` ([query_id, ]answer, prob) go with every frame of ``pool``, which has none
    then: as if each frame were in it once for each, its score times prob.
    ``seeds`` (query_id, video_id, frame, seed) are placed first, in order of seed.
    One query is one group: its pool is bounded by its candidates.
    """
    own = "answer" in pool.columns
    null = lambda kind: F.lit(None).cast(kind)
    offered = pool.select("query_id", F.lit(2).alias("kind"), "video_id", F.col("frame").alias("a"), null("int").alias("b"), F.col("score").alias("x"), (F.col("prob") if own else F.lit(1.0)).alias("y"), (F.col("answer") if own else null("string")).alias("answer"))
    places = loci.join(beliefs, ["query_id", "video_id"], "left").select("query_id", F.lit(0).alias("kind"), "video_id", F.col("start_frame").alias("a"), F.col("end_frame").alias("b"), F.col("weight").alias("x"), F.coalesce("pi", F.lit(0.0)).alias("y"), null("string").alias("answer"))
    rows = offered.unionByName(places)
    if answers is not None:
        each = answers if "query_id" in answers.columns else pool.select("query_id").distinct().crossJoin(F.broadcast(answers))
        rows = rows.unionByName(each.select("query_id", F.lit(3).alias("kind"), null("string").alias("video_id"), null("int").alias("a"), null("int").alias("b"), null("double").alias("x"), F.col("prob").alias("y"), "answer"))
    if seeds is not None:
        rows = rows.unionByName(seeds.select("query_id", F.lit(1).alias("kind"), "video_id", F.col("frame").alias("a"), F.col("seed").cast("int").alias("b"), null("double").alias("x"), null("double").alias("y"), null("string").alias("answer")))
    given = answers is not None

    def run(g: pa.Table) -> list[tuple]:
        query, kind = g["query_id"][0].as_py(), g["kind"].to_numpy()
        cuts = np.searchsorted(kind, [0, 1, 2, 3, 4])
        part = lambda k: g.slice(cuts[k], cuts[k + 1] - cuts[k])
        number = lambda t, c: t[c].to_numpy(zero_copy_only=False)
        loci: dict[str, tuple[int, int]] = {}
        at = part(0)
        for k, v in enumerate(at["video_id"].to_pylist()):
            loci[v] = (loci[v][0] if v in loci else k, k + 1)
        start, end, weight, pi = (number(at, c) for c in ("a", "b", "x", "y"))
        total = sum(float(pi[a]) for a, _ in loci.values()) or 1.0
        faces = list(dict.fromkeys(zip(part(3)["answer"].to_pylist(), part(3)["y"].to_pylist(), strict=True))) if given else [(None, 1.0)]
        # Frames of a video and answer, by score; of repeats the first counts.
        strands: dict[tuple, dict[int, tuple[float, float]]] = {}
        t = part(2)
        for v, frame, score, prob, answer in zip(t["video_id"].to_pylist(), t["a"].to_pylist(), t["x"].to_pylist(), t["y"].to_pylist(), t["answer"].to_pylist(), strict=True):
            strands.setdefault((v, answer), {}).setdefault(frame, (score, prob))
        t = part(1)
        first = list(dict.fromkeys(zip(t["video_id"].to_pylist(), t["a"].to_pylist(), strict=True)))
        for v, frame in first:
            strands.setdefault((v, None), {}).setdefault(frame, (0.0, 1.0))
        made: dict[tuple, tuple[_Strand, float, list[float]]] = {}
        fresh: dict[str, _Covered] = {}
        for (v, answer), frames in strands.items():
            a, b = loci.get(v, (0, 0))
            state = fresh.get(v)
            if state is None:
                state = fresh[v] = _Covered(start[a:b], end[a:b], weight[a:b], answer_len)
            held = list(frames)
            gains = state.gains(np.array(held, np.int64)).tolist()
            strand = _Strand(state.copy(), held, [p for _, p in frames.values()], gains)
            made[v, answer] = (strand, float(pi[a]) / total if b > a else 0.0, [s for s, _ in frames.values()])
        chosen: list[tuple] = []
        for v, frame in first[:budget]:
            strand, factor, _ = made[v, None]
            k = strand.frames.index(frame)
            chosen.append((v, frame, None, factor * strand.take(k), "seed"))
            strand.heap = [x for x in strand.heap if x[1] != k]
            heapq.heapify(strand.heap)
        if first and given:
            raise ValueError("seeds have no answers")
        heap: list[tuple] = []

        def push(key, face, i):
            strand, factor, scores = made[key]
            if (found := strand.at(i)) is not None:
                k, gain = found
                answer, prob = faces[face] if given else (key[1], 1.0)
                heapq.heappush(heap, (-factor * prob * gain, -scores[k] * prob, key[0], strand.frames[k], answer or "", answer is not None, key[1] or "", face, i, k, key))

        for key in made:
            for face in range(len(faces)):
                push(key, face, 0)
        while heap and len(chosen) < budget:
            gain, _, v, frame, _, _, _, face, i, _, key = heapq.heappop(heap)
            chosen.append((v, frame, faces[face][0] if given else key[1], -gain, "greedy"))
            push(key, face, i + 1)
        running = np.minimum(1.0, np.cumsum([x[3] for x in chosen])).tolist() if chosen else []
        return [(query, i + 1, v, frame, answer, gain, c, source) for i, ((v, frame, answer, gain, source), c) in enumerate(zip(chosen, running, strict=True))]

    by = F.when(F.col("kind") == 2, -F.col("x"))
    return over_groups(rows, ["query_id"], ["kind", F.when(F.col("kind") == 0, F.col("video_id")), F.when(F.col("kind") == 1, F.col("b")), by, "video_id", "a", "answer", "b", "x"], run, ALLOCATION)


def trace(allocations: DataFrame) -> DataFrame:
    """(query_id, p1, p5, p20, p50, p100, expected_final, videos, answers): cumulative at the thresholds, the last value beyond the end."""
    at = [F.max(F.when(F.col("rank") <= k, F.col("cumulative"))).alias(f"p{k}") for k in THRESHOLDS]
    rows = allocations.groupBy("query_id").agg(*at, F.countDistinct("video_id").alias("videos"), F.count("*").alias("answers"))
    return rows.withColumn("expected_final", sum((F.col(f"p{k}") for k in THRESHOLDS[1:]), F.col("p1")) / len(THRESHOLDS))


def _hit_counts(paths: np.ndarray, lo: np.ndarray, hi: np.ndarray, answer_len: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, chance): every way in which a video's paths can hit its moments, as each path's number of hits, and how likely it is.

    Moment j starts at any frame from lo[j] to hi[j], all equally likely and apart from
    the other moments; a path hits it with a frame on the ``answer_len`` from its start on.
    """
    n = paths.shape[1]
    counts, chance = np.zeros((1, len(paths)), np.int64), np.ones(1)
    for j in range(n):
        a, b = min(lo[j], hi[j]), max(lo[j], hi[j]) + 1
        cuts = np.unique(np.clip(np.r_[a, b, paths[:, j] - answer_len + 1, paths[:, j] + 1], a, b))
        starts = cuts[:-1]
        hit = ((starts[:, None] <= paths[:, j]) & (paths[:, j] <= starts[:, None] + answer_len - 1)).astype(np.int64)
        kinds, of = np.unique(hit, axis=0, return_inverse=True)
        share = np.bincount(of.ravel(), np.diff(cuts) / (b - a))
        both = (counts[:, None] + kinds[None]).reshape(-1, len(paths))
        counts, of = np.unique(both, axis=0, return_inverse=True)
        chance = np.bincount(of.ravel(), np.outer(chance, share).ravel())
    return counts, chance


def allocate_moments(candidates: DataFrame, beliefs: DataFrame, spans: DataFrame, answer_len: int = 10, budget: int = MAX_ANSWERS) -> DataFrame:
    """(query_id, rank, video_id, frames, gain, cumulative): greedy on the expected best share of moments hit.

    ``candidates`` is (query_id, video_id, frames, score); ``spans`` (query_id,
    video_id, lo array<int>, hi array<int>) bounds where each moment starts, by
    default the candidates' own frames less or more the answer length.

    The expectation is exact and no video is left out: what a path adds depends on the
    chosen paths of its own video only, so each video's greedy order is worked out on
    its own, and as gains only shrink along it, the query's order is all of them by gain.
    Equal gains go by score, video_id, then frames.
    """
    joined = candidates.join(beliefs, ["query_id", "video_id"]).join(spans, ["query_id", "video_id"], "left")
    key = Window.partitionBy("query_id", "video_id")
    first = F.when(F.row_number().over(key.orderBy(F.desc("score"), "frames")) == 1, F.greatest("pi", F.lit(0.0)))
    each = joined.withColumn("first", first)
    of = Window.partitionBy("query_id")
    total, videos = F.sum("first").over(of), F.count("first").over(of)
    each = each.select("query_id", "video_id", "frames", "score", "lo", "hi", F.when(total > 0, F.greatest("pi", F.lit(0.0)) / total).otherwise(1 / videos).alias("share"))

    def run(g: pa.Table) -> list[tuple]:
        paths, share = matrix(g["frames"], np.int64), g["share"][0].as_py()
        lo, hi = g["lo"][0].as_py(), g["hi"][0].as_py()
        lo = paths.min(0) - answer_len if lo is None else np.asarray(lo, np.int64)
        hi = paths.max(0) + answer_len if hi is None else np.asarray(hi, np.int64)
        counts, chance = _hit_counts(paths, lo, hi, answer_len)
        hit, scores = counts.T / paths.shape[1], g["score"].to_pylist()
        best = np.zeros(len(chance))

        def take(k):
            np.maximum(best, hit[k], out=best)

        chosen = lazy_greedy([(s,) for s in scores], lambda k: round(share * float(chance @ np.maximum(0.0, hit[k] - best)), 12), take, min(budget, len(paths)))
        query, video = g["query_id"][0].as_py(), g["video_id"][0].as_py()
        return [(query, video, paths[k].tolist(), scores[k], gain, i) for i, (k, gain, _) in enumerate(chosen)]

    greedy = over_groups(each, ["query_id", "video_id"], [F.desc("score"), "frames"], run, "query_id string, video_id string, frames array<int>, score double, gain double, k int")
    order = Window.partitionBy("query_id").orderBy(F.desc("gain"), F.desc("score"), "video_id", "k")
    ranked = greedy.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget)
    running = F.sum("gain").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.select("query_id", "rank", "video_id", "frames", "gain", F.least(F.lit(1.0), running).alias("cumulative"))


def apply_pins(allocations: DataFrame, pins: DataFrame, limit: int = MAX_ANSWERS) -> DataFrame:
    """Pinned rows first, then the allocation without them, cut to ``limit``; the trace goes with its row's key.

    ``pins`` is (query_id, pos, video_id, frame[, answer]).
    """
    answer = F.col("answer") if "answer" in pins.columns else F.lit(None).cast("string")
    head = pins.select("query_id", F.lit(0).alias("head"), F.col("pos").cast("int").alias("at"), "video_id", "frame", answer.alias("answer"), F.lit(0.0).alias("gain"), F.lit("pinned").alias("source"))
    tail = allocations.select("query_id", F.lit(1).alias("head"), F.col("rank").alias("at"), "video_id", "frame", "answer", "gain", "source")
    key = Window.partitionBy("query_id", "video_id", "frame", F.coalesce("answer", F.lit(""))).orderBy("head", "at")
    kept = head.unionByName(tail).withColumn("n", F.row_number().over(key)).where("n = 1")
    order = Window.partitionBy("query_id").orderBy("head", "at")
    placed = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    running = F.sum("gain").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.select("query_id", "rank", "video_id", "frame", "answer", "gain", F.least(F.lit(1.0), running).alias("cumulative"), "source")
