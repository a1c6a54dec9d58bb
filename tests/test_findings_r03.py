"""One test for each finding of round 3, small enough to run with all others."""

from __future__ import annotations

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sightline.operators import align, coverage, dense


def expected_best(paths, lo, hi, length):
    """The mean over every start of every moment, one by one."""
    starts = list(itertools.product(*(range(a, b + 1) for a, b in zip(lo, hi, strict=True))))
    return sum(max((np.mean([s <= f <= s + length - 1 for s, f in zip(at, p, strict=True)]) for p in paths), default=0.0) for at in starts) / len(starts)


def test_f11_no_video_and_no_start_is_left_out(spark):
    """25 equally likely videos and a very unlikely one: all are answered, with exact gains."""
    paths = [("q", f"v{k:02}", f, 1.0 / (k + 1)) for k in range(26) for f in ([10, 20], [10, 26])]
    candidates = spark.createDataFrame(paths, "query_id string, video_id string, frames array<int>, score double")
    pi = {f"v{k:02}": 1e-6 if k == 25 else 1.0 for k in range(26)}
    beliefs = spark.createDataFrame([("q", v, p) for v, p in pi.items()], "query_id string, video_id string, pi double")
    none = spark.createDataFrame([], "query_id string, video_id string, lo array<int>, hi array<int>")
    rows = sorted(coverage.allocate_moments(candidates, beliefs, none, 4).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, 53)) and len({r["video_id"] for r in rows}) == 26
    lo, hi, taken = [6, 16], [14, 30], {}
    for r in rows:
        own = taken.setdefault(r["video_id"], [])
        before = expected_best(own, lo, hi, 4)
        own.append(list(r["frames"]))
        share = pi[r["video_id"]] / sum(pi.values())
        assert r["gain"] == pytest.approx(share * (expected_best(own, lo, hi, 4) - before), abs=1e-11)
    gains = [r["gain"] for r in rows]
    assert gains == sorted(gains, reverse=True) and all(g > 0 for g in gains)


def test_f11_allocate_trake_keeps_all_videos(spark, small):
    from sightline.plans import reference

    aligned = reference._aligned(spark, small)
    rows = reference.allocate_trake(spark, small).collect()
    assert len(rows) == min(100, aligned.count())
    assert len({r["video_id"] for r in rows}) > min(20, aligned.select("video_id").distinct().count() - 1)


def test_f1_f9_cycles_of_a_long_video_fit_memory():
    rng = np.random.default_rng(1)
    v = np.tile(rng.normal(size=(50, 8)), (120, 1))
    tracemalloc.start()
    got = align.detect_cycles(v, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:2] == [(0, 50), (50, 100)] and peak < 20e6  # the square of 6,000 rows takes 288 MB
    lags = np.arange(8, 200)
    g = v[:400] @ v[:400].T
    assert np.allclose(align.lag_means(v[:400], lags), [np.diagonal(g, k).mean() for k in lags], atol=1e-12)


class Shared:
    def __init__(self, value):
        self.value = value


def batches(v, size):
    keys = [f"v{k // 7}" for k in range(len(v))]
    for a in range(0, len(v), size):
        own = v[a : a + size]
        yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + size]), pa.array(range(a, a + len(own)), pa.int32()), pa.array(own.tolist(), pa.list_(pa.float32()))], names=["video_id", "n", "v"])


def test_f6_a_scan_is_bounded_and_exact():
    rng = np.random.default_rng(3)
    q, v = dense._unit(rng.normal(size=(2000, 4))), rng.integers(-2, 3, (4000, 4)) + 0.5
    made = list(batches(v, 4000))
    tracemalloc.start()
    rows = [r for b in dense._scan(Shared(([str(k) for k in range(2000)], q)), 20)(iter(made)) for r in zip(*(b[c].to_pylist() for c in ("query_id", "video_id", "n", "score")), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and len(rows) == 2000 * 20  # 2,000 x 4,000 scores alone take 64 MB, the former scan 300 MB
    score = np.round(q @ dense._unit(v).T, 9)
    for k in (0, 77, 1999):
        want = sorted((-score[k, n], f"v{n // 7}", n) for n in range(4000))[:20]
        assert [(v, n) for i, v, n, _ in rows if i == str(k)] == [(v, n) for _, v, n in want]


def test_f2_ties_do_not_pile_up():
    """All keyframes alike: a task hands on no more than its best, the first by key."""
    made = list(batches(np.ones((3000, 4)), 500))
    got = list(dense._scan(Shared((["a", "b"], dense._unit(np.ones((2, 4))))), 50)(iter(made)))
    want = sorted((f"v{n // 7}", n) for n in range(3000))[:50]
    rows = [r for b in got for r in zip(b["query_id"].to_pylist(), b["video_id"].to_pylist(), b["n"].to_pylist(), strict=True)]
    assert [(v, n) for q, v, n in rows if q == "a"] == want and len(rows) == 100


def test_f3_a_video_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(dense, "GROUP_CELLS", 64)
    monkeypatch.setattr(dense, "KEYFRAMES_A_GROUP", 16)
    rng = np.random.default_rng(5)
    v, t = rng.normal(size=(100, 4)).astype(np.float32), rng.normal(size=(12, 2, 2, 4)).astype(np.float32)
    vectors = spark.createDataFrame([("v", n, x.tolist()) for n, x in enumerate(v)], "video_id string, n int, embedding array<float>")
    texts = spark.createDataFrame([(f"q{k}", x.tolist()) for k, x in enumerate(t)], "query_id string, towers array<array<array<float>>>")
    found = dense.similarities(texts.selectExpr("query_id", "'v' as video_id"), texts, vectors, vectors.selectExpr("video_id", "n", "n * 10 as frame"))
    rows = found.collect()
    unit = dense._unit(v.astype(np.float64))
    assert len({(r["query_id"], r["n"]) for r in rows}) == len(rows) == 1200
    for r in rows:
        assert np.allclose(r["sims"], (t[int(r["query_id"][1:])].astype(np.float64) @ unit[r["n"]]).max(0)) and r["frame"] == 10 * r["n"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    groups = found.selectExpr("spark_partition_id() as p").distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert groups > 1  # one video was one group, hence one task


def test_f7_groups_cost_little(spark):
    """20,000 groups of a few rows, without a pandas call for each."""
    import time

    from sightline.operators import review

    videos = spark.range(20_000).selectExpr("cast(id div 50 as string) as query_id", "cast(id as string) as video_id", "cast(id % 50 + 1 as int) as position", "false as rescued")
    offered = videos.selectExpr("query_id", "video_id", "explode(array('fused', 'temporal', 'locus')) as family").selectExpr("*", "explode(array(1, 2)) as place").selectExpr("*", "place * 900 + length(family) as frame")
    fps = spark.createDataFrame([("0", 25.0)], "video_id string, fps double")
    found = review.review_frames(videos, offered, fps)
    began = time.time()
    frames = {}
    for r in found.collect():
        frames.setdefault((r["query_id"], int(r["video_id"])), []).append((r["frame"], r["family"]))
    assert time.time() - began < 25
    assert len(frames) == 20_000 and all(x == [(905, "fused"), (1808, "temporal")] for x in frames.values())


def test_f8_clusters_of_a_full_query_are_quick(spark):
    """500 candidates that all lead: each was compared with a new copy of all leaders before it."""
    from sightline.operators import channels

    rng = np.random.default_rng(8)
    v = np.vstack([np.eye(250), np.eye(250) + 0.001 * rng.random((250, 250))])[rng.permutation(500)]
    rows = spark.createDataFrame([(q, k, x.tolist()) for q in ("a", "b") for k, x in enumerate(v, 1)], "query_id string, rank int, embedding array<float>")
    got = channels.leader_clusters(rows).orderBy("query_id", "rank").collect()
    leaders, want = [], []
    for x in v.astype(np.float32).astype(np.float64):
        u = x / np.linalg.norm(x)
        near = [k for k, l in enumerate(leaders) if l @ u >= 0.92]
        want.append(near[0] if near else len(leaders))
        if not near:
            leaders.append(u)
    assert [r["cluster_id"] for r in got] == want * 2 and len(leaders) == 250


def test_f4_answers_go_with_every_frame(spark):
    """Answers given apart say the same as a pool that has each frame once for each."""
    import random

    from pyspark.sql import functions as F

    from test_reference import random_model

    rng = random.Random(4)
    models = [(f"q{k}", random_model(rng)) for k in range(8)]
    loci = spark.createDataFrame([(q, *x) for q, (l, _, _) in models for x in l], "query_id string, video_id string, locus_id int, start_frame int, end_frame int, weight double")
    beliefs = spark.createDataFrame([(q, v, p) for q, (_, pi, _) in models for v, p in pi.items()], "query_id string, video_id string, pi double")
    pool = spark.createDataFrame([(q, *x) for q, (_, _, p) in models for x in p], "query_id string, video_id string, frame int, score double")
    answers = spark.createDataFrame([("7", 0.5), ("6", 0.25), ("8", 0.25)], "answer string, prob double")
    crossed = pool.crossJoin(answers).withColumn("score", F.col("score") * F.col("prob"))
    key = ["query_id", "rank", "video_id", "frame", "answer", "gain", "cumulative", "source"]
    got, want = ([tuple(r) for r in x.select(*key).orderBy("query_id", "rank").collect()] for x in (coverage.allocate(pool, loci, beliefs, answers=answers), coverage.allocate(crossed, loci, beliefs)))
    assert got == want and len(got) > 100


def test_f5_many_terms_are_searched_in_blocks(spark, monkeypatch):
    from sightline.operators import text_search

    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(k, " ".join(f"wort{w}" for w in rng.integers(0, 60, 12))) for k in range(300)], "doc_id long, text string")
    index = text_search.TextIndex.build(docs)
    asked = spark.createDataFrame([(f"q{q}", f"wort{w}", 1) for q in range(50) for w in set(rng.integers(0, 70, 6).tolist())], "query_id string, term string, qtf long")
    want = sorted(map(tuple, index.search(asked, 10).collect()))
    monkeypatch.setattr(text_search, "FEW_TERMS", 40)
    plan = index.search(asked, 10)
    assert sorted(map(tuple, plan.collect())) == want and len(want) > 300
    # Pairs of all queries and documents that share a term were formed and shuffled.
    assert "MapInArrow" in plan._jdf.queryExecution().toString()


def test_f10_equal_names_are_looked_up_once(spark):
    from sightline.operators import text_search

    titles = spark.createDataFrame([(f"v{k}", f"the {w} of number {k}") for k, w in enumerate(["harbour", "mountain", "festival"] * 30)], "doc_id string, text string")
    index = text_search.GramIndex.build(titles)
    names = [("a", "harbour"), ("b", "harbour"), ("c", "harbour"), ("c", "festival"), ("d", "festival"), ("d", "harbour"), ("d", "harbour")]
    asked = spark.createDataFrame(names, "query_id string, entity string")
    found = index.search(asked, 5)
    assert found.columns == ["query_id", "doc_id", "score", "rank"]
    got = {q: sorted((r["rank"], r["doc_id"], r["score"]) for r in found.collect() if r["query_id"] == q) for q in "abcd"}
    assert got["a"] == got["b"] and got["c"] == got["d"] and got["a"] != got["c"] and all(len(x) == 5 for x in got.values())
    for q in "ac":
        alone = index.search(asked.where(f"query_id = '{q}'"), 5).collect()
        assert sorted((r["rank"], r["doc_id"], r["score"]) for r in alone) == got[q]
    assert "set_id" in found._jdf.queryExecution().toString()  # each query was summed up on its own
