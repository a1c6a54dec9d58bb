"""The general operators for training data against brute force, with their edge cases."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import queries, rank_fusion, similarity_clusters, term_weight, top_n


def brute_fusion(rows, eta=60.0):
    by = defaultdict(lambda: defaultdict(dict))
    for q, i, scores in rows:
        if q is not None and i is not None:
            by[q][i] |= {c: s for c, s in (scores or {}).items() if s is not None and not math.isnan(s)}
    out = {}
    for q, items in by.items():
        for i, own in items.items():
            total = 0.0
            for c in sorted({c for x in items.values() for c in x}):
                if c in own:
                    total += 1 / (eta + 1 + sum(x[c] > own[c] for x in items.values() if c in x))
            out[q, i] = total
    return out


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_fusion(spark, hot_rows):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        q = 1 if rng.random() < 0.4 else rng.randrange(2, 30)
        scores = {c: rng.choice([None, math.nan, float(rng.randrange(6)), rng.random() * 10**k]) for k, c in enumerate("abc") if rng.random() < 0.8}
        rows.append((q, i, scores))
    rows += [(None, 1000, {"a": 1.0}), (99, 1001, None), (99, 1002, {}), (99, None, {"a": 5.0}), (1, None, {"a": 5.0, "b": 1e9})]
    df = spark.createDataFrame(rows, "q long, i long, s map<string,double>").withColumn("rank", F.lit("clash")).withColumn("fused_score", F.lit("clash"))
    fused = rank_fusion.fuse_maps(df, "q", "i", "s", hot_rows=hot_rows)
    got, want = {(r[0], r[1]): r[2] for r in fused.collect()}, brute_fusion(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    first = dict(map(tuple, rank_fusion.heads(fused, "q", "i").collect()))
    for q, i in first.items():
        assert i == min((k[1] for k in got if k[0] == q), key=lambda i: (-got[q, i], i))
    assert rank_fusion.fuse_maps(df.where("false"), "q", "i", "s").count() == 0


def test_range_does_not_prevail(spark):
    rows = [(1, 1, {"big": 1e9, "x": 0.1, "y": 0.1}), (1, 2, {"big": 1.0, "x": 0.9, "y": 0.9})]
    fused = rank_fusion.fuse_maps(spark.createDataFrame(rows, "q long, i long, s map<string,double>"), "q", "i", "s")
    assert [tuple(r) for r in rank_fusion.heads(fused, "q", "i").collect()] == [(1, 2)]


def test_merge_of_runs():
    rng = random.Random(3)
    for runs_n in (0, 1, 2, 3, 7, 16):
        rows = [(rng.randrange(6), -float(rng.randrange(9)), k) for k in range(200)]
        runs = [sorted(rows[k::runs_n]) for k in range(runs_n)] if runs_n else []
        want = []
        for g in range(6):
            want += sorted(r for r in rows if r[0] == g)[:5]
        got = []
        for g in range(6):
            own = [[r for r in run if r[0] == g] for run in runs]
            got += [own[r][at] for r, at in top_n.merge_top(own, 5)]
        assert got == (want if runs_n else [])


@pytest.mark.parametrize("run_rows", [7, 1 << 20])
def test_top_n(spark, run_rows):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.5 else f"v{rng.randrange(40)}", float(rng.randrange(8)), i) for i in range(1500)]
    bad = [(None, 1.0, 5000), ("v1", None, 5001), ("v1", math.nan, 5002), ("v1", 9.0, None), ("hot", 9.0, None)]
    df = spark.createDataFrame(rows + bad, "v string, s double, i long").withColumn("g", F.lit(1)).withColumn("r", F.lit("clash"))
    got = sorted((v, rank, i) for v, i, _, rank in top_n.top_n(df.repartition(5), "v", "s", "i", 12, run_rows).collect())
    want = []
    for v in {r[0] for r in rows}:
        want += [(v, k + 1, i) for k, (_, i) in enumerate(sorted((-s, i) for g, s, i in rows if g == v)[:12])]
    assert got == sorted(want)
    assert top_n.top_n(df.where("false"), "v", "s", "i", 3).count() == 0
    ties = spark.createDataFrame([("a", 1.0, 3), ("a", 1.0, 1), ("a", 1.0, 2)], "v string, s double, i long")
    assert [r["i"] for r in top_n.top_n(ties, "v", "s", "i", 2).orderBy("rank").collect()] == [1, 2]


@pytest.mark.parametrize("frequent", [200_000, 3])
def test_term_weights(spark, monkeypatch, frequent):
    monkeypatch.setattr(term_weight, "FREQUENT", frequent)
    docs = {1: "a a a b c".split(), 2: "a b".split(), 3: [], 4: "d d d d a".split()}
    df = spark.createDataFrame([(k, v) for k, v in docs.items()] + [(5, None), (None, ["a", "z"])], "k long, t array<string>")
    col = term_weight.Collection.of(term_weight.count_terms(df, "k", "t"))
    got = {(r["record_key"], r["term"]): r for r in col.score(col.counts).collect()}
    smoothed = sum(len(t) ** 0.75 for t in docs.values())
    for k, terms in docs.items():
        for t in set(terms):
            joint, total = terms.count(t), sum(x.count(t) for x in docs.values())
            want = max(0.0, math.log(joint * smoothed / (total * len(terms) ** 0.75)))
            r = got.pop((k, t))
            assert abs(r["ppmi"] - want) < 1e-9 and r["df"] == sum(t in x for x in docs.values()) and r["joint"] == joint
    assert not got
    asked = term_weight.count_terms(spark.createDataFrame([(9, ["d", "unseen", "d"])], "k long, t array<string>"), "k", "t")
    rows = {r["term"]: r for r in col.score(asked).collect()}
    assert rows["d"]["joint"] == 2 and rows["d"]["df"] == 1 and rows["unseen"]["df"] == 0 and rows["unseen"]["ppmi"] > 0
    empty = term_weight.Collection.of(term_weight.count_terms(df.where("false"), "k", "t"))
    assert empty.score(empty.counts).count() == 0


def clusters_of(spark, vectors, **kw):
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "id long, v array<float>")
    return {r["id"]: r for r in similarity_clusters.cluster(df, **kw).collect()}


def test_clusters_of_cliques(spark, monkeypatch):
    monkeypatch.setattr(similarity_clusters, "CHUNK", 64)
    rng = np.random.default_rng(5)
    vectors, truth = {}, {}
    for c in range(60):
        center = rng.standard_normal(64)
        for _ in range(120 if c == 0 else 1 + c % 4):
            v = center / np.linalg.norm(center) + rng.standard_normal(64) * 0.018
            vectors[len(vectors)] = v / np.linalg.norm(v)
            truth[len(truth)] = c
    got = clusters_of(spark, vectors)
    assert got.keys() == vectors.keys()
    names = defaultdict(set)
    for k, r in got.items():
        names[truth[k]].add(r["pivot"])
        assert r["size"] == sum(t == truth[k] for t in truth.values())
        assert float(vectors[k] @ vectors[r["medoid"]]) >= 0.92 - 1e-5
    assert all(len(x) == 1 for x in names.values()) and len(set.union(*names.values())) == len(names)


def test_clusters_of_a_chain(spark):
    """Neighbours are similar, ends are not: every member must be similar to its cluster's medoid."""
    angles = np.linspace(0, math.pi, 60)
    vectors = {k: np.r_[math.cos(a), math.sin(a), np.zeros(6)] for k, a in enumerate(angles)}
    got = clusters_of(spark, vectors)
    assert got.keys() == vectors.keys()
    for k, r in got.items():
        assert float(vectors[k] @ vectors[r["medoid"]]) >= 0.92 - 1e-5
    assert len({r["pivot"] for r in got.values()}) >= 4


def test_vectors_that_do_not_count(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [])]
    got = {r["id"]: r for r in similarity_clusters.cluster(spark.createDataFrame(rows, "id long, v array<float>").withColumn("pivot", F.lit("clash"))).collect()}
    assert got.keys() == {1, 2} and got[1]["pivot"] == got[2]["pivot"] and got[1]["size"] == 2
    assert similarity_clusters.cluster(spark.createDataFrame([], "id long, v array<float>")).count() == 0


def test_frame_clusters_edges(spark):
    frames = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "b", 2), (5, "b", 3), (6, "zz", 1), (None, "a", 1)], "frame_key long, video_id string, n int").withColumn("cluster_id", F.lit(-1)).withColumn("v", F.lit("clash"))
    vectors = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 1, [1.0, 0.0]), ("b", 1, [2.0, 0.1]), ("b", 2, [0.0, 0.0]), ("b", 3, None)], "video_id string, n int, embedding array<float>")
    found = similarity_clusters.frame_clusters(frames, vectors)
    assert sorted(map(tuple, similarity_clusters.with_leads(found).collect())) == [(1, 1), (2, 1), (3, 1)]
    assert similarity_clusters.frame_clusters(frames.where("false"), vectors).count() == 0
    one = similarity_clusters.describe(found.select(F.col("frame_key").alias("id"), "pivot", "size", "closeness")).collect()
    assert len(one) == 1 and len(one[0]["typical"]) == 3


def test_described_clusters(spark, small):
    rows = queries.p2_describe(spark, small).collect()
    assert rows and all(r["size"] >= len(r["typical"]) > 0 for r in rows)


def test_shots_of_candidates_get_clusters(spark, small):
    """Every latest candidate with a video, placed and compared by brute force; p2_describe_shots counts all of them."""
    import pandas as pd

    read = lambda t: pd.read_parquet(f"{small}/{t}.parquet")
    c = read("candidates").sort_values("ingested_at", kind="stable").drop_duplicates("cand_id", keep="last")
    k = read("keyframes").dropna(subset=["frame_idx"]).sort_values("n").drop_duplicates(["video_id", "frame_idx"])
    frames = {v: g.sort_values("frame_idx") for v, g in k.groupby("video_id")}
    unit = {}
    for r in read("vectors").dropna(subset=["embedding"]).itertuples():
        x = np.asarray(r.embedding, np.float64)
        if np.linalg.norm(x) > 0:
            unit[r.video_id, r.n] = x / np.linalg.norm(x)
    shot = {}
    for r in c[c["video_id"].notna()].itertuples():
        at = r.anchor if not pd.isna(r.anchor) else (r.start_frame + r.end_frame) // 2
        if r.video_id in frames and not pd.isna(at):
            g = frames[r.video_id]
            n = g["n"].to_numpy()[np.abs(g["frame_idx"].to_numpy() - at).argmin()]
            if (r.video_id, n) in unit:
                shot[r.cand_id] = (r.video_id, n)
    keys = sorted(set(shot.values()))
    v = np.stack([unit[x] for x in keys])
    similar = dict(zip(keys, v @ v.T >= 0.92, strict=True))
    got = {r["cand_id"]: r["cluster_id"] for r in queries.p2_shots(spark, small).collect()}
    assert got.keys() == shot.keys() and len(got) > 1000
    lead = {x: min(y for y, s in zip(keys, similar[x], strict=True) if s) for x in keys}
    by = defaultdict(set)
    for i, p in got.items():
        by[p].add(lead[shot[i]])
    assert all(len(x) == 1 for x in by.values()) and len(by) == len(set(lead.values()))
    assert sum(r["size"] for r in queries.p2_describe_shots(spark, small).collect()) == len(shot)


@pytest.mark.parametrize("hashes", [2, 3])
def test_lone_pairs_at_the_threshold(spark, hashes):
    """Lone pairs of cosine .922, their halves in different tasks: what the tables miss does not grow with the hashes."""
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b = 0.922 * a + math.sqrt(1 - 0.922**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(at + k, x.tolist()) for at, m in ((0, a), (10_000, b)) for k, x in enumerate(m)]
    halves = spark.createDataFrame(rows, "id long, v array<float>").repartitionByRange(2, "id")
    _, links = similarity_clusters.candidate_links(halves, 0.92, dim=64, hashes=hashes)
    found = {tuple(sorted((r["a"], r["b"]))) for r in links.collect()}
    missed = sum((k, 10_000 + k) not in found for k in range(1500))
    assert missed <= 0.02 * 1500, missed
    assert all(b - a == 10_000 for a, b in found)


def test_hashes_and_tables_grow_with_the_leaders():
    assert [similarity_clusters.hashes_for(n, 64) for n in (0, 4_000_000, 5_000_000, 600_000_000)] == [2, 2, 3, 4]
    tables = [similarity_clusters.tables_for(16, h, 0.92, 64) for h in (2, 3, 4)]
    assert tables[0] == 16 and tables[0] < tables[1] < tables[2]


@pytest.mark.parametrize("small", [64, 3])
def test_links_of_large_buckets(monkeypatch, small):
    """Whatever the size of a bucket and of a batch, a row is linked to the first row before it that it resembles."""
    import pyarrow as pa

    monkeypatch.setattr(similarity_clusters, "SMALL", small)
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 1 << 63, (12, 2), dtype=np.int64)
    codes = np.sort(rng.integers(0, 6, 900))
    kind = rng.integers(0, 12, 900)
    rows = pa.record_batch([pa.array(codes), pa.array(np.arange(900)), pa.array(kinds[kind, 0]), pa.array(kinds[kind, 1])], names=["code", "id", "s0", "s1"])
    first = {}
    want = {(k, first[c, t]) for k, (c, t) in enumerate(zip(codes.tolist(), kind.tolist(), strict=True)) if first.setdefault((c, t), k) != k}
    for size in (7, 100, 900):
        out = similarity_clusters._bucket_links(0.92)(iter([rows.slice(a, size) for a in range(0, 900, size)]))
        assert {(a, b) for r in out for a, b in zip(r["a"].to_pylist(), r["b"].to_pylist(), strict=True)} == want


def test_scenes_just_below_the_threshold(spark):
    """Cosine .912 between scenes and .95 within: a row whose first or closest look-alike by sketch is of another scene still gets to its own."""
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(60):
        q = np.linalg.qr(rng.standard_normal((64, 33)))[0].T
        for k, e in enumerate(q[9:]):
            vectors.append(math.sqrt(0.95) * (math.sqrt(0.96) * q[0] + math.sqrt(0.04) * q[1 + k // 3]) + math.sqrt(0.05) * e)
    v = np.stack(vectors)
    truth = np.arange(len(v)) // 3
    assert ((v @ v.T >= 0.92) == (truth[:, None] == truth)).all()
    ids = rng.permutation(len(v))
    df = spark.createDataFrame([(int(ids[k]), [float(x) for x in v[k]]) for k in range(len(v))], "id long, v array<float>").repartition(16)
    by = defaultdict(set)
    for r in similarity_clusters.cluster(df).collect():
        by[r["pivot"]].add(int(truth[np.flatnonzero(ids == r["id"])[0]]))
        assert r["size"] == 3
    assert all(len(x) == 1 for x in by.values()) and len(by) == len(v) // 3


@pytest.mark.parametrize("size", [50_000, 300])
def test_no_lone_pair_is_missed(spark, monkeypatch, size):
    """All pairs of cosine .9205 whose halves lie in different tasks, in one pass of exact comparisons as in many."""
    monkeypatch.setattr(similarity_clusters, "PASS", size)
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal((2, 800, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b = 0.9205 * a + math.sqrt(1 - 0.9205**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(at + k, x.tolist()) for at, m in ((0, a), (10_000, b)) for k, x in enumerate(m)]
    halves = spark.createDataFrame(rows, "id long, v array<float>").repartitionByRange(2, "id")
    by = defaultdict(set)
    for r in similarity_clusters.cluster(halves).collect():
        by[r["pivot"]].add(r["id"])
    assert sorted(map(sorted, by.values())) == [[k, 10_000 + k] for k in range(800)]


@pytest.mark.parametrize("size", [50_000, 16])
def test_chains_leave_no_closer_medoid_and_no_lone_pair(spark, monkeypatch, size):
    """Similarity that is no equivalence, without any candidate link: exact comparison alone gives whole clusters."""
    monkeypatch.setattr(similarity_clusters, "PASS", size)
    monkeypatch.setattr(similarity_clusters, "candidate_links", lambda vectors, *_: (vectors.select("id", "v"), spark.createDataFrame([], "a long, b long")))
    rng = np.random.default_rng(6)
    vectors = {k: np.r_[math.cos(a), math.sin(a), rng.standard_normal(4) * 0.15] for k, a in enumerate(np.linspace(0, 6, 150))}
    got = clusters_of(spark, vectors)
    assert got.keys() == vectors.keys()
    unit = np.stack([vectors[k] / np.linalg.norm(vectors[k]) for k in range(150)])
    similar = unit @ unit.T >= 0.92
    lone = [k for k, r in got.items() if r["size"] == 1]
    assert all(similar[k, r["medoid"]] for k, r in got.items())
    assert not any(similar[a, b] for a in lone for b in lone if a != b)
    sizes = defaultdict(int)
    for r in got.values():
        sizes[r["pivot"]] += 1
    assert all(sizes[r["pivot"]] == r["size"] for r in got.values()) and len(sizes) > 1


def test_exact_pairs_and_closest_medoids(spark, monkeypatch):
    """Several blocks and squares against brute force: every similar pair once, of new rows those with any other, and the closest medoid."""
    monkeypatch.setattr(similarity_clusters, "PASS", 40)
    rng = np.random.default_rng(12)
    v = rng.standard_normal((200, 4)).astype(np.float32)
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    cosine = unit @ unit.T
    records = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<float>")
    pairs = {(a, b) for a in range(200) for b in range(a) if cosine[a, b] >= 0.92}
    sort = lambda links: sorted((max(r), min(r)) for r in links.collect())
    assert sort(similarity_clusters._exact_links(records, None, 0.92)) == sorted(pairs)
    new = spark.createDataFrame([(k,) for k in range(0, 200, 3)], "id long")
    assert set(sort(similarity_clusters._exact_links(records, new, 0.92))) == {p for p in pairs if p[0] % 3 == 0 or p[1] % 3 == 0}
    placed = spark.createDataFrame([(k, k % 50, k % 50) for k in range(200)], "id long, pivot long, medoid long")
    homes = {r["id"]: r for r in similarity_clusters._closer_homes(placed, records, 0.92).collect()}
    want = {k: int(cosine[k, :50].argmax()) for k in range(50, 200) if cosine[k, :50].max() >= 0.92}
    assert {k: r["medoid"] for k, r in homes.items()} == {k: m for k, m in want.items() if m != k % 50}


def test_a_hot_cluster_goes_through_partial_sums(spark, monkeypatch):
    """One cluster holds most rows; its medoid and closeness are those of its mean, as for any other."""
    monkeypatch.setattr(similarity_clusters, "CHUNK", 50)
    rng = np.random.default_rng(11)
    base = rng.standard_normal((3, 16))
    vectors = {k: base[0 if k < 300 else 1 + k % 2] * 3 + rng.standard_normal(16) * 0.1 for k in range(330)}
    got = clusters_of(spark, vectors)
    by = defaultdict(list)
    for k, r in got.items():
        by[r["pivot"]].append(k)
    assert sorted(map(len, by.values())) == [15, 15, 300]
    for members in by.values():
        unit = np.stack([vectors[k] / np.linalg.norm(vectors[k]) for k in members]).astype(np.float64)
        mean = unit.sum(0) / np.linalg.norm(unit.sum(0))
        close = dict(zip(members, unit @ mean, strict=True))
        assert all(abs(got[k]["closeness"] - c) < 1e-5 for k, c in close.items())
        assert close[got[members[0]]["medoid"]] > max(close.values()) - 1e-5


def test_members_go_to_the_closest_medoid(spark):
    """A point between two groups that its first pivot does not suit ends where it is more similar; closeness stays at most 1."""
    rng = np.random.default_rng(4)
    rows = {}
    for k in range(200):
        a = (k % 40) / 40 * math.pi
        v = np.r_[math.cos(a), math.sin(a), rng.standard_normal(6) * 0.02]
        rows[k] = v
    got = clusters_of(spark, rows)
    assert got.keys() == rows.keys() and max(r["closeness"] for r in got.values()) <= 1 + 1e-9
    for k, r in got.items():
        m = rows[r["medoid"]]
        assert rows[k] @ m / np.linalg.norm(rows[k]) / np.linalg.norm(m) >= 0.92 - 1e-5
