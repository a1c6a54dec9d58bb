"""The engine end to end on small tables, and from a corpus folder."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.config import Config
from sightline.operators import devset, shots
from sightline.plans.encoders import hash_encoder
from sightline.plans.engine import Engine, encode_column
from sightline.plans.reference import docs_of, vectors_of
from sightline.sources import corpus, submissions

QUERIES = [
    ("q1", "Tìm cảnh một nghệ nhân gốm đan giỏ tre bên chiếc ô tím, sau đó xếp gạch thành hàng gần bến sông"),
    ("q2", "Trong bản tin về giá nông sản, có bao nhiêu người cùng bắt vít đường ray?"),
    ("q3", "Tìm các khoảnh khắc:\nE1: người đàn ông đội nón\nE2: đội lân múa\nE3: mọi người vỗ tay"),
]


@pytest.fixture(scope="module")
def engine(spark, small):
    keyframes, first = spark.read.parquet(f"{small}/keyframes.parquet"), hash_encoder(64)
    second_tower = lambda texts: first([f"second {t}" for t in texts])
    return Engine.over(spark, keyframes, vectors_of(spark, small), docs_of(spark, small), spark.read.parquet(f"{small}/media_info.parquet"), encoder=hash_encoder(64), multilingual=second_tower)


def test_solve_and_write(spark, engine, tmp_path):
    queries = spark.createDataFrame(QUERIES, "query_id string, raw string")
    answers = spark.createDataFrame([("q2", "5", 0.6), ("q2", "6", 0.7)], "query_id string, answer string, prob double")
    solved = engine.solve(queries, answers).cache()
    rows = solved.collect()
    by = {q: sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"]) for q in ("q1", "q2", "q3")}
    assert {q: r[0]["task"] for q, r in by.items()} == {"q1": "kis", "q2": "qa", "q3": "trake"}
    for q, own in by.items():
        assert 0 < len(own) <= 100 and [r["rank"] for r in own] == [*range(1, len(own) + 1)]
        assert all(-1e-9 <= a["cumulative"] <= b["cumulative"] + 1e-9 <= 1 + 2e-9 for a, b in zip(own, own[1:], strict=False))
    assert {r["answer"] for r in by["q2"]} <= {"5", "6"} and all(len(r["frames"]) == 3 for r in by["q3"])
    files = engine.write(solved, str(tmp_path))
    assert len(files) == 4
    back, problems = submissions.read_back(spark, str(tmp_path))
    assert problems.count() == 0 and back.count() == len(rows)
    assert zipfile.ZipFile(files[-1]).namelist()[0].startswith("submission/")


def test_review_and_status(spark, engine):
    frames = engine.review(spark.createDataFrame(QUERIES[:1], "query_id string, raw string")).collect()
    assert frames and [r["scan"] for r in sorted(frames, key=lambda r: (r["k"], r["position"]))] == [*range(1, len(frames) + 1)]
    assert engine.status()["keyframes"] == 480


def test_encoder_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, " "), (4, "a")], "k int, t string")
    v = {r["k"]: r["v"] for r in encode_column(df, "t", hash_encoder(8)).collect()}
    assert v[2] is None and v[3] is None and v[1] == v[4] and abs(np.linalg.norm(v[1]) - 1) < 1e-5


def corpus_files():
    files = {"media-info/L21_V001.json": json.dumps({"title": " Tin ", "description": "d", "keywords": ["a", "b"], "length": 10, "author": ""}), "media-info/L21_V002.json": "{broken"}
    for v in ("L21_V001", "L21_V002"):
        files[f"map-keyframes/{v}.csv"] = "\ufeffn,pts_time,fps,frame_idx\n2,2.0,25.0,50\n1,0.0,25.0,0\n3,4.0,25.0,\n"
        out = io.BytesIO()
        np.save(out, np.eye(4, dtype=np.float16)[:2])
        files[f"clip-features-32/{v}.npy"] = out.getvalue()
        files[f"objects/{v}/001.json"] = json.dumps({"detection_class_entities": ["Car", "Car", "Hat", "Dog"], "detection_scores": ["0.5", "0.9", "x", "0.1"]})
        files[f"objects/{v}/002.json"] = "no json"
    return {k: v if isinstance(v, bytes) else v.encode() for k, v in files.items()}


@pytest.mark.parametrize("zipped", [False, True])
def test_sources(spark, tmp_path, zipped):
    if zipped:
        with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
            for name, body in corpus_files().items():
                z.writestr(f"data/{name}", body)
    else:
        for name, body in corpus_files().items():
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_bytes(body)
    root = str(tmp_path)
    k = corpus.read_keyframes(spark, root)
    assert sorted(map(tuple, k.collect())) == [(v, n, t, 25.0, f) for v in ("L21_V001", "L21_V002") for n, t, f in ((1, 0.0, 0), (2, 2.0, 50))]
    assert corpus.read_keyframes(spark, root, ["L21_V002"]).count() == 2
    media = {r["video_id"]: r for r in corpus.read_media(spark, root).collect()}
    assert media["L21_V001"]["title"] == " Tin " and media["L21_V002"]["title"] is None
    assert corpus.check_vectors(corpus.read_vectors(spark, root), k).count() == 0
    docs = corpus.object_docs(corpus.read_objects(spark, root), k).collect()
    assert [(d["text"], d["start_frame"]) for d in docs] == [("Car", 0)] * 2
    assert {r["family"]: r["files"] for r in corpus.inventory(spark, root).collect()} == {"map-keyframes": 2, "media-info": 2, "clip-features-32": 2, "objects": 4}
    titles = corpus.title_docs(corpus.read_media(spark, root)).collect()
    assert [t["text"] for t in titles] == ["Tin"]


def test_missing_family(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        corpus.entries(spark, str(tmp_path), "objects")


def test_build_and_load(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "index"
    for name, body in corpus_files().items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    Engine.build(spark, str(root), str(out))
    engine = Engine.load(spark, str(out), encoder=hash_encoder(4))
    found = engine.retrieve(spark.createDataFrame([("q", "Tin a car"), ("none", "zzz")], "query_id string, raw string"))
    assert found["candidates"].where("query_id = 'q'").count() > 0
    assert engine.status()["shots"] == shots.build_shots(corpus.read_keyframes(spark, str(root)), corpus.read_media(spark, str(root))).count()


def test_query_files_and_truths(spark, tmp_path):
    (tmp_path / "query-p1-2-kis.txt").write_text("một", encoding="utf-8")
    (tmp_path / "query-p1-3-qa.txt").write_text("\ufeffhai?", encoding="utf-8")
    q = corpus.read_query_files(spark, str(tmp_path))
    assert sorted(map(tuple, q.collect())) == [("p1-2", "kis", "một"), ("p1-3", "qa", "hai?")]
    known = spark.createDataFrame([("p1-2", "L21_V001", [(1, 2)], None, [], "seen")], "query_id string, video_id string, spans array<struct<s:int,e:int>>, answer string, answer_aliases array<string>, note string")
    t = {r["query_id"]: r for r in corpus.merge_truths(q, known).collect()}
    assert t["p1-2"]["video_id"] == "L21_V001" and t["p1-3"]["video_id"] == "" and t["p1-3"]["answer"] == "TODO"
    (tmp_path / "query-p1-4-kis.txt").write_text("", encoding="utf-8")
    with pytest.raises(ValueError):
        corpus.read_query_files(spark, str(tmp_path))
    path = tmp_path / "dev.json"
    path.write_text(json.dumps({"queries": {"a": "x", "_about": "note"}, "truths": {"a": {"task": "kis", "video_id": "L21_V001", "span": [0, 5]}}}))
    texts, truths = corpus.read_devset(spark, str(path))
    assert texts.count() == 1 and truths.select(F.col("spans")[0]["e"]).first()[0] == 5


def test_submission_errors(spark, tmp_path):
    schema = "query_id string, task string, rank int, video_id string, frame int, frames array<int>, answer string, n_moments int"
    bad = spark.createDataFrame([("q", "kis", 1, "bad", -1, None, None, None)], schema)
    with pytest.raises(ValueError):
        submissions.write(bad, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    for name, body in {"query-a-qa.csv": b"L21_V001,5,a,b\r\nL21_V001,x,a\r\nL21_V001,5\r\n", "query-b-kis.csv": b"video_id,frame_id\r\n", "odd.csv": b"x", "query-c-kis.csv": b"\xff\xfe"}.items():
        (tmp_path / name).write_bytes(body)
    answers, problems = submissions.read_back(spark, str(tmp_path))
    assert [r["answer"] for r in answers.collect()] == ["a,b"] and problems.count() == 5


def test_requests(spark, small):
    from sightline.plans import requests

    q, a, p = requests.batch(spark, [{"query_id": " q1 ", "text": "một cảnh", "answers": ["x", {"text": "y", "prob": 0.5}], "pins": [{"video_id": "L21_V001", "frame": 3}]}])
    assert q.first()["query_id"] == "q1" and a.count() == 2 and p.first()["frame"] == 3
    for bad in ([], [{"query_id": "q", "text": ""}], [{"query_id": "q", "text": "x" * 2001}], [{"query_id": "a", "text": "x"}] * 2, [{"query_id": "a", "text": "x", "answers": [{"text": "y", "prob": 2}]}], [{"query_id": "a", "text": "x", "pins": [{"video_id": "?", "frame": 1}]}], [{"query_id": "a", "text": "x", "task": "no"}]):
        with pytest.raises(ValueError):
            requests.batch(spark, bad)
    keyframes = spark.read.parquet(f"{small}/keyframes.parquet")
    solved = spark.createDataFrame([("q", 1, "L21_V001", 30, None, 0.1234567, 0.1)], "query_id string, rank int, video_id string, frame int, frames array<int>, gain double, cumulative double")
    row = requests.shown(solved, keyframes, spark.read.parquet(f"{small}/media_info.parquet")).first()
    assert row["nearest_n"] is not None and row["timecode"].startswith("00:0") and row["gain"] == 0.123457
    assert requests.video_info(keyframes, spark.read.parquet(f"{small}/media_info.parquet"), "L21_V001").first()["keyframes"] > 0


def test_devset_sampling(spark, small):
    keyframes = spark.read.parquet(f"{small}/keyframes.parquet")
    drawn = devset.sample_targets(keyframes, {"kis": 12, "qa": 5}).collect()
    assert {t: sum(r["task"] == t for r in drawn) for t in ("kis", "qa")} == {"kis": 12, "qa": 5}
    assert all(r["start_frame"] <= r["frame"] <= r["end_frame"] for r in drawn)
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, devset.sample_targets(keyframes, {"kis": 12, "qa": 5}).collect()))
    truths = spark.createDataFrame([("a", "kis", "L1_V1"), ("b", "qa", "")], "query_id string, task string, video_id string")
    assert {r["task"]: r["annotated"] for r in devset.coverage_report(truths).collect()} == {"kis": 1, "qa": 0}


def test_text_hits_far_from_the_query_keep_their_shots(spark):
    """A whole-video hit stands for its 12 best shots, even if none of its keyframes is among the nearest; without vectors they are spread."""
    raw, rng = "gốm Bát Tràng", np.random.default_rng(7)
    q = hash_encoder(8)([raw])[0].astype(np.float64)
    videos = [f"L21_V00{k}" for k in range(1, 7)]
    keyframes = spark.createDataFrame([(v, n, n * 4.0, 25.0, n * 100) for v in videos for n in range(40)], "video_id string, n int, pts_time double, fps double, frame_idx int")
    made = {(v, n): (-q if v == "L21_V001" else q) + rng.standard_normal(8) * 0.2 for v in videos[:5] for n in range(40)}
    vectors = spark.createDataFrame([(*k, x.tolist()) for k, x in made.items()], "video_id string, n int, embedding array<float>")
    docs = spark.createDataFrame([(k, v, "gốm Bát Tràng" if v in ("L21_V001", "L21_V006") else "tin thể thao", None, None) for k, v in enumerate(videos)], "doc_id long, video_id string, text string, start_frame int, end_frame int")
    engine = Engine.over(spark, keyframes, vectors, docs, encoder=hash_encoder(8), config=Config(channel_depth=50))
    found = engine.retrieve(spark.createDataFrame([("q", raw)], "query_id string, raw string"))
    got = {}
    for r in found["hits"].where("channel = 'sparse_text'").orderBy("rank").collect():
        got.setdefault(r["video_id"], []).append(r["shot_id"])
    own = {}
    for r in engine.indexes.shots.collect():
        own.setdefault(r["video_id"], []).append((r["shot_id"], r["start_frame"], r["end_frame"]))
    best = {}
    for n in range(40):
        x = made["L21_V001", n]
        s = next(s for s, a, b in own["L21_V001"] if a <= n * 100 <= b)
        best[s] = max(best.get(s, -2.0), float(x @ q / np.linalg.norm(x) / np.linalg.norm(q)))
    assert got.keys() == {"L21_V001", "L21_V006"}
    assert got["L21_V001"] == sorted(best, key=lambda s: -best[s])[:12]
    ids = sorted(s for s, *_ in own["L21_V006"])
    assert got["L21_V006"] == ids[:: max(1, len(ids) // 12)][:12]


def test_a_light_locus_of_a_question_keeps_its_frames(spark, monkeypatch):
    """Of each locus four frames are offered, so a long, heavy one leaves room for a light one."""
    keyframes = spark.createDataFrame([("L21_V001", n, n * 4.0, 25.0, n * 100) for n in range(40)], "video_id string, n int, pts_time double, fps double, frame_idx int")
    engine = Engine.over(spark, keyframes, None, None)
    found = {
        "parsed": spark.createDataFrame([("q", "qa", [])], "query_id string, task string, moments array<string>"),
        "candidates": spark.createDataFrame([("q", "L21_V001", 1, 0, 1, 1000, 2499, 2000, 10.0, {}), ("q", "L21_V001", 2, 1, 0, 0, 49, 20, 0.1, {})], "query_id string, video_id string, rank int, cluster_id int, shot_id int, start_frame int, end_frame int, anchor int, fused_score double, ranks map<string,int>"),
        "beliefs": spark.createDataFrame([("q", "L21_V001", 1.0)], "query_id string, video_id string, pi double"),
    }
    monkeypatch.setattr(Engine, "retrieve", lambda self, queries: found)
    frames = [r["frame"] for r in engine.solve(None).collect()]
    assert sum(f < 100 for f in frames) >= 3 and sum(f >= 100 for f in frames) == 4, frames
    engine.config = Config(frames_per_locus=None)
    assert sum(r["frame"] >= 100 for r in engine.solve(None).collect()) > 48


def test_both_towers_have_their_channels(spark, engine):
    found = engine.retrieve(spark.createDataFrame([(*QUERIES[0], "a potter weaves a basket by a purple umbrella")], "query_id string, raw string, english string"))
    names = {r[0] for r in found["hits"].select("channel").distinct().collect()}
    assert {"dense_translated", "dense_original", "dense_multilingual", "dense_multilingual_parts", "dense_localized", "dense_temporal_kis"} <= names
    without = engine.retrieve(spark.createDataFrame(QUERIES[:1], "query_id string, raw string"))
    names = {r[0] for r in without["hits"].select("channel").distinct().collect()}
    assert "dense_original" in names and "dense_translated" not in names


def test_review_keeps_videos_without_candidates(spark, engine):
    """A video that the fused list lost is still shown from the reserve of the whole-corpus channels."""
    from dataclasses import replace

    few = replace(engine, config=Config(n_candidates=5))
    found = few.retrieve(spark.createDataFrame(QUERIES[:1], "query_id string, raw string"))
    kept = {r["video_id"] for r in found["candidates"].collect()}
    shown = {r["video_id"] for r in few._reviewed(found).collect()}
    reserve = {r["video_id"] for r in found["recall"].where("recall_only").collect()}
    assert len(kept) <= 5 and reserve and reserve & shown and kept <= shown


def test_evaluate_review(spark, engine):
    queries = spark.createDataFrame(QUERIES[:2], "query_id string, raw string")
    shown = engine.review(queries).where("query_id = 'q1'").orderBy("scan").first()
    truths = spark.createDataFrame([("q1", shown["video_id"], [(shown["frame"] - 5, shown["frame"] + 5)]), ("q2", "", [])], "query_id string, video_id string, spans array<struct<s:int,e:int>>")
    each, summary = engine.evaluate_review(queries, truths)
    row = each.collect()
    assert len(row) == 1 and row[0]["shown"] and row[0]["frame_hit"] and row[0]["first_thumbnail"] == 1 and row[0]["near_5s"]
    assert summary.first()["frame_hits"] == 1 and summary.first()["recall_100"] == 1


def test_encoders_that_do_not_fit(spark, engine):
    from dataclasses import replace

    from sightline.plans.encoders import EncoderUnavailable, load_encoder

    with pytest.raises(ValueError):
        replace(engine, encoder=hash_encoder(32)).check_encoders()
    with pytest.raises(EncoderUnavailable):
        load_encoder("no-such-model", 64)


def test_settings(tmp_path, monkeypatch):
    from sightline.config import load_config

    (tmp_path / "c.json").write_text('{"rrf_eta": 30, "answer_len": {"kis": 12}}')
    monkeypatch.setenv("SIGHTLINE_RECALL_VIDEOS", "77")
    c = load_config(str(tmp_path / "c.json"), channel_depth=9)
    assert (c.rrf_eta, c.answer_len["kis"], c.answer_len["qa"], c.recall_videos, c.channel_depth, c.n_candidates) == (30.0, 12, 25, 77, 9, 500)
    (tmp_path / "c.json").write_text('{"nothing": 1}')
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "c.json"))


def test_extraction_and_videos(spark, tmp_path):
    root, out = tmp_path / "root", tmp_path / "out"
    root.mkdir()
    with zipfile.ZipFile(root / "a.zip", "w") as z:
        for k in range(40):
            z.writestr(f"x/map-keyframes/L21_V{k:03}.csv", f"n,pts_time,fps,frame_idx\n1,0.0,25.0,{k}\n")
        z.writestr("x/video/L21_V001.mp4", b"film" * 1000)
    done = corpus.extract(spark, str(root), str(out)).collect()
    assert [(r["family"], r["files"], r["complete"]) for r in done] == [("map-keyframes", 40, True)]
    assert sorted(map(tuple, corpus.read_keyframes(spark, str(out)).collect())) == sorted(map(tuple, corpus.read_keyframes(spark, str(root)).collect()))
    film = corpus.extract_video(spark, str(root), "L21_V001", str(tmp_path / "films"))
    assert film.read_bytes() == b"film" * 1000 and corpus.extract_video(spark, str(root), "L21_V001", str(tmp_path / "films")) == film
    assert corpus.locate_video(spark, str(root), "L21_V999") is None
    with pytest.raises(FileNotFoundError):
        corpus.extract_video(spark, str(root), "L21_V999", str(tmp_path))


def test_labelled_set_round_trip(spark, small, tmp_path):
    drawn = devset.sample_targets(spark.read.parquet(f"{small}/keyframes.parquet"), {"kis": 3, "qa": 2})
    queries, truths, told = corpus.devset_template(drawn)
    corpus.write_devset(str(tmp_path / "d.json"), queries, truths, {"about": "x"})
    q, t = corpus.read_devset(spark, str(tmp_path / "d.json"))
    assert q.count() == t.count() == len(told) == 5 and t.where("task = 'qa' and answer = 'TODO'").count() == 2
    assert {(r["query_id"], r["video_id"]) for r in t.collect()} == {(r["query_id"], r["video_id"]) for r in truths.collect()}


def test_detections(spark):
    rows = [("v", 1, f"l{k}", 0.3 + 0.06 * k) for k in range(11)]
    got = corpus.detections(spark.createDataFrame(rows, "video_id string, n int, label string, score double")).collect()
    assert len(got) == 8 and min(r["score"] for r in got) > 0.4 and sum(r["alert"] for r in got) == 2


def test_commands(tmp_path, capsys):
    from sightline.__main__ import main

    assert main(["parse", "Có bao nhiêu người?"]) == 0 and '"qa"' in capsys.readouterr().out
    assert main(["submit-selftest", str(tmp_path / "s")]) == 0 and "the same" in capsys.readouterr().out
    root = tmp_path / "root" / "map-keyframes"
    root.mkdir(parents=True)
    for v in ("L21_V001", "L21_V002"):
        (root / f"{v}.csv").write_text("n,pts_time,fps,frame_idx\n" + "\n".join(f"{k},{k * 4.0},25.0,{k * 100}" for k in range(1, 30)))
    assert main(["devset", str(tmp_path / "root"), str(tmp_path / "d"), "--kis", "2", "--qa", "1", "--trake", "1"]) == 0
    assert len(json.loads((tmp_path / "d" / "devset.json").read_text())["queries"]) == 4
