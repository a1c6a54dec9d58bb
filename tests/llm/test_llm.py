"""The operators for training text against brute force, with their edge cases."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm.textform import consistent_form
from sightline.llm import leakage, lookalikes, mixing, quality, queries, repeated_lines


def words(text):
    return re.findall(r"[^\W_]+", consistent_form(text).lower())


# ---- repeated lines


def brute_lines(rows, least=8):
    seen, lines = defaultdict(set), []
    for doc, video, text in {r for r in rows if r[0] is not None and r[1] is not None and r[2]}:
        for k, line in enumerate(consistent_form(text).split("\n"), 1):
            key = "".join(c for c in line.lower() if c.isalpha())
            if key:
                seen[video.split("_")[0], key].add(doc)
                lines.append((doc, k, (video.split("_")[0], key)))
    return {(d, k) for d, k, key in lines if len(seen[key]) >= least}


def test_repeated_lines(spark):
    rng = random.Random(1)
    notes = ["Bấm đăng ký kênh {}!", "(c) {} All rights", "Ðăng lại {} lần", "--- {} ---"]
    rows = []
    for doc in range(400):
        text = [rng.choice(notes).format(rng.randrange(99)) if rng.random() < 0.4 else f"dòng {chr(97 + doc % 26)}{chr(97 + doc // 26)} riêng" for _ in range(rng.randrange(6))]
        rows.append((doc * 37, f"L{rng.choice([21, 21, 21, 22, 23])}_V00{rng.randrange(5)}", "\n".join(text)))
    rows += rows[:50] + [(90_001, "L21_V001", None), (90_002, None, "Bấm đăng ký kênh"), (90_003, "L21_V001", ""), (None, "L21_V001", "x"), (-5, "L21_V001", "BẤM  đăng ký kênh\nх")]
    df = spark.createDataFrame(rows, "doc_id long, video_id string, text string").withColumn("line", F.lit("clash")).withColumn("key", F.lit(1))
    want = brute_lines(rows)
    assert {(r[0], r[1]) for r in repeated_lines.repeated_lines(df).collect()} == want and want
    clean = {r["doc_id"]: r for r in repeated_lines.without_repeated_lines(df).collect()}
    texts = {r[0]: r[2] for r in rows if r[0] is not None}
    assert clean.keys() == texts.keys()
    for doc, text in texts.items():
        kept = text if not text else "\n".join(x for k, x in enumerate(text.split("\n"), 1) if (doc, k) not in want)
        assert clean[doc]["text"] == kept
    assert repeated_lines.repeated_lines(df.where("false")).count() == 0


def test_repeated_lines_on_the_table(spark, medium):
    rows = duckdb.sql(f"SELECT DISTINCT doc_id, video_id, text FROM '{medium}/docs.parquet'").fetchall()
    assert {tuple(r) for r in queries.p1_found(spark, medium).collect()} == brute_lines(rows)


# ---- look-alikes


def test_lookalike_pairs(spark):
    rows = [(1, "Đoàn"), (1, "Đoàn"), (2, "Ðoàn"), (3, "Đoàn"), (4, "Đoàn​"), (5, None), (6, ""), (7, "​"), (8, "khác"), (9, "khác"), (10, "x" * 50_000 + "а"), (11, "x" * 50_000 + "a")]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("form", F.lit("clash"))
    both = lookalikes.consistent(df, "k", "t", "doc").unionByName(lookalikes.consistent(df.where("k < 3"), "k", "t", "query"))
    got = sorted(map(tuple, lookalikes.lookalike_pairs(lookalikes.keyed(both)).collect()))
    assert got == [("doc", 1, 2), ("doc", 1, 4), ("doc", 2, 3), ("doc", 2, 4), ("doc", 3, 4), ("doc", 10, 11), ("query", 1, 2)]
    assert lookalikes.lookalike_pairs(lookalikes.keyed(both.where("false"))).count() == 0


def test_lookalike_classes_count_links(spark, monkeypatch):
    rows = [(k, "Đoàn" if k % 3 else "Ðoàn") for k in range(60)] + [(100, "một"), (101, "một"), (102, None)]
    hashes = lookalikes.keyed(lookalikes.consistent(spark.createDataFrame(rows, "k long, t string"), "k", "t", "doc"))
    got = {r["record_key"]: (r["class_key"], r["links"]) for r in lookalikes.lookalike_classes(hashes).collect()}
    assert got == {k: (0, 20 if k % 3 else 40) for k in range(60)}
    monkeypatch.setattr(lookalikes, "SALT_ROWS", 7)
    pairs = lookalikes.lookalike_pairs(hashes).collect()
    assert len(pairs) == len(set(map(tuple, pairs))) == 20 * 40


def test_lookalikes_on_the_table(spark, medium):
    want = set()
    for kind, table, key, col in (("doc", "docs", "doc_id", "text"), ("query", "queries", "query_no", "raw")):
        groups = defaultdict(list)
        for k, t in duckdb.sql(f"SELECT DISTINCT {key}, {col} FROM '{medium}/{table}.parquet' WHERE {col} <> ''").fetchall():
            groups[consistent_form(t)].append((k, t))
        want |= {(kind, min(a, b), max(a, b)) for g in groups.values() for a, s in g for b, t in g if a < b and s != t}
    assert {tuple(r) for r in queries.p4_found(spark, medium).collect()} == want and want


# ---- leakage


def brute_leaks(docs, items, n=12):
    grams = defaultdict(set)
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            grams[tuple(w[k : k + n])].add(i)
    out = set()
    for d, t in docs:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_leaks(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for i in range(50)] + [(60, None), (61, "")]
    docs = []
    for d in range(200):
        body = [rng.choice(vocabulary) if rng.random() < 0.9 else "khác" for _ in range(rng.randrange(80))]
        if rng.random() < 0.5:
            w = items[rng.randrange(50)][1].split()
            a = rng.randrange(max(1, len(w) - 11))
            at = rng.randrange(len(body) + 1)
            body[at:at] = w[a : a + rng.choice([11, 12, 13, 30])]
        docs.append((d, rng.choice([" ", "\n", ", "]).join(body).upper()))
    docs += [(900, None), (901, ""), (902, " ".join(vocabulary * 3000) + " " + items[7][1] + " " + items[3][1]), docs[0]]
    want = brute_leaks(docs, items)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("words", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    monkeypatch.setattr(leakage, "SEGMENT", 1 << 12)
    for chars in (10**6, 1500):
        got = [tuple(r) for r in leakage.leaked_items(d, i, index_chars=chars).collect()]
        assert set(got) == want and len(got) == len(want) and want
    assert leakage.leaked_items(d.where("false"), i).count() == 0 and leakage.leaked_items(d, i.where("false")).count() == 0


def test_leaks_on_the_table(spark, medium):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{medium}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{medium}/eval_items.parquet'").fetchall()
    assert {tuple(r) for r in queries.p7_found(spark, medium).collect()} == brute_leaks(docs, items)


def test_short_items_match_as_a_whole(spark):
    items = [(1, "một con mèo đen"), (2, "hai"), (3, " ".join(f"w{k}" for k in range(30)))]
    docs = [(1, "ở đây có MỘT con mèo đen, và hai"), (2, "một con mèo trắng"), (3, "x " + " ".join(f"w{k}" for k in range(8, 20))), (4, " ".join(f"w{k}" for k in range(11)))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, leakage.leaked_items(d, i).collect())) == [(3, 3)]
    assert sorted(map(tuple, leakage.leaked_items(d, i, least_words=3).collect())) == [(1, 1), (3, 3)]
    assert sorted(map(tuple, leakage.leaked_items(d, i, least_words=1).collect())) == [(1, 1), (1, 2), (3, 3)]


def test_overlap_with_body_and_question(spark):
    body, asked = [f"b{k}" for k in range(20)], [f"q{k}" for k in range(14)]
    items = [(1, " ".join(body) + "; " + " ".join(asked) + "?"), (2, " ".join(body))]
    docs = [(1, "x " + " ".join(body[3:18])), (2, " ".join(asked) + " y"), (3, " ".join(body + asked)), (4, " ".join(body[10:] + asked[:5]))]
    got = {tuple(r) for r in leakage.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1, 34, 15, 14, 0), (1, 2, 20, 15, 0, 0), (2, 1, 34, 14, 14, 14), (3, 1, 34, 34, 14, 14), (3, 2, 20, 20, 0, 0), (4, 1, 34, 15, 14, 5)}


@pytest.mark.parametrize("cells", [1 << 21, 40])
def test_thresholds_are_lower_bounds(monkeypatch, cells):
    """With the block maxima as a table, and by posting a few blocks at a time."""
    monkeypatch.setattr(leakage, "CELLS", cells)
    rng = random.Random(3)
    texts = [[f"w{rng.randrange(30)}" for _ in range(40)] for _ in range(33)]
    index = leakage.ItemIndex(list(range(33)), texts)
    assert sorted(index.ids.tolist()) == list(range(33))
    for place, k in enumerate(index.ids.tolist()):
        t, block = texts[k], place // leakage.BLOCK
        codes = np.array([index.vocabulary[w] for w in t])
        for a in range(29):
            assert index.rows(codes[a : a + 12], np.array([block])).sum(0)[place % leakage.BLOCK] >= index.threshold[place]
            assert block in index.opened(codes[a : a + 12])
        assert place in index.find(["x", *t[5:17], "y"])


# ---- mixing


def mixed(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))
    t = spark.createDataFrame(targets, "source_name string, target_share double, max_repeats int")
    m = mixing.mix(d, t, tokenizer=queries.TOKENIZER, **kw)
    return m.collect(), {r["source_name"]: r for r in mixing.reached(m, t).collect()}


def test_mix_reaches_its_shares(spark):
    rng = random.Random(4)
    sources = ["big"] * 70 + ["Big ", "BIG"] + ["small"] * 10 + ["none"] * 5
    docs = [(k, rng.choice(sources), "từ " * rng.randrange(1, 60)) for k in range(600)]
    docs += [(900, "big", None), (901, "big", ""), (902, None, "x"), docs[3]]
    rows, shares = mixed(spark, docs, [("big", 0.5, 1), ("small", 0.4, 8), ("absent", 0.1, 2)])
    used = Counter()
    for r in rows:
        used[r["source_name"]] += r["used"]
        assert 0 < r["used"] <= r["tokens"]
    uses = Counter((r["doc_id"], r["source_name"]) for r in rows)
    assert all(n <= {"big": 1, "small": 8}[s] for (_, s), n in uses.items())
    total = sum(used.values())
    assert abs(used["big"] / total - 5 / 9) < 1e-4 and shares["absent"]["tokens"] == 0
    assert abs(sum(r["share"] for r in shares.values()) - 1) < 1e-9 and all(shares[s]["tokens"] == n for s, n in used.items())
    assert sum(r["used"] < r["tokens"] for r in rows) <= 2  # one cut per source
    again, _ = mixed(spark, docs, [("big", 0.5, 1), ("small", 0.4, 8), ("absent", 0.1, 2)])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_cut_is_the_prefix_of_the_hash_order(spark):
    docs = [(k, "a", "từ " * (k % 7 + 1)) for k in range(300)]
    rows, _ = mixed(spark, docs, [("a", 1.0, 2)], total=500)
    keys = spark.createDataFrame([(k,) for k in range(300)], "k long").select("k", F.xxhash64(F.lit(mixing.SEED), "k").alias("h")).orderBy("h", "k").collect()
    encode = mixing._tokenizer(queries.TOKENIZER).encode_ordinary
    left, want = 500, {}
    for k, _ in keys:
        take = min(left, len(encode("từ " * (k % 7 + 1))))
        if take:
            want[k] = take
        left -= take
    assert {r["doc_id"]: r["used"] for r in rows} == want


def test_mix_without_documents(spark):
    rows, shares = mixed(spark, [(1, "x", "a")], [("a", 1.0, 1)])
    assert not rows and shares["a"]["tokens"] == 0


# ---- quality


def test_statistics(spark):
    texts = {1: "The cat sat. It was on the mat!\nNo end here", 2: "", 3: None, 4: "%%%% ####", 5: "a" * 200_000}
    rows = {r["doc_id"]: r for r in quality.statistics(spark.createDataFrame([*texts.items()], "doc_id long, text string").withColumn("words", F.lit("clash"))).collect()}
    one = rows[1]
    assert one["words"] == 11 and abs(one["mean_word_length"] - 32 / 11) < 1 and one["punctuated_line_share"] == 0.5
    assert one["common_word_share"] == sum(w in quality.common_words() for w in "the cat sat. it was on the mat! no end here".split()) / 11 and abs(one["symbol_share"] - 2 / 43) < 0.01
    assert rows[2]["words"] == rows[3]["words"] == 0 and rows[4]["symbol_share"] > 0.8 and rows[5]["mean_word_length"] == 200_000


def test_weak_labels(spark):
    votes = [(1, "a", "prose"), (1, "b", "prose"), (1, "b", "prose"), (2, "a", "list"), (2, "b", "prose"), (3, "a", "junk"), (4, "a", None), (None, "a", "list")]
    got = sorted(map(tuple, quality.weak_labels(spark.createDataFrame(votes, "doc_id long, annotator string, kind string")).collect()))
    assert got == [(1, 0.0, True), (3, 1.0, False)]


def test_classifier_on_held_out_labels(spark):
    """Fitted without the documents whose id is odd, it must tell those apart."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/doc_labels.parquet")
    model = quality.ProseModel.fit(docs, labels.where("doc_id % 2 = 0"))
    held = quality.weak_labels(labels.where("doc_id % 2 = 1")).where("agreed")
    scored = model.score(quality._measured(docs.join(held, "doc_id", "left_semi")), "doc_id").join(held, "doc_id").collect()
    right = sum((r["not_prose"] >= 0.5) == (r["label"] == 1) for r in scored)
    assert len(scored) > 100 and right / len(scored) > 0.97


def test_calibration_holds(spark, tmp_path):
    """Predicted and observed shares of documents that the model has not seen, over all bins; the model read back says the same."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/doc_labels.parquet")
    model = quality.ProseModel.fit(docs, labels)
    rows = model.calibration().collect()
    model.save(str(tmp_path / "m"))
    again = quality.ProseModel.load(spark, str(tmp_path / "m"))
    few = docs.where("doc_id < 300")
    assert sorted(map(tuple, quality.not_prose(few, labels, model=again).collect())) == sorted(map(tuple, quality.not_prose(few, labels, model=model).collect())) != []
    n = sum(r["documents"] for r in rows)
    assert n > 50 and sum(r["documents"] * abs(r["predicted"] - r["observed"]) for r in rows) / n < 0.05


def test_documents_given_twice_come_out_once(spark):
    docs = spark.createDataFrame([(1, "A cat sat on the mat."), (1, "A cat sat on the mat."), (2, "x")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in quality.statistics(docs).collect()) == [1, 2]


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert quality.not_prose(docs, spark.createDataFrame([], "doc_id long, annotator string, kind string")).count() == 0
    assert quality.not_prose(docs.where("false"), spark.createDataFrame([(1, "a", "prose")], "doc_id long, annotator string, kind string")).count() == 0


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("p1_found", "p4_found", "p7_found")])
def test_query_runs(spark, small, name):
    df = queries.queries()[name](spark, small)
    assert df.count() >= 0 and df.columns
