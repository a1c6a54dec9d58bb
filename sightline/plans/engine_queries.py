"""More queries of the engine's own steps over the test tables, each with SQL that says the same in another way."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline import config
from sightline.functions.vector import normalised
from sightline.operators import align, channels, coverage, dense, review, shots
from sightline.plans import parse
from sightline.plans.encoders import hash_encoder
from sightline.plans.engine import Engine, channel_weights
from sightline.plans.reference import (
    CAND, COSINE, FRAMES, GOOD, HITS, MOMENTS, NORM, SHOTS, SPLIT, VECS, VIDEO_HITS, VSCORES, _quoted, candidates_of, docs_of, fps_of, hits_of, norm_sql, queries_of, query, r6, tok_sql, vectors_of,
)
from sightline.plans.reference import _moments, _shots, _split, oracle_sql, queries  # noqa: F401
from sightline.session import cut, table
from sightline.sources import corpus

# ---- shots of a whole video that a text found


def _asked(spark, d):
    """Every fiftieth review frame as a query, by its own keyframe's vector; wanted are the videos shown for its query."""
    frames = table(spark, d, "review_frames").select("frame_key", "query_id", "video_id", "n").distinct()
    some = frames.where("frame_key % 50 = 0")
    vectors = some.join(vectors_of(spark, d), ["video_id", "n"]).select(F.col("frame_key").cast("string").alias("query_id"), F.col("embedding").alias("v"))
    shown = frames.where("query_id is not null").select("query_id", F.col("video_id").alias("wanted")).distinct()
    pairs = some.where("query_id is not null").join(shown, "query_id").select(F.col("frame_key").cast("string").alias("query_id"), F.col("wanted").alias("video_id"))
    return pairs.where("video_id is not null").distinct(), vectors.where(F.exists("v", lambda x: x != 0))


ASKED = f"{VECS}, good AS (SELECT * FROM vecs WHERE list_sum(list_transform(embedding, lambda x: abs(x))) > 0), rf AS (SELECT DISTINCT frame_key, query_id, video_id, n FROM review_frames), ask AS (SELECT CAST(frame_key AS VARCHAR) AS query_id, query_id AS q, video_id, n FROM rf WHERE frame_key % 50 = 0), pairs AS (SELECT DISTINCT ask.query_id, rf.video_id FROM ask JOIN rf ON rf.query_id = ask.q WHERE rf.video_id IS NOT NULL), av AS (SELECT DISTINCT ask.query_id, embedding FROM ask JOIN good USING (video_id, n))"
SPREAD = "sized AS (SELECT video_id, shot_id, row_number() OVER (PARTITION BY video_id ORDER BY shot_id) - 1 AS k, count(*) OVER (PARTITION BY video_id) AS size FROM shot), spread AS (SELECT video_id, shot_id FROM sized WHERE k % greatest(1, size // 12) = 0 AND k // greatest(1, size // 12) < 12)"


@query(f"WITH {SHOTS}, {SPREAD} SELECT video_id, shot_id FROM spread")
def even_stride_shots(spark, d):
    return dense.spread_shots(_shots(spark, d))


@query(f"WITH {ASKED}, {SHOTS}, {SPREAD}, placed AS (SELECT b.video_id, coalesce(shot_id, frame_idx) AS shot_id, embedding FROM good b JOIN keyframes k USING (video_id, n) LEFT JOIN shot ON shot.video_id = b.video_id AND k.frame_idx BETWEEN start_frame AND end_frame WHERE frame_idx IS NOT NULL), sim AS (SELECT a.query_id, b.video_id, b.shot_id, max({COSINE}) AS s FROM pairs JOIN av a USING (query_id) JOIN placed b ON b.video_id = pairs.video_id GROUP BY ALL), top AS (SELECT query_id, video_id, shot_id, s FROM sim QUALIFY row_number() OVER (PARTITION BY query_id, video_id ORDER BY round(s, 9) DESC, shot_id) <= 12) SELECT query_id, video_id, shot_id, round(s, 6) AS similarity FROM top UNION ALL SELECT query_id, video_id, shot_id, 0 FROM pairs JOIN spread USING (video_id) WHERE (query_id, video_id) NOT IN (SELECT query_id, video_id FROM top)")
def video_hit_shots(spark, d):
    pairs, vectors = _asked(spark, d)
    return dense.best_shots_of_videos(pairs, vectors, vectors_of(spark, d), table(spark, d, "keyframes"), _shots(spark, d)).select("query_id", "video_id", "shot_id", r6("similarity"))


@query(f"WITH {ASKED}, two AS (SELECT video_id, arg_min(embedding, n) AS other FROM good GROUP BY 1), t AS (SELECT av.query_id, av.embedding AS one, two.other FROM av JOIN ask USING (query_id) JOIN two USING (video_id)) SELECT query_id, b.video_id, b.n, frame_idx AS frame, round(greatest(list_dot_product(one::DOUBLE[], b.embedding::DOUBLE[]), list_dot_product(other::DOUBLE[], b.embedding::DOUBLE[])) / {NORM.format('b.embedding')}, 6) AS similarity FROM t JOIN pairs USING (query_id) JOIN good b USING (video_id) JOIN keyframes k USING (video_id, n) WHERE frame_idx IS NOT NULL")
def tower_maximum(spark, d):
    """Two towers' vectors of one text: the frame's own and its video's first; of each keyframe the greater product counts."""
    pairs, vectors = _asked(spark, d)
    good = vectors_of(spark, d).where(F.exists("embedding", lambda x: x != 0))
    first = good.groupBy("video_id").agg(F.min_by("embedding", "n").alias("other"))
    of = table(spark, d, "review_frames").select(F.col("frame_key").cast("string").alias("query_id"), "video_id").distinct().join(first, "video_id")
    texts = vectors.join(of, "query_id").select("query_id", F.array(F.array("v"), F.array("other")).alias("towers"))
    frames = table(spark, d, "keyframes").where("frame_idx is not null").select("video_id", "n", F.col("frame_idx").alias("frame"))
    return dense.similarities(pairs, texts, good, frames).select("query_id", "video_id", "n", "frame", F.round(F.col("sims")[0], 6).alias("similarity"))


@query(f"WITH {HITS}, best AS (SELECT query_id, video_id, shot_id, channel, min(rank) AS rank FROM hits WHERE rank <= 2000 GROUP BY ALL), fused AS (SELECT query_id, video_id, shot_id, round(sum(1 / (60.0 + rank)), 12) AS s, count(*) AS c FROM best GROUP BY ALL) SELECT query_id, 'dense_multilingual_parts' AS channel, video_id, shot_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, c DESC, '(''' || video_id || ''', ' || shot_id || ')') AS rank, round(s, 9) AS score FROM fused QUALIFY rank <= 2000")
def parts_channel(spark, d):
    return dense.parts_channel(hits_of(spark, d)).withColumn("score", F.round("score", 9))


@query(f"WITH {HITS}, {VIDEO_HITS}, vf AS (SELECT query_id, video_id, round(sum(1 / (60.0 + rank)), 12) AS s, count(*) AS c FROM vhits WHERE rank <= 2000 GROUP BY ALL), pool AS (SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, c DESC, '(''' || video_id || ''', 0)') AS video_rank, s / sum(s) OVER (PARTITION BY query_id) AS share FROM vf), best AS (SELECT query_id, video_id, shot_id, channel, min(rank) AS rank FROM hits WHERE rank <= 2000 GROUP BY ALL), sf AS (SELECT query_id, video_id, shot_id, round(sum(1 / (60.0 + rank)), 12) AS s, count(*) AS c FROM best GROUP BY ALL), one AS (SELECT query_id, video_id, shot_id, s FROM sf QUALIFY row_number() OVER (PARTITION BY query_id, video_id ORDER BY s DESC, c DESC, '(''' || video_id || ''', ' || shot_id || ')') = 1) SELECT query_id, video_id, video_rank, shot_id, round(one.s, 9) AS fused_score, round(share, 9) AS score FROM pool JOIN one USING (query_id, video_id) WHERE video_rank <= 300")
def recall_candidates(spark, d):
    hits = cut(hits_of(spark, d))
    pool = channels.recall_pool(hits, candidates_of(spark, d)).select("query_id", "video_id", "video_rank", "shot_id", F.round("fused_score", 9).alias("fused_score"))
    return pool.join(channels.recall_scores(hits).select("query_id", "video_id", F.round("score", 9).alias("score")), ["query_id", "video_id"])


# ---- weights and the parser's plain fields

_PER_QUERY = "q AS (SELECT CAST(query_no AS VARCHAR) AS query_id, any_value(raw) AS raw, any_value(task) AS task, any_value(english) AS english, any_value(keywords) AS keywords, any_value(entities) AS entities FROM queries WHERE query_no IS NOT NULL GROUP BY query_no)"


def _weight_sql():
    base = " ".join(f"WHEN '{c}' THEN {w}" for c, w in config.WEIGHTS.items())
    english = " ".join(f"WHEN '{c}' THEN {w}" for c, w in config.WITH_TRANSLATION.items())
    factor = lambda when, of: f"(CASE WHEN {when} THEN CASE channel " + " ".join(f"WHEN '{c}' THEN {f}" for c, f in of.items()) + " ELSE 1.0 END ELSE 1.0 END)"
    parts = [factor("named", config.ENTITY_FACTORS), factor("visual", config.VISUAL_FACTORS), factor("task = 'trake'", config.TRAKE_FACTORS)]
    return f"WITH {_PER_QUERY}, k AS (SELECT query_id, task, len(coalesce(entities, [])) > 0 AS named, len(coalesce(entities, [])) = 0 AND len(coalesce(keywords, [])) = 0 AS visual, trim(coalesce(english, '')) <> '' AS translated FROM q WHERE task IN ('kis', 'qa', 'trake')), c AS (SELECT unnest({_quoted(config.WEIGHTS)}) AS channel) SELECT query_id, channel, round(1::DOUBLE * (CASE WHEN translated THEN coalesce(CASE channel {english} END, CASE channel {base} END) ELSE CASE channel {base} END END) * {' * '.join(parts)}, 6) AS weight FROM k, c"


@query(_weight_sql())
def weights_for_query(spark, d):
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("keywords", "entities")}
    return channel_weights(queries_of(spark, d).withColumns(lists).select("query_id", "task", "english", "keywords", "entities")).select("query_id", "channel", r6("weight"))


_PLAIN = norm_sql("coalesce(raw, '')")


def _found_sql(words):
    return f"list_filter({_quoted(words)}, lambda w: contains(p, w))"


_DOMAINS = "[" + ", ".join(f"CASE WHEN len({_found_sql(ks)}) > 0 THEN '{d}' END" for d, ks in parse.DOMAIN_KEYWORDS.items()) + "]"


@query(f"WITH {_PER_QUERY}, t AS (SELECT query_id, {_PLAIN} AS p, {tok_sql('raw')} AS ts FROM q), w AS (SELECT query_id, list(term ORDER BY pos) AS ks FROM (SELECT query_id, term, min(pos) AS pos FROM (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM t) WHERE length(term) >= 2 OR regexp_full_match(term, '[0-9]+') GROUP BY ALL) GROUP BY query_id) SELECT query_id, len({_found_sql(parse.QA_MARKERS)}) AS asks, len({_found_sql(parse.TRAKE_MARKERS)}) AS orders, {_found_sql(parse.SPATIAL_WORDS)} AS spatial, list_filter({_DOMAINS}, lambda x: x IS NOT NULL) AS domain_hints, coalesce(ks, [])[1:24] AS keywords FROM t LEFT JOIN w USING (query_id)")
def parsed_fields(spark, d):
    """Markers, places, genres and keywords as the parser reads them; ``parse_queries`` has all fields."""
    count = lambda words: F.udf(lambda raw: len(parse.Reading(raw or "").says(words)), "long")("raw")
    q = queries_of(spark, d).select("query_id", "raw")
    parsed = parse.parse_queries(q).select("query_id", "spatial", "domain_hints", "keywords")
    return q.select("query_id", count(parse.QA_MARKERS).alias("asks"), count(parse.TRAKE_MARKERS).alias("orders")).join(parsed, "query_id")


@query("WITH q AS (SELECT query_no, any_value(task) AS task, 'q' || query_no || '-' || (query_no % 13) AS query_id FROM queries WHERE query_no IS NOT NULL GROUP BY query_no) SELECT query_id, row_number() OVER (ORDER BY CASE task WHEN 'kis' THEN 0 WHEN 'qa' THEN 1 WHEN 'trake' THEN 2 ELSE 9 END, query_no, query_no % 13) AS place FROM q")
def natural_order(spark, d):
    named = queries_of(spark, d).select("task", F.concat(F.lit("q"), F.col("query_no"), F.lit("-"), F.col("query_no") % 13).alias("query_id"))
    task = F.coalesce(F.create_map(*(F.lit(x) for kv in {"kis": 0, "qa": 1, "trake": 2}.items() for x in kv))[F.col("task")], F.lit(9))
    # One row a query, in one window: a list of queries is short.
    return named.select("query_id", F.row_number().over(Window.orderBy(task, corpus.natural_key(F.col("query_id")))).alias("place"))


# ---- vectors, shots and gaps


@query(f"WITH {VECS} SELECT video_id, n, round(embedding[1]::DOUBLE / greatest({NORM.format('embedding')}, 1e-12), 6) AS first, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / greatest({NORM.format('embedding')}, 1e-12)) ** 2)), 6) AS square FROM vecs")
def unit_vectors(spark, d):
    u = vectors_of(spark, d).select("video_id", "n", normalised("embedding").alias("u"))
    return u.select("video_id", "n", F.round(F.col("u")[0], 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 6).alias("square"))


@query("SELECT CAST(CASE WHEN embedding IS NOT NULL THEN len(embedding) END AS INTEGER) AS dim, 'float' AS kind, count(DISTINCT video_id) AS videos, count(*) AS vectors FROM vectors GROUP BY ALL")
def vector_shapes(spark, d):
    return shots.vector_shapes(table(spark, d, "vectors"))


@query(f"{SPLIT}, s AS (SELECT round((end_frame - start_frame + 1) / coalesce(fps, 25.0), 6) AS s FROM z LEFT JOIN fp USING (video_id)), l AS (SELECT list_sort(list(s)) AS x FROM s) SELECT len(x) AS shots, round(list_avg(x), 6) AS mean_s, x[len(x) // 2 + 1] AS median_s, x[CAST(floor(len(x) * 0.9) AS BIGINT) + 1] AS p90_s, x[CAST(floor(len(x) * 0.99) AS BIGINT) + 1] AS p99_s, x[-1] AS longest_s, round(100.0 * len(list_filter(x, lambda v: v < 2)) / len(x), 6) AS under_pct, round(100.0 * len(list_filter(x, lambda v: v > 20)) / len(x), 6) AS over_pct FROM l")
def shot_length_shares(spark, d):
    return shots.shot_length_shares(_split(spark, d), fps_of(spark, d))


@query("WITH g AS (SELECT frame_idx - lag(frame_idx) OVER (PARTITION BY video_id ORDER BY n) AS gap FROM keyframes WHERE frame_idx IS NOT NULL) SELECT round(least(1.0, 10 / avg(gap)), 6) AS rate FROM g WHERE gap IS NOT NULL")
def window_hit_rate(spark, d):
    return shots.window_hit_rate(table(spark, d, "keyframes"))


@query(f"WITH {FRAMES} SELECT frame_key, CASE WHEN frame + 12 <= frame + 40 + frame_key % 90 - 45 THEN list_transform(range(frame::BIGINT + 12, frame::BIGINT + frame_key % 90 - 4, 25), lambda x: x::INTEGER) ELSE [CAST(trunc((frame + frame + frame_key % 90 - 5) / 2) AS INTEGER)] END AS frames FROM fr")
def spread_frames(spark, d):
    rows = table(spark, d, "review_frames").where("video_id is not null and frame is not null").select("frame_key", "frame").distinct()
    end = (F.col("frame") + F.col("frame_key") % 90 - 5).cast("int")
    return rows.select("frame_key", coverage.spread_frames(F.col("frame"), end, 25).alias("frames"))


# ---- channels over ordered moments

_POSITIONS = "row_number() OVER (PARTITION BY video_id ORDER BY frame, n) AS t"


@query(f"WITH {MOMENTS}, {SHOTS}, p AS (SELECT *, {_POSITIONS} FROM sims), c AS (SELECT *, max(a) OVER (PARTITION BY video_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p), e AS (SELECT video_id, t, frame, before, before + b AS total FROM c WHERE before IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY before + b DESC, t) = 1), s AS (SELECT e.video_id, arg_min(p.frame, p.t) AS first FROM e JOIN p ON p.video_id = e.video_id AND p.t < e.t AND p.a = e.before GROUP BY 1), found AS (SELECT e.video_id, shot_id, round(total / 2, 9) AS score, e.frame AS anchor, s.first AS start_frame, e.frame AS end_frame FROM e JOIN s USING (video_id) JOIN shot ON shot.video_id = e.video_id AND e.frame BETWEEN shot.start_frame AND shot.end_frame) SELECT 'q' AS query_id, 'dense_temporal_kis' AS channel, video_id, shot_id, row_number() OVER (ORDER BY score DESC, video_id) AS rank, score, anchor, start_frame, end_frame FROM found")
def temporal_channel(spark, d):
    rows = shots.frames_to_shots(_moments(spark, d).drop("embedding"), _shots(spark, d))
    return align.temporal_channel(rows)


_PEAKS = f"p AS (SELECT *, {_POSITIONS} FROM sims), each AS (SELECT video_id, t, frame, 1 AS c, a AS s FROM p UNION ALL SELECT video_id, t, frame, 2, b FROM p), peak AS (SELECT *, row_number() OVER (PARTITION BY video_id, c ORDER BY s DESC, t) AS k FROM each QUALIFY k <= 12), near AS (SELECT x.video_id, x.c AS sc, x.k AS sk, y.c, y.t, y.s FROM peak x JOIN peak y ON x.video_id = y.video_id AND abs(x.frame - y.frame) <= 225 QUALIFY row_number() OVER (PARTITION BY x.video_id, x.c, x.k, y.c ORDER BY y.k) = 1), cluster AS (SELECT video_id, sc, sk, sum(s) / 2 AS mean, min(t) AS lo, max(t) AS hi FROM near GROUP BY ALL HAVING count(*) = 2), top AS (SELECT x.video_id, sc, sk, mean, arg_max(p.frame, struct_pack(f := p.a, t := -p.t)) AS frame, max(p.a) AS f FROM cluster x JOIN p ON p.video_id = x.video_id AND p.t BETWEEN lo AND hi GROUP BY ALL), refined AS (SELECT video_id, frame AS refined FROM top QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(0.75 * mean + 0.15 * mean + 0.10 * f, 12) DESC, sc, sk) = 1)"


@query(f"WITH {MOMENTS}, {SHOTS}, {_PEAKS}, c AS (SELECT x.video_id, x.frame, 0.85 * (max(y.a) + max(y.b)) / 2 + 0.15 * max(y.a) AS centre, arg_max(y.frame, struct_pack(s := y.a, f := -y.frame)) AS anchor FROM sims x JOIN sims y ON x.video_id = y.video_id AND y.frame BETWEEN x.frame - 225 AND x.frame + 225 GROUP BY x.video_id, x.n, x.frame), best AS (SELECT c.video_id, shot_id, round(centre, 9) AS score, anchor FROM c JOIN shot ON shot.video_id = c.video_id AND anchor BETWEEN start_frame AND end_frame QUALIFY row_number() OVER (PARTITION BY c.video_id, shot_id ORDER BY round(centre, 9) DESC, frame, anchor DESC) = 1), few AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, shot_id) AS k FROM best QUALIFY k <= 4), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, video_id, shot_id) AS rank FROM few QUALIFY rank <= 2000) SELECT 'q' AS query_id, 'dense_localized' AS channel, video_id, shot_id, rank, score, CASE WHEN k = 1 THEN coalesce(refined, anchor) ELSE anchor END AS anchor FROM ranked LEFT JOIN refined USING (video_id)")
def localized_channel(spark, d):
    rows = _moments(spark, d).drop("embedding").withColumn("full", F.col("sims")[0])
    return align.localized_channel(align.neighbourhood(rows, 2), _shots(spark, d))


# ---- loci, pools, windows, seeds


@query(f"WITH {GOOD}, fp AS (SELECT video_id, max(fps) FILTER (fps > 0) AS fps, max(frame_idx) AS last FROM keyframes GROUP BY 1), x AS (SELECT cand.*, last, greatest(1, ceil(0.5 * coalesce(fps, 25)))::BIGINT AS pad, count(*) OVER (PARTITION BY query_no, cand.video_id, shot_id % 3) AS share FROM cand LEFT JOIN fp USING (video_id)) SELECT qid AS query_id, cand_id, greatest(0, start_frame - pad) AS lo, greatest(greatest(0, start_frame - pad), least(end_frame + pad, coalesce(last, end_frame + pad))) AS hi, round(greatest(fused_score, 1e-9) / share, 9) AS weight, row_number() OVER (PARTITION BY query_no, video_id ORDER BY rnk) - 1 AS locus_id FROM x")
def locus_of_candidates(spark, d):
    c = candidates_of(spark, d).withColumn("cluster_id", F.col("shot_id") % 3)
    loci = coverage.build_loci(c, fps_of(spark, d))
    named = c.select("query_id", "video_id", "cand_id", (F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy("rank")) - 1).alias("locus_id"))
    return loci.join(named, ["query_id", "video_id", "locus_id"]).select("query_id", "cand_id", F.col("start_frame").alias("lo"), F.col("end_frame").alias("hi"), F.round("weight", 9).alias("weight"), "locus_id")


POOL = f"{GOOD}, l AS (SELECT qid AS query_id, video_id, start_frame AS s, end_frame AS e, anchor, greatest(fused_score, 1e-9) AS w FROM cand WHERE end_frame >= start_frame), c AS (SELECT *, list_transform(range(1, greatest(1, ceil((e - s + 1) / 25))::BIGINT + 1), lambda i: greatest(0, least(s + i * 25 - 1, e))) AS fs FROM l), o AS (SELECT query_id, video_id, w, CASE WHEN anchor BETWEEN s AND e THEN list_concat([anchor::BIGINT], list_filter(fs, lambda f: f <> anchor)) ELSE fs END AS fs FROM c)"


@query(f"WITH {POOL}, {VSCORES.replace(GOOD + ', ', '')}, f AS (SELECT query_id, video_id, w, unnest(fs[1:4]) AS frame, generate_subscripts(fs[1:4], 1) AS k FROM o) SELECT query_id, video_id, frame::INTEGER AS frame, round(max(pi * w / k), 9) AS score FROM f JOIN pi USING (query_id, video_id) GROUP BY ALL")
def frames_per_locus(spark, d):
    c = cut(candidates_of(spark, d).select("query_id", "video_id", "rank", "fused_score", "start_frame", "end_frame", "anchor"))
    loci = c.where("end_frame >= start_frame").select("query_id", "video_id", F.col("rank").alias("locus_id"), "start_frame", "end_frame", F.greatest("fused_score", F.lit(1e-9)).alias("weight"), "anchor")
    return coverage.frame_pool(loci, channels.video_scores(c), 25, least=1, per_locus=4).select("query_id", "video_id", "frame", F.round("score", 9).alias("score"))


@query(f"WITH {GOOD} SELECT qid AS query_id, rnk AS locus_id, end_frame - start_frame + 1 AS frames, greatest(1, ceil((end_frame - start_frame + 1) / 25))::INTEGER AS slots FROM cand WHERE end_frame >= start_frame")
def slots_needed(spark, d):
    loci = candidates_of(spark, d).where("end_frame >= start_frame").withColumn("locus_id", F.col("rank"))
    return coverage.slots_needed(loci, fps_of(spark, d)).select("query_id", "locus_id", "frames", "slots")


@query(f"WITH {VSCORES}, likely AS (SELECT query_id, video_id FROM pi QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(pi, 0) DESC, video_id) <= 20), span AS (SELECT qid AS query_id, video_id, min(start_frame) AS lo, max(end_frame) AS hi FROM cand GROUP BY ALL), x AS (SELECT query_id, video_id, n, frame_idx AS frame, frame_idx BETWEEN lo - ceil(15 * CASE WHEN fps > 0 THEN fps ELSE 25 END) AND hi + ceil(15 * CASE WHEN fps > 0 THEN fps ELSE 25 END) AS inside FROM span JOIN likely USING (query_id, video_id) JOIN keyframes USING (video_id) WHERE frame_idx IS NOT NULL) SELECT query_id, video_id, n, frame FROM x QUALIFY inside OR count(*) FILTER (inside) OVER (PARTITION BY query_id, video_id) < 2")
def moment_windows(spark, d):
    c = candidates_of(spark, d)
    return align.moment_windows(c, channels.video_scores(c), table(spark, d, "keyframes"))


@query(f"WITH {VSCORES}, lr AS (SELECT qid AS query_id, video_id, min(struct_pack(r := ranks['dense_localized'], m := -fused_score, s := shot_id, a := anchor)) AS b FROM cand WHERE ranks['dense_localized'] IS NOT NULL GROUP BY ALL), tops AS (SELECT qid AS query_id, video_id, arg_max(anchor, struct_pack(s := fused_score, f := -anchor)) AS frame FROM cand WHERE anchor IS NOT NULL GROUP BY ALL), seeds AS (SELECT query_id, video_id, b.a AS frame, 0 AS kind, b.r::DOUBLE AS x, b.m AS y FROM lr UNION ALL SELECT query_id, video_id, frame, 1, -coalesce(pi, 0), 0 FROM pi JOIN tops USING (query_id, video_id) WHERE (query_id, video_id) NOT IN (SELECT query_id, video_id FROM lr)) SELECT query_id, video_id, frame, row_number() OVER (PARTITION BY query_id ORDER BY kind, x, y, video_id) AS seed FROM seeds QUALIFY seed <= 20")
def localized_seeds(spark, d):
    c = candidates_of(spark, d)
    pool = c.where("anchor is not null").select("query_id", "video_id", F.col("anchor").alias("frame"), F.col("fused_score").alias("score"))
    return coverage.localized_seeds(c, channels.video_scores(c), pool)


@query(f"WITH {GOOD}, t AS (SELECT qid AS query_id, rnk AS rank, video_id, least(1.0, sum(1.0 / (rnk + 40.0)) OVER (PARTITION BY qid ORDER BY rnk)) AS c FROM cand WHERE rnk <= 100), a AS (SELECT query_id, {', '.join(f'max(c) FILTER (rank <= {k}) AS p{k}' for k in config.THRESHOLDS)}, count(DISTINCT video_id) AS videos, count(*) AS answers FROM t GROUP BY query_id) SELECT query_id, {', '.join(f'round(p{k}, 6) AS p{k}' for k in config.THRESHOLDS)}, round(({' + '.join(f'p{k}' for k in config.THRESHOLDS)}) / 5, 6) AS expected_final, videos, answers FROM a")
def trace_at_thresholds(spark, d):
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = candidates_of(spark, d).where("rank <= 100").withColumn("cumulative", F.least(F.lit(1.0), F.sum(1.0 / (F.col("rank") + 40.0)).over(order)))
    t = coverage.trace(rows.select("query_id", "rank", "video_id", "cumulative"))
    return t.select("query_id", *(r6(f"p{k}") for k in config.THRESHOLDS), r6("expected_final"), "videos", "answers")


# ---- clusters of a query's candidates, in order

_NEAR_KF = f"kf AS (SELECT video_id, frame_idx, min(n) AS n FROM keyframes WHERE frame_idx IS NOT NULL GROUP BY ALL), capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_no, video_id ORDER BY rnk) AS iv FROM cand) WHERE iv <= 12 QUALIFY row_number() OVER (PARTITION BY query_no ORDER BY rnk) <= 500), placed AS (SELECT cand_id, arg_min(kf.n, abs(anchor - frame_idx)::BIGINT * 10000000 + frame_idx) AS n FROM capped JOIN kf USING (video_id) WHERE anchor IS NOT NULL GROUP BY cand_id), {VECS}"
_UNIT = "CASE WHEN list_sum(list_transform(embedding, lambda x: abs(x))) > 0 THEN list_transform(embedding, lambda x: x::DOUBLE / " + NORM.format("embedding") + ") END"


@query(f"WITH RECURSIVE {GOOD}, {_NEAR_KF}, c AS (SELECT qid, cand_id, row_number() OVER (PARTITION BY qid ORDER BY rnk) AS k, {_UNIT} AS u FROM capped LEFT JOIN placed USING (cand_id) LEFT JOIN vecs ON vecs.video_id = capped.video_id AND vecs.n = placed.n), near AS (SELECT a.qid, a.k, list(b.k ORDER BY b.k) AS ks FROM c a JOIN c b ON a.qid = b.qid AND b.k < a.k AND list_dot_product(a.u, b.u) >= 0.92 GROUP BY ALL), x AS (SELECT c.qid, c.cand_id, c.k, u IS NOT NULL AS has, coalesce(ks, []) AS ks FROM c LEFT JOIN near USING (qid, k)), s AS (SELECT qid, 0::BIGINT AS k, []::BIGINT[] AS leaders, []::BIGINT[] AS names, 0::BIGINT AS free, -1::BIGINT AS cand_id, -1::BIGINT AS cluster_id FROM (SELECT DISTINCT qid FROM x) UNION ALL SELECT x.qid, x.k, CASE WHEN hit IS NULL AND has THEN list_append(leaders, x.k) ELSE leaders END, CASE WHEN hit IS NULL AND has THEN list_append(names, free) ELSE names END, CASE WHEN hit IS NULL THEN free + 1 ELSE free END, x.cand_id, CASE WHEN hit IS NULL THEN free ELSE names[list_position(leaders, hit)] END FROM (SELECT s.*, x.*, list_filter(s.leaders, lambda l: list_contains(x.ks, l))[1] AS hit FROM s JOIN x ON x.qid = s.qid AND x.k = s.k + 1) AS x(q0, k0, leaders, names, free, c0, i0, qid, cand_id, k, has, ks, hit)) SELECT qid AS query_id, cand_id, cluster_id::INTEGER AS cluster_id FROM s WHERE k > 0")
def leader_clusters(spark, d):
    from sightline.plans.reference import _clustered

    return _clustered(spark, d).select("query_id", "cand_id", "cluster_id")


# ---- review against the truth

_TRUTH = "truth AS (SELECT qid AS query_id, video_id, start_frame AS s, end_frame AS e FROM cand WHERE start_frame IS NOT NULL AND end_frame IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cand_id) = 1)"
_REVIEWED = f"WITH {VSCORES}, {_TRUTH}, ranks AS (SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(pi, 0) DESC, video_id) AS r FROM pi), shown AS (SELECT CAST(query_no AS VARCHAR) AS query_id, video_id, anchor AS frame, rnk AS scan FROM cand WHERE rnk % 3 = 0 AND anchor IS NOT NULL), met AS (SELECT query_id, min(scan) AS first_thumbnail, min(greatest(0, s - frame, frame - e)) AS gap FROM shown JOIN truth USING (query_id, video_id) GROUP BY 1), fp AS (SELECT video_id, max(fps) FILTER (fps > 0) AS fps FROM keyframes GROUP BY 1), row AS (SELECT truth.query_id, r AS video_rank, r AS auto_video_rank, first_thumbnail, gap, gap / coalesce(fps, 25.0) AS sec, (SELECT count(*) FROM shown WHERE shown.query_id = truth.query_id) AS thumbnails FROM truth LEFT JOIN met USING (query_id) LEFT JOIN ranks ON ranks.query_id = truth.query_id AND ranks.video_id = truth.video_id LEFT JOIN fp ON fp.video_id = truth.video_id)".replace("row AS (SELECT truth", "rows AS (SELECT truth")


def _against(spark, d):
    c = cut(candidates_of(spark, d))
    scores = channels.video_scores(c)
    ranks = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("pi"), "video_id"))).select("query_id", "video_id", "rank")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("cand_id"))
    t = c.where("start_frame is not null and end_frame is not null").withColumn("k", first).where("k = 1")
    truths = t.select("query_id", "video_id", F.array(F.struct(F.col("start_frame").alias("s"), F.col("end_frame").alias("e"))).alias("spans"))
    shown = c.where("rank % 3 = 0 and anchor is not null").select("query_id", "video_id", F.col("anchor").alias("frame"), F.col("rank").alias("scan"), F.lit(False).alias("rescued"))
    return review.against_truth(shown, truths, ranks, ranks, fps_of(spark, d))


@query(f"{_REVIEWED} SELECT query_id, video_rank, auto_video_rank, first_thumbnail IS NOT NULL AS shown, first_thumbnail, coalesce(gap = 0, false) AS frame_hit, gap AS nearest_frame_gap, round(sec, 6) AS nearest_gap_seconds, {', '.join(f'coalesce(sec <= {k}, false) AS near_{k}s' for k in review.GAP_SECONDS)}, thumbnails FROM rows")
def review_against_truth(spark, d):
    """Every third candidate as a shown frame, against the span of the query's first candidate."""
    return _against(spark, d).drop("rescued").withColumn("nearest_gap_seconds", F.round("nearest_gap_seconds", 6))


@query(f"{_REVIEWED} SELECT count(*) AS queries, {', '.join(f'round(avg(CASE WHEN video_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}' for k in (5, 10, 20, 50, 100))}, count(first_thumbnail) AS shown, count(*) FILTER (gap = 0) AS frame_hits, {', '.join(f'count(*) FILTER (sec <= {k}) AS near_{k}s' for k in review.GAP_SECONDS)}, round(quantile_cont(sec, 0.5), 6) AS median_gap_seconds, quantile_cont(first_thumbnail, 0.5) AS median_thumbnails FROM rows")
def review_evaluation(spark, d):
    return review.review_summary(_against(spark, d)).withColumn("median_gap_seconds", F.round("median_gap_seconds", 6))


@query(f"WITH {CAND}, p AS (SELECT cand_id, list_transform(map_values(ranks), lambda r: 1.0 / (1 + r)) AS p FROM latest WHERE ranks IS NOT NULL) SELECT cand_id, round(1 - coalesce(list_product(list_transform(p, lambda x: 1 - x)), 1), 6) AS any_channel, round(coalesce(list_product(p), 1), 9) AS all_channels FROM p")
def union_and_series_recall(spark, d):
    from sightline.operators.versions import latest

    rows = latest(table(spark, d, "candidates").select("cand_id", "ranks", "ingested_at"), "cand_id", "ingested_at").where("ranks is not null")
    p = F.transform(F.map_values("ranks"), lambda r: 1.0 / (1 + r))
    return rows.select("cand_id", r6(channels.union_recall(p), "any_channel"), F.round(channels.series_recall(p), 9).alias("all_channels"))


@query("SELECT video_id, n, list_sort([abs(frame_idx - 1000), abs(frame_idx - 500)])[1] AS nearest, CASE WHEN abs(frame_idx - 1000) < abs(frame_idx - 500) THEN 1000 ELSE 500 END AS first FROM keyframes WHERE frame_idx IS NOT NULL")
def anchor_first(spark, d):
    rows = table(spark, d, "keyframes").where("frame_idx is not null")
    ordered = coverage.anchor_first(F.col("frame_idx"), F.array(F.lit(1000), F.lit(500)))
    return rows.select("video_id", "n", F.abs(ordered[0] - F.col("frame_idx")).alias("nearest"), ordered[0].alias("first"))



# ---- the engine end to end: no SQL, as its towers are stand-ins; checked step by step above and in the tests


def _engine(spark, d):
    keyframes, media = table(spark, d, "keyframes"), table(spark, d, "media_info")
    return Engine.over(spark, keyframes, cut(vectors_of(spark, d)), cut(docs_of(spark, d)), media, encoder=hash_encoder(64))


def _texts(spark, d):
    return queries_of(spark, d).where("raw is not null").select("query_id", "raw", "english")


@query()
def solve(spark, d):
    """Ordered answers to every query, from text and vectors to the allocation."""
    return _engine(spark, d).solve(_texts(spark, d)).select("query_id", "task", "rank", "video_id", "frame", "frames", r6("gain"), r6("cumulative"), "source")

