"""Queries of the engine's own operators over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline import config
from sightline.functions import text
from sightline.functions.vector import cosine
from sightline.operators import align, channels, coverage, dense, devset, review, scoring, shots, text_search
from sightline.operators.versions import latest
from sightline.plans import parse
from sightline.session import cut, table
from sightline.sources import corpus

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c, name=None):
    return F.round(c, 6).alias(name or (c if isinstance(c, str) else "x"))


# ---- tables as the operators take them


def docs_of(spark, d):
    return latest(table(spark, d, "docs"), "doc_id")


def queries_of(spark, d):
    return latest(table(spark, d, "queries"), "query_no").withColumn("query_id", F.col("query_no").cast("string"))


def candidates_of(spark, d):
    """Latest candidates with a video and a usable score; query_id is the query number as text, rank the order by score."""
    rows = latest(table(spark, d, "candidates"), "cand_id", "ingested_at").where("video_id is not null and query_no is not null and fused_score is not null and not isnan(fused_score)")
    order = Window.partitionBy("query_no").orderBy(F.desc("fused_score"), "cand_id")
    return rows.withColumn("query_id", F.col("query_no").cast("string")).withColumn("rank", F.row_number().over(order))


def hits_of(spark, d, by_query=False):
    rows = latest(table(spark, d, "candidates").select("cand_id", "query_no", "video_id", "shot_id", "ranks", "ingested_at"), "cand_id", "ingested_at").where("video_id is not null and query_no is not null and shot_id is not null")
    rows = rows.select(F.col("query_no").cast("string").alias("query_id"), "video_id", "shot_id", "ranks")
    rows = rows.repartition("query_id") if by_query else rows  # before each channel is a row
    return rows.select("query_id", "video_id", "shot_id", F.explode("ranks").alias("channel", "rank")).withColumn("score", F.lit(0.0))


def vectors_of(spark, d):
    return table(spark, d, "vectors").where("embedding is not null").groupBy("video_id", "n").agg(F.max("embedding").alias("embedding"))


def fps_of(spark, d):
    return table(spark, d, "keyframes").groupBy("video_id").agg(F.max(F.when(F.col("fps") > 0, F.col("fps"))).alias("fps"), F.max("frame_idx").alias("last_frame"))


# ---- SQL fragments

ONE_DOCS = "one AS (SELECT doc_id, any_value(video_id) AS video_id, any_value(text) AS text FROM docs WHERE doc_id IS NOT NULL GROUP BY doc_id)"
ONE_QUERIES = "q AS (SELECT CAST(query_no AS VARCHAR) AS query_id, any_value(raw) AS raw, any_value(entities) AS entities FROM queries WHERE query_no IS NOT NULL GROUP BY query_no)"
CAND = "latest AS (SELECT * FROM candidates WHERE cand_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
GOOD = f"{CAND}, cand AS (SELECT *, CAST(query_no AS VARCHAR) AS qid, row_number() OVER (PARTITION BY query_no ORDER BY fused_score DESC, cand_id) AS rnk FROM latest WHERE video_id IS NOT NULL AND query_no IS NOT NULL AND fused_score IS NOT NULL AND NOT isnan(fused_score))"
HITS = f"{CAND}, hits AS (SELECT CAST(query_no AS VARCHAR) AS query_id, video_id, shot_id, e.key AS channel, e.value AS rank FROM (SELECT query_no, video_id, shot_id, unnest(map_entries(ranks)) AS e FROM latest WHERE video_id IS NOT NULL AND query_no IS NOT NULL AND shot_id IS NOT NULL))"
VECS = "vecs AS (SELECT video_id, n, max(embedding) AS embedding FROM vectors WHERE embedding IS NOT NULL GROUP BY video_id, n)"


def _quoted(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def norm_sql(x):
    return f"trim(regexp_replace(lower(nfc_normalize({x})), '[\\t-\\r \\x{{85}}\\pZ\\x{{1c}}-\\x{{1f}}]+', ' ', 'g'))"


def tok_sql(x):
    inner = norm_sql(f"coalesce({x}, '')")
    for phrase in text.NOISE_PHRASES:
        inner = f"replace({inner}, '{phrase}', ' ')"
    return f"list_filter(regexp_extract_all({inner}, '[\\pL\\pN_]+'), lambda t: NOT list_contains({_quoted(text.STOPWORDS)}, t))"


def strip_sql(x):
    return f"strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'D'))"


def gram_sql(x, n=3):
    flat = f"regexp_replace(lower({strip_sql(f'''coalesce({x}, '')''')}), '[\\t-\\r \\x{{85}}\\pZ]+', ' ', 'g')"
    return f"(SELECT CASE WHEN length(f) >= {n} THEN list_distinct(list_transform(range(1, length(f) - {n - 2}), lambda i: substring(f, i, {n}))) WHEN length(f) > 0 THEN [f] ELSE [] END FROM (SELECT {flat} AS f))"


# ---- text functions and sparse search

TF = f"WITH {ONE_DOCS}, tok AS (SELECT doc_id, {tok_sql('text')} AS ts FROM one), tf AS (SELECT doc_id, len(ts) AS dl, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM tok) GROUP BY doc_id, len(ts), term)"
DF = f"{TF}, df AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM one) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term)"


@query(f"WITH {ONE_DOCS} SELECT doc_id, {norm_sql('text')} AS plain FROM one")
def normalize_text(spark, d):
    return docs_of(spark, d).select("doc_id", text.normalize(F.col("text")).alias("plain"))


@query(f"SELECT video_id, {strip_sql('title')} AS bare, count(*) AS deliveries FROM media_info GROUP BY ALL")
def strip_marks(spark, d):
    return table(spark, d, "media_info").groupBy("video_id", text.strip_diacritics(F.col("title")).alias("bare")).agg(F.count("*").alias("deliveries"))


@query(f"{TF} SELECT doc_id, dl, term, tf FROM tf")
def tokenize_counts(spark, d):
    one = docs_of(spark, d).select("doc_id", text.tokens(F.col("text")).alias("ts"))
    return one.select("doc_id", F.size("ts").cast("long").alias("dl"), F.explode("ts").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def _index(spark, d, **kw):
    return text_search.TextIndex.build(docs_of(spark, d).select("doc_id", "text"), **kw)


@query(f"{DF} SELECT term, df, round(idf, 6) AS idf FROM df")
def idf_stats(spark, d):
    return _index(spark, d).terms.select("term", "df", r6("idf"))


QTOK = f"{ONE_QUERIES}, qt AS (SELECT query_id, list_filter({tok_sql('raw')}, lambda t: NOT list_contains({_quoted(text.QUERY_FRAME_WORDS)}, t) AND NOT regexp_full_match(t, '\\pN+') AND length(t) >= 2) AS ts FROM q), qu AS (SELECT query_id, term, min(pos) AS pos FROM (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM qt) GROUP BY query_id, term)"
INFORMATIVE = f"{DF}, {QTOK}, chosen AS (SELECT query_id, term FROM qu JOIN df USING (term) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY idf DESC, pos) <= 8)"


@query(f"{INFORMATIVE} SELECT query_id, term FROM chosen")
def informative_terms(spark, d):
    q = queries_of(spark, d).select("query_id", text.tokens(F.col("raw")).alias("tokens"))
    return _index(spark, d).informative_terms(q).select("query_id", "term")


BM25 = "idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / (SELECT sum(tf) / (SELECT count(*) FROM one) FROM tf)))"


@query(f"{INFORMATIVE}, s AS (SELECT query_id, doc_id, round(sum({BM25}), 9) AS score FROM tf JOIN df USING (term) JOIN chosen USING (term) GROUP BY query_id, doc_id) SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20")
def bm25_topk(spark, d):
    index = _index(spark, d)
    q = queries_of(spark, d).select("query_id", text.tokens(F.col("raw")).alias("tokens"))
    return index.search(index.informative_terms(q), 20).select("query_id", "doc_id", r6("score"), "rank")


MEDIA1 = "media AS (SELECT video_id, max(title) AS title FROM media_info WHERE video_id IS NOT NULL GROUP BY video_id)"
GRAMS = f"WITH {MEDIA1}, grams AS (SELECT video_id, unnest({gram_sql('title')}) AS gram FROM media), stats AS (SELECT gram, count(*) AS df, ln(1 + (SELECT count(*) FROM media) / count(*)) AS idf FROM grams GROUP BY gram)"


def _titles(spark, d):
    return table(spark, d, "media_info").where("video_id is not null").groupBy("video_id").agg(F.max("title").alias("text"))


@query(f"{GRAMS} SELECT gram, df, round(idf, 6) AS idf FROM stats")
def ngram_idf(spark, d):
    return text_search.GramIndex.build(_titles(spark, d), "video_id").stats.select("gram", "df", r6("idf"))


@query(f"{GRAMS}, {ONE_QUERIES}, e AS (SELECT DISTINCT query_id, unnest(entities) AS entity FROM q), eg AS (SELECT query_id, entity, gram, idf FROM (SELECT query_id, entity, unnest({gram_sql('entity')}) AS gram FROM e) JOIN stats USING (gram)), tot AS (SELECT query_id, entity, sum(idf) AS total FROM eg GROUP BY ALL), cov AS (SELECT query_id, entity, video_id, round(sum(idf) / any_value(total), 9) AS coverage FROM eg JOIN grams USING (gram) JOIN tot USING (query_id, entity) WHERE total > 0 GROUP BY query_id, entity, video_id), s AS (SELECT query_id, video_id AS doc_id, round(sum(coverage), 9) AS score FROM cov WHERE coverage >= 0.34 GROUP BY ALL) SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 50")
def fuzzy_entity_match(spark, d):
    names = queries_of(spark, d).select("query_id", F.explode("entities").alias("entity"))
    return text_search.GramIndex.build(_titles(spark, d), "video_id").search(names, 50).select("query_id", "doc_id", r6("score"), "rank")


@query("SELECT DISTINCT video_id, trim(title) AS text FROM media_info WHERE trim(coalesce(title, '')) <> ''")
def title_docs(spark, d):
    return corpus.title_docs(table(spark, d, "media_info")).select("video_id", "text").distinct()


@query("SELECT DISTINCT video_id, text FROM (SELECT video_id, concat_ws(chr(32) || chr(10) || chr(32), CASE WHEN trim(title) <> '' THEN title END, CASE WHEN trim(author) <> '' THEN author END, CASE WHEN trim(publish_date) <> '' THEN publish_date END, CASE WHEN trim(substring(description, 1, 2000)) <> '' THEN substring(description, 1, 2000) END, CASE WHEN trim(array_to_string(keywords[1:60], ' ')) <> '' THEN array_to_string(keywords[1:60], ' ') END) AS text FROM media_info) WHERE text <> ''")
def media_docs(spark, d):
    return corpus.media_docs(table(spark, d, "media_info")).select("video_id", "text").distinct()


# ---- fusion, caps, video scores


@query(f"WITH {HITS}, best AS (SELECT query_id, video_id, shot_id, channel, min(rank) AS rank FROM hits WHERE rank <= 2000 GROUP BY ALL), fused AS (SELECT query_id, video_id, shot_id, round(sum(1 / (60.0 + rank)), 12) AS fused_score, count(*) AS n_channels FROM best GROUP BY ALL) SELECT query_id, video_id, shot_id, round(fused_score, 9) AS fused_score, n_channels, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, n_channels DESC, '(''' || video_id || ''', ' || shot_id || ')') AS rank FROM fused")
def rrf_fuse(spark, d):
    return channels.fuse(hits_of(spark, d)).select("query_id", "video_id", "shot_id", F.round("fused_score", 9).alias("fused_score"), "n_channels", "rank")


VIDEO_HITS = "vfirst AS (SELECT query_id, channel, video_id, min(rank) AS f FROM hits GROUP BY ALL), vhits AS (SELECT query_id, channel, video_id, row_number() OVER (PARTITION BY query_id, channel ORDER BY f, video_id) AS rank FROM vfirst)"


@query(f"WITH {HITS}, {VIDEO_HITS}, fused AS (SELECT query_id, video_id, round(sum(1 / (60.0 + rank)), 12) AS fused_score, count(*) AS n_channels FROM vhits WHERE rank <= 2000 GROUP BY ALL) SELECT query_id, video_id, round(fused_score, 9) AS fused_score, n_channels, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, n_channels DESC, '(''' || video_id || ''', 0)') AS rank FROM fused")
def rrf_video_level(spark, d):
    return channels.fuse(channels.video_hits(hits_of(spark, d))).select("query_id", "video_id", F.round("fused_score", 9).alias("fused_score"), "n_channels", "rank")


@query(f"WITH {GOOD} SELECT query_no, cand_id, in_video FROM (SELECT *, row_number() OVER (PARTITION BY query_no, video_id ORDER BY rnk) AS in_video FROM cand) WHERE in_video <= 12 QUALIFY row_number() OVER (PARTITION BY query_no ORDER BY rnk) <= 500")
def cap_per_group(spark, d):
    return channels.cap_per_video(candidates_of(spark, d)).select("query_no", "cand_id", "in_video")


VSCORES = f"{GOOD}, vs AS (SELECT qid AS query_id, video_id, sum(fused_score / k) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY qid, video_id ORDER BY fused_score DESC) AS k FROM cand) GROUP BY ALL), pi AS (SELECT query_id, video_id, raw, pow(raw, 3) / sum(pow(raw, 3)) OVER (PARTITION BY query_id) AS pi FROM vs)"


@query(f"WITH {VSCORES} SELECT query_id, video_id, round(raw, 6) AS raw FROM vs")
def rank_discounted_video_score(spark, d):
    return channels.video_scores(candidates_of(spark, d)).select("query_id", "video_id", r6("raw"))


@query(f"WITH {VSCORES} SELECT query_id, video_id, round(coalesce(pi, 0), 6) AS pi FROM pi")
def pi_sharpen_normalise(spark, d):
    return channels.video_scores(candidates_of(spark, d)).select("query_id", "video_id", r6("pi"))


DOMAIN = "CASE split_part(video_id, '_', 1) " + " ".join(f"WHEN '{g}' THEN '{x}'" for g, x in config.GROUP_DOMAIN.items()) + " ELSE 'unknown' END"
FRIEND = f"CASE {DOMAIN} " + " ".join(f"WHEN '{x}' THEN {v}" for x, v in config.TRAKE_FRIENDLY.items()) + " ELSE 0.5 END"
PRIOR = f"(CASE WHEN len(coalesce(hints, [])) = 0 THEN 1.0 WHEN list_contains(hints, {DOMAIN}) THEN 2.2 ELSE 0.55 END) * (CASE WHEN task = 'trake' THEN greatest(0.25, least(4.0, 0.4 + 2.1 * {FRIEND})) ELSE 1.0 END)"


@query(f"WITH {VSCORES}, qq AS (SELECT CAST(query_no AS VARCHAR) AS query_id, any_value(task) AS task, any_value(domain_hints) AS hints FROM queries GROUP BY query_no), t AS (SELECT query_id, video_id, coalesce(pi, 0) * {PRIOR} AS p FROM pi LEFT JOIN qq USING (query_id)) SELECT query_id, video_id, round(coalesce(p / nullif(sum(p) OVER (PARTITION BY query_id), 0), 0), 6) AS pi FROM t")
def domain_prior(spark, d):
    q = queries_of(spark, d).select("query_id", "task", "domain_hints")
    return channels.apply_prior(channels.video_scores(candidates_of(spark, d)), q).select("query_id", "video_id", r6("pi"))


@query(f"WITH {GOOD} SELECT qid AS query_id, count(*) AS candidates, count(DISTINCT video_id) AS videos, count(*) FILTER (cardinality(ranks) >= 2) AS agreed FROM cand GROUP BY qid")
def channel_diagnostics(spark, d):
    return channels.diagnostics(candidates_of(spark, d))


@query(f"WITH {HITS}, {VIDEO_HITS}, fused AS (SELECT query_id, video_id, round(sum(1 / (60.0 + rank)), 12) AS s, count(*) AS c FROM vhits WHERE rank <= 2000 GROUP BY ALL), pool AS (SELECT query_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, c DESC, '(''' || video_id || ''', 0)') AS video_rank FROM fused QUALIFY video_rank <= 300), capped AS (SELECT DISTINCT CAST(query_no AS VARCHAR) AS query_id, video_id, true AS known FROM (SELECT query_no, video_id, row_number() OVER (PARTITION BY query_no ORDER BY fused_score DESC, cand_id) AS rnk, row_number() OVER (PARTITION BY query_no, video_id ORDER BY fused_score DESC, cand_id) AS k FROM latest WHERE video_id IS NOT NULL AND query_no IS NOT NULL AND fused_score IS NOT NULL AND NOT isnan(fused_score)) WHERE k <= 12 QUALIFY row_number() OVER (PARTITION BY query_no ORDER BY rnk) <= 500) SELECT query_id, video_id, video_rank, known IS NULL AS recall_only FROM pool LEFT JOIN capped USING (query_id, video_id)")
def recall_only_antijoin(spark, d):
    return channels.recall_pool(cut(hits_of(spark, d)), channels.cap_per_video(candidates_of(spark, d))).select("query_id", "video_id", "video_rank", "recall_only")


@query(f"WITH {GOOD} SELECT channel, count(*) AS candidates, count(DISTINCT qid) AS queries, min(rank) AS best, round(avg(rank), 6) AS mean FROM (SELECT qid, e.key AS channel, e.value AS rank FROM (SELECT qid, unnest(map_entries(ranks)) AS e FROM cand)) GROUP BY channel")
def channel_sizes(spark, d):
    each = candidates_of(spark, d).select("query_id", F.explode("ranks").alias("channel", "rank"))
    return each.groupBy("channel").agg(F.count("*").alias("candidates"), F.countDistinct("query_id").alias("queries"), F.min("rank").alias("best"), r6(F.avg("rank"), "mean"))


# ---- keyframes and shots

SHOTS = "starts AS (SELECT video_id, frame_idx AS s, list_sort(list_distinct(list(n))) AS keyframes FROM keyframes WHERE frame_idx IS NOT NULL GROUP BY ALL), shot AS (SELECT video_id, row_number() OVER w - 1 AS shot_id, s AS start_frame, coalesce(lead(s) OVER w - 1, s + (s - lag(s) OVER w) - 1, s) AS end_frame, keyframes FROM starts WINDOW w AS (PARTITION BY video_id ORDER BY s))"


def _shots(spark, d):
    return shots.shots_from_keyframes(table(spark, d, "keyframes"))


@query(f"WITH {SHOTS} SELECT video_id, shot_id, start_frame, end_frame, keyframes FROM shot")
def shots_from_keyframes(spark, d):
    return _shots(spark, d).drop("kind")


SPLIT = f"WITH {SHOTS}, fp AS (SELECT video_id, max(fps) AS fps FROM keyframes WHERE fps > 0 GROUP BY 1), x AS (SELECT shot.*, greatest(1, ceil(2.0 * coalesce(fps, 25)))::BIGINT AS lim, greatest(1, ceil(1.0 * coalesce(fps, 25)))::BIGINT AS part FROM shot LEFT JOIN fp USING (video_id)), y AS (SELECT *, CASE WHEN end_frame - start_frame + 1 > lim THEN CAST(ceil((end_frame - start_frame + 1) / part) AS BIGINT) ELSE 1 END AS parts FROM x), z AS (SELECT video_id, CASE WHEN parts > 1 THEN start_frame + k * part ELSE start_frame END AS start_frame, CASE WHEN parts > 1 THEN least(start_frame + (k + 1) * part - 1, end_frame) ELSE end_frame END AS end_frame, CASE WHEN parts > 1 THEN 'split' ELSE 'shot' END AS kind FROM (SELECT *, unnest(range(parts)) AS k FROM y))"


def _split(spark, d):
    rate = F.coalesce("fps", F.lit(25.0))
    return shots.split_long_shots(_shots(spark, d).join(fps_of(spark, d).select("video_id", "fps"), "video_id", "left").withColumn("fps", rate), 2.0, 1.0)


@query(f"{SPLIT} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_frame) - 1 AS shot_id, start_frame, end_frame, kind FROM z")
def split_long_shots(spark, d):
    return _split(spark, d).drop("keyframes")


@query("WITH s AS (SELECT video_id, max(frame_idx) AS last, max(fps) AS fps FROM keyframes WHERE frame_idx IS NOT NULL AND fps > 0 GROUP BY 1), w AS (SELECT video_id, last, greatest(1, ceil(30 * fps))::BIGINT AS wide, unnest(range(0, last + 1, greatest(1, ceil(15 * fps))::BIGINT)) AS start_frame FROM s) SELECT video_id, start_frame, least(start_frame + wide - 1, last) AS end_frame FROM w")
def sliding_windows(spark, d):
    return shots.sliding_windows(table(spark, d, "keyframes")).drop("shot_id")


def _frames(spark, d):
    return table(spark, d, "review_frames").where("video_id is not null and frame is not null").select("frame_key", "video_id", "frame").distinct()


FRAMES = "fr AS (SELECT DISTINCT frame_key, video_id, frame FROM review_frames WHERE video_id IS NOT NULL AND frame IS NOT NULL)"


@query(f"WITH {SHOTS}, {FRAMES} SELECT frame_key, fr.video_id, frame, shot_id FROM fr LEFT JOIN shot ON fr.video_id = shot.video_id AND frame BETWEEN start_frame AND end_frame")
def frame_to_shot_join(spark, d):
    return shots.frames_to_shots(_frames(spark, d), _shots(spark, d)).select("frame_key", "video_id", "frame", "shot_id")


@query(f"WITH {FRAMES}, kf AS (SELECT video_id, frame_idx, min(n) AS n FROM keyframes WHERE frame_idx IS NOT NULL GROUP BY ALL) SELECT frame_key, any_value(fr.video_id) AS video_id, any_value(frame) AS frame, arg_min(kf.n, abs(frame - frame_idx)::BIGINT * 10000000 + frame_idx) AS nearest_n, arg_min(frame_idx, abs(frame - frame_idx)::BIGINT * 10000000 + frame_idx) AS nearest_frame FROM fr LEFT JOIN kf USING (video_id) GROUP BY frame_key")
def nearest_keyframe(spark, d):
    return shots.nearest_keyframes(_frames(spark, d), table(spark, d, "keyframes")).select("frame_key", "video_id", "frame", "nearest_n", "nearest_frame")


@query("WITH g AS (SELECT frame_idx - lag(frame_idx) OVER (PARTITION BY video_id ORDER BY n) AS gap FROM keyframes WHERE frame_idx IS NOT NULL) SELECT round(avg(gap), 6) AS mean, round(quantile_cont(gap, 0.5), 6) AS median, round(quantile_cont(gap, 0.9), 6) AS p90, round(quantile_cont(gap, 0.99), 6) AS p99, max(gap) AS longest FROM g WHERE gap IS NOT NULL")
def gap_stats(spark, d):
    return shots.gap_stats(table(spark, d, "keyframes"))


@query(f"{SPLIT}, l AS (SELECT kind, list_sort(list(end_frame - start_frame + 1)) AS x FROM z GROUP BY kind) SELECT kind, len(x) AS shots, round(list_avg(x), 6) AS mean, x[CAST(floor(len(x) * 0.5) AS BIGINT) + 1] AS median, x[CAST(floor(len(x) * 0.9) AS BIGINT) + 1] AS p90 FROM l")
def shot_stats(spark, d):
    return shots.shot_stats(_split(spark, d))


@query("WITH k AS (SELECT *, CASE WHEN fps > 0 AND pts_time >= 0 THEN pts_time * fps END AS x, pts_time < lag(pts_time) OVER (PARTITION BY video_id ORDER BY n) AS back FROM keyframes) SELECT video_id, count(*) AS keyframes, count(*) FILTER (frame_idx = floor(x)) AS floor, count(*) FILTER (frame_idx = round_even(x, 0)) AS round, count(*) FILTER (frame_idx = ceil(x)) AS ceil, count(DISTINCT fps) AS rates, count(frame_idx) - count(DISTINCT frame_idx) AS repeated, count(*) FILTER (back) AS backward FROM k GROUP BY video_id")
def convention_check(spark, d):
    return shots.check_convention(table(spark, d, "keyframes"))


@query("WITH k AS (SELECT abs(pts_time * fps - round_even(pts_time * fps, 0)) AS off FROM keyframes WHERE pts_time IS NOT NULL AND fps > 0) SELECT round(avg(CAST(off > 0.05 AS DOUBLE)), 6) AS off_grid, round(max(off), 6) AS greatest FROM k")
def grid_alignment(spark, d):
    return shots.grid_alignment(table(spark, d, "keyframes"))


@query("SELECT video_id, frame_idx, list_sort(list_distinct(list(n))) AS ns FROM keyframes WHERE frame_idx IS NOT NULL GROUP BY ALL HAVING len(list_distinct(list(n))) > 1")
def duplicate_frames(spark, d):
    return shots.duplicate_frames(table(spark, d, "keyframes"))


@query("SELECT video_id, n, CASE WHEN fps > 0 THEN round((frame_idx + 0.5) / fps, 6) END AS center, printf('%02d:%06.3f', CAST(floor(pts_time / 60) AS BIGINT), pts_time - floor(pts_time / 60) * 60) AS timecode FROM keyframes WHERE pts_time IS NOT NULL")
def timecodes(spark, d):
    k = table(spark, d, "keyframes").where("pts_time is not null")
    return k.select("video_id", "n", r6(shots.frame_to_time(F.col("frame_idx"), F.col("fps"), True), "center"), text.timecode(F.col("pts_time")).alias("timecode"))


@query("SELECT video_id, CAST(CASE WHEN regexp_full_match(publish_date, '\\d{1,2}/\\d{1,2}/\\d{4}') THEN try_strptime(publish_date, '%d/%m/%Y') WHEN regexp_full_match(publish_date, '\\d{4}-\\d{1,2}-\\d{1,2}') THEN try_strptime(publish_date, '%Y-%m-%d') END AS DATE) AS published, count(*) AS deliveries FROM media_info GROUP BY ALL")
def publish_dates(spark, d):
    day = F.coalesce(*(F.when(F.col("publish_date").rlike(shape), F.try_to_date("publish_date", form)) for shape, form in (("^\\d{1,2}/\\d{1,2}/\\d{4}$", "d/M/yyyy"), ("^\\d{4}-\\d{1,2}-\\d{1,2}$", "yyyy-M-d"))))
    return table(spark, d, "media_info").groupBy("video_id", day.alias("published")).agg(F.count("*").alias("deliveries"))


# ---- dense search


def _query_vectors(spark, d):
    keys = table(spark, d, "review_frames").where("frame_key % 50 = 0").select("frame_key", "video_id", "n").distinct()
    return keys.join(vectors_of(spark, d), ["video_id", "n"]).select(F.col("frame_key").cast("string").alias("query_id"), F.col("embedding").alias("v"))


NORM = "sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE)))"
COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (" + NORM.format("a.embedding") + " * " + NORM.format("b.embedding") + ")"
DENSE = f"{VECS}, good AS (SELECT * FROM vecs WHERE list_sum(list_transform(embedding, lambda x: abs(x))) > 0), qk AS (SELECT DISTINCT frame_key, video_id, n FROM review_frames WHERE frame_key % 50 = 0), sim AS (SELECT CAST(frame_key AS VARCHAR) AS query_id, b.video_id, b.n, round({COSINE}, 9) AS score FROM qk JOIN good a USING (video_id, n), good b), top AS (SELECT query_id, video_id, n, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, n) AS rank FROM sim QUALIFY rank <= 50)"


def _dense(spark, d, k=50):
    return dense.search(vectors_of(spark, d), _query_vectors(spark, d), k)


@query(f"WITH {DENSE} SELECT query_id, video_id, n, round(score, 6) AS score FROM top WHERE rank <= 20")
def dense_topk(spark, d):
    return _dense(spark, d, 20).select("query_id", "video_id", "n", r6("score"))


@query(f"WITH {DENSE}, {SHOTS}, placed AS (SELECT query_id, top.video_id, coalesce(shot_id, frame_idx) AS shot_id, rank, score FROM top JOIN keyframes k USING (video_id, n) LEFT JOIN shot ON shot.video_id = top.video_id AND k.frame_idx BETWEEN start_frame AND end_frame) SELECT query_id, video_id, shot_id, row_number() OVER (PARTITION BY query_id ORDER BY f) AS rank, round(s, 6) AS score FROM (SELECT query_id, video_id, shot_id, min(rank) AS f, max(score) AS s FROM placed GROUP BY ALL)")
def dense_per_group_best(spark, d):
    return dense.best_per_shot(_dense(spark, d), table(spark, d, "keyframes"), _shots(spark, d), "dense_original").select("query_id", "video_id", "shot_id", "rank", r6("score"))


@query(f"WITH {VECS} SELECT a.video_id, a.n, round({COSINE}, 6) AS similarity FROM vecs a JOIN vecs b ON a.video_id = b.video_id AND b.n = a.n + 1 WHERE list_sum(list_transform(a.embedding, lambda x: abs(x))) > 0 AND list_sum(list_transform(b.embedding, lambda x: abs(x))) > 0")
def neighbour_cosine(spark, d):
    v = vectors_of(spark, d)
    b = v.select("video_id", (F.col("n") - 1).alias("n"), F.col("embedding").alias("next"))
    return v.join(b, ["video_id", "n"]).select("video_id", "n", r6(cosine("embedding", "next"), "similarity")).where("similarity is not null")


@query(f"WITH {VECS}, p AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY n) AS t, count(*) OVER (PARTITION BY video_id) AS size, embedding FROM vecs WHERE list_sum(list_transform(embedding, lambda x: abs(x))) > 0), l AS (SELECT a.video_id, CAST(b.t - a.t AS INTEGER) AS lag, avg({COSINE}) AS s FROM p a JOIN p b ON a.video_id = b.video_id AND b.t - a.t BETWEEN 8 AND a.size // 2 WHERE a.size >= 16 GROUP BY ALL) SELECT video_id, lag, round(s, 6) AS similarity, row_number() OVER (PARTITION BY video_id ORDER BY round(s, 9) DESC, lag) = 1 AS is_period FROM l")
def autocorrelation_by_lag(spark, d):
    """Every lag up to half of the video, the best one marked."""
    good = vectors_of(spark, d).where(F.exists("embedding", lambda x: x != 0))
    return align.all_lags(good).select("video_id", "lag", r6("similarity"), "is_period")


# ---- coverage


def _loci_of(c):
    return c.where("end_frame >= start_frame").select("query_id", "video_id", F.col("rank").alias("locus_id"), "start_frame", "end_frame", F.greatest("fused_score", F.lit(1e-9)).alias("weight"))


def _places(spark, d):
    """What loci and answers need of the candidates."""
    return candidates_of(spark, d).select("query_id", "video_id", "rank", "fused_score", "start_frame", "end_frame", "anchor")


def _loci(spark, d):
    return _loci_of(_places(spark, d))


def _shown_of(c):
    """All answers that a query may show."""
    return c.where((F.col("rank") <= config.MAX_ANSWERS) & F.col("anchor").isNotNull()).select("query_id", "video_id", F.col("anchor").alias("frame")).distinct()


LOCI = f"{GOOD}, loci AS (SELECT qid AS query_id, video_id, rnk AS locus_id, start_frame, end_frame, greatest(fused_score, 1e-9) AS weight FROM cand WHERE end_frame >= start_frame), shown AS (SELECT DISTINCT qid AS query_id, video_id, anchor AS frame FROM cand WHERE rnk <= 100 AND anchor IS NOT NULL)"
# Counted frame by frame, on purpose: another way than the operator's.
KAPPA = f"{LOCI}, cells AS (SELECT query_id, video_id, locus_id, count(DISTINCT cell) AS u FROM (SELECT query_id, video_id, locus_id, unnest(range(greatest(frame - 24, start_frame)::BIGINT, least(frame, end_frame)::BIGINT + 1)) AS cell FROM loci JOIN shown USING (query_id, video_id)) GROUP BY ALL), kap AS (SELECT query_id, video_id, least(1.0, sum(weight * coalesce(u, 0) / (end_frame - start_frame + 1)) / sum(weight)) AS kappa FROM loci LEFT JOIN cells USING (query_id, video_id, locus_id) GROUP BY ALL)"


@query(f"WITH {LOCI} SELECT query_id, video_id, count(DISTINCT cell) AS measure FROM (SELECT query_id, video_id, unnest(range(start_frame::BIGINT, end_frame::BIGINT + 1)) AS cell FROM loci) GROUP BY ALL")
def interval_union_measure(spark, d):
    return coverage.interval_union(_loci(spark, d), ["query_id", "video_id"])


@query(f"WITH {KAPPA} SELECT query_id, video_id, round(kappa, 6) AS kappa FROM kap")
def kappa_coverage(spark, d):
    c = cut(_places(spark, d))
    return coverage.kappa(_loci_of(c), _shown_of(c)).select("query_id", "video_id", r6("kappa"))


@query(f"WITH {KAPPA}, {VSCORES.replace(GOOD + ', ', '')} SELECT query_id, round(least(1.0, sum(coalesce(pi, 0) * coalesce(kappa, 0))), 6) AS probability FROM pi LEFT JOIN kap USING (query_id, video_id) GROUP BY query_id")
def hit_probability(spark, d):
    c = cut(_places(spark, d))
    return coverage.hit_probability(channels.video_scores(c), coverage.kappa(_loci_of(c), _shown_of(c))).select("query_id", r6("probability"))


@query(f"WITH {LOCI} SELECT query_id, locus_id, list_distinct(list_transform(range(1, greatest(1, ceil((end_frame - start_frame + 1) / 25))::BIGINT + 1), lambda i: greatest(0, least(start_frame + i * 25 - 1, end_frame))))[1] AS first_frame, len(list_distinct(list_transform(range(1, greatest(1, ceil((end_frame - start_frame + 1) / 25))::BIGINT + 1), lambda i: greatest(0, least(start_frame + i * 25 - 1, end_frame))))) AS frames FROM (SELECT *  FROM loci)".replace("list_distinct(list_transform(range(1, greatest(1, ceil((end_frame - start_frame + 1) / 25))::BIGINT + 1), lambda i: greatest(0, least(start_frame + i * 25 - 1, end_frame))))[1]", "greatest(0, least(start_frame + 24, end_frame))"))
def covering_frames(spark, d):
    f = coverage.covering_frames(F.col("start_frame"), F.col("end_frame"), 25)
    return _loci(spark, d).select("query_id", "locus_id", F.get(f, F.lit(0)).alias("first_frame"), F.size(f).alias("frames"))


@query(f"WITH {LOCI}, last AS (SELECT video_id, max(frame_idx) AS last_frame FROM keyframes GROUP BY 1) SELECT query_id, locus_id, greatest(0, start_frame - 13) AS lo, greatest(greatest(0, start_frame - 13), least(end_frame + 13, coalesce(last_frame, end_frame + 13))) AS hi FROM loci LEFT JOIN last USING (video_id)")
def expand_clip_locus(spark, d):
    rows = _loci(spark, d).join(fps_of(spark, d).select("video_id", "last_frame"), "video_id", "left")
    lo, hi = coverage.expand_locus(F.col("start_frame"), F.col("end_frame"), 13, F.col("last_frame"))
    return rows.select("query_id", "locus_id", lo.alias("lo"), hi.alias("hi"))


@query(f"WITH {GOOD} SELECT DISTINCT rnk AS rank, round(((rnk <= 1)::INT + (rnk <= 5)::INT + (rnk <= 20)::INT + (rnk <= 50)::INT + (rnk <= 100)::INT) / 5.0, 6) AS weight FROM cand")
def band_weight(spark, d):
    return candidates_of(spark, d).select("rank", r6(scoring.band_weight(F.col("rank")), "weight")).distinct()


# ---- scoring: the truth of a query is taken to be the span of its candidate with the smallest id

TRUTH = f"{GOOD}, truth AS (SELECT qid, video_id AS tv, start_frame AS s, end_frame AS e FROM cand WHERE start_frame IS NOT NULL AND end_frame IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cand_id) = 1), r AS (SELECT qid AS query_id, rnk AS rank, CASE WHEN video_id = tv AND anchor BETWEEN s AND e THEN 1.0 ELSE 0.0 END::DOUBLE AS r, video_id = tv AS same FROM cand JOIN truth USING (qid) WHERE rnk <= 100)"
AT = ", ".join(f"coalesce(max(r) FILTER (rank <= {k}), 0) AS r{k}" for k in config.THRESHOLDS)
SUM5 = " + ".join(f"r{k}" for k in config.THRESHOLDS)


def _truths(spark, d):
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("cand_id"))
    c = candidates_of(spark, d).where("start_frame is not null and end_frame is not null").withColumn("k", first).where("k = 1")
    return c.select("query_id", F.lit("kis").alias("task"), "video_id", F.array(F.struct(F.col("start_frame").alias("s"), F.col("end_frame").alias("e"))).alias("spans"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("array<string>").alias("answer_aliases"))


def _answers(spark, d):
    return candidates_of(spark, d).where("rank <= 100").select("query_id", "rank", "video_id", F.col("anchor").alias("frame"), F.lit(None).cast("array<int>").alias("frames"), F.lit(None).cast("string").alias("answer"))


@query(f"WITH {TRUTH}, a AS (SELECT query_id, {AT}, min(rank) FILTER (r >= 1) AS first_hit, bool_or(same) AS saw, max(r) AS best FROM r GROUP BY query_id) SELECT query_id, {', '.join(f'r{k}' for k in config.THRESHOLDS)}, round(({SUM5}) / 5, 6) AS final, first_hit, coalesce(saw AND best = 0, false) AS right_video_wrong_frame FROM a")
def final_score(spark, d):
    s = scoring.score_submissions(_answers(spark, d), _truths(spark, d))
    return s.select("query_id", *(f"r{k}" for k in config.THRESHOLDS), r6("final"), "first_hit", "right_video_wrong_frame")


@query(f"WITH {TRUTH}, a AS (SELECT query_id, {AT}, min(rank) FILTER (r >= 1) AS first_hit FROM r GROUP BY query_id) SELECT task, count(*) AS queries, round(avg(({SUM5}) / 5), 6) AS final, {', '.join(f'round(avg(r{k}), 6) AS r{k}' for k in config.THRESHOLDS)}, count(*) FILTER (first_hit IS NULL) AS misses FROM (SELECT *, 'kis' AS task FROM a) GROUP BY ROLLUP (task)")
def evaluation_summary(spark, d):
    return scoring.summary(scoring.score_submissions(_answers(spark, d), _truths(spark, d))).drop("wrong_frames")


@query(f"WITH {TRUTH}, f AS (SELECT query_id, min(rank) FILTER (r >= 1) AS rank FROM r GROUP BY 1) SELECT count(*) AS queries, {', '.join(f'round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}' for k in (1, 5, 10, 20, 50))}, quantile_cont(rank, 0.5) AS median_rank, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS found FROM f")
def recall_at_k(spark, d):
    return scoring.recall_at(scoring.score_submissions(_answers(spark, d), _truths(spark, d)).select("query_id", F.col("first_hit").alias("rank")))


@query("WITH m AS (SELECT query_id, video_id, list(frame ORDER BY frame, frame_key) AS frames, list(struct_pack(s := start_frame, e := end_frame) ORDER BY frame, frame_key) AS spans FROM (SELECT DISTINCT frame_key, query_id, video_id, frame, start_frame, end_frame FROM review_frames WHERE query_id IS NOT NULL AND video_id IS NOT NULL) GROUP BY ALL) SELECT query_id, video_id, round(list_sum(list_transform(range(1, len(frames) + 1), lambda i: CASE WHEN frames[i] + 40 BETWEEN spans[i].s AND spans[i].e THEN 1.0 ELSE 0.0 END)) / len(frames), 6) AS r FROM m")
def r_score_trake(spark, d):
    rows = table(spark, d, "review_frames").where("query_id is not null and video_id is not null").select("frame_key", "query_id", "video_id", "frame", "start_frame", "end_frame").distinct()
    m = rows.groupBy("query_id", "video_id").agg(F.array_sort(F.collect_list(F.struct("frame", "frame_key", "start_frame", "end_frame"))).alias("x"))
    frames, spans = F.transform("x", lambda x: x["frame"] + 40), F.transform("x", lambda x: F.struct(x["start_frame"].alias("s"), x["end_frame"].alias("e")))
    return m.select("query_id", "video_id", r6(scoring.r_trake(frames, spans, F.lit(True)), "r"))


QUANT = "|".join(scoring.QUANTIFIERS)


def plain_answer_sql(x):
    return f"trim(regexp_replace(regexp_replace(trim(lower(nfc_normalize(coalesce({x}, '')))), '[.,;:!?\"''()\\[\\]{{}}]', ' ', 'g'), '[\\t-\\r ]+', ' ', 'g'))"


@query(f"SELECT query_no, {plain_answer_sql('any_value(english)')} = {plain_answer_sql('any_value(raw)')} AS same, {plain_answer_sql('any_value(question)')} AS plain FROM queries WHERE query_no IS NOT NULL GROUP BY query_no")
def answer_plain_forms(spark, d):
    q = queries_of(spark, d)
    return q.select("query_no", (scoring.plain_answer(F.col("english")) == scoring.plain_answer(F.col("raw"))).alias("same"), scoring.plain_answer(F.col("question")).alias("plain"))


# Every part name and brand is an answer: as it is, in another spelling, as a number with words around it, or by an alias.
def number_sql(x):
    bare = f"trim(regexp_replace({plain_answer_sql(x)}, '(^|[^\\pL\\pN_])({QUANT})($|[^\\pL\\pN_])', ' ', 'g'))"
    words = " ".join(f"WHEN '{w}' THEN {n}.0" for w, n in scoring.NUMBER_WORDS.items())
    return f"CASE WHEN regexp_full_match(replace({bare}, ' ', ''), '-?[0-9]+([.,][0-9]+)?') THEN CAST(replace(replace({bare}, ' ', ''), ',', '.') AS DOUBLE) ELSE CASE {bare} {words} END END"


def tier_sql(got, want, aliases):
    each = f"list_filter(list_transform({aliases}, lambda a: CASE WHEN {plain_answer_sql('a')} = {plain_answer_sql(got)} THEN 'alias' WHEN ({number_sql('a')}) = ({number_sql(got)}) THEN 'alias-numeric' END), lambda t: t IS NOT NULL)"
    return f"CASE WHEN {plain_answer_sql(got)} = {plain_answer_sql(want)} THEN 'exact' WHEN ({number_sql(got)}) = ({number_sql(want)}) THEN 'numeric' ELSE coalesce(({each})[1], 'none') END"


_ANSWERS = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'khoảng ' || p_size || ' cái' WHEN 2 THEN upper(p_type) || '.' WHEN 3 THEN p_size % 12 || '' ELSE p_brand END AS got, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_size || '!' ELSE p_type END AS want, ['mười', p_type, p_size || ' người', p_brand] AS aliases FROM part"


@query(f"SELECT p_partkey, {tier_sql('got', 'want', 'aliases')} AS tier FROM ({_ANSWERS})")
def answer_match_tiers(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size").cast("string")
    kind, other = F.col("p_partkey") % 5, F.col("p_partkey") % 3
    got = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.concat(F.lit("khoảng "), size, F.lit(" cái"))).when(kind == 2, F.concat(F.upper("p_type"), F.lit("."))).when(kind == 3, (F.col("p_size") % 12).cast("string")).otherwise(F.col("p_brand"))
    want = F.when(other == 0, F.upper("p_name")).when(other == 1, F.concat(size, F.lit("!"))).otherwise(F.col("p_type"))
    aliases = F.array(F.lit("mười"), F.col("p_type"), F.concat(size, F.lit(" người")), F.col("p_brand"))
    return scoring.tiers(p.select("p_partkey", got.alias("got"), want.alias("want"), aliases.alias("aliases")), ["p_partkey"], "got", "want", "aliases")


@query(f"WITH {GOOD}, sub AS (SELECT qid, rnk, video_id, anchor, last_frame FROM cand LEFT JOIN (SELECT video_id, max(frame_idx) AS last_frame FROM keyframes GROUP BY 1) USING (video_id) WHERE rnk <= 100), dup AS (SELECT *, row_number() OVER (PARTITION BY qid, video_id, anchor ORDER BY rnk) AS copy FROM sub) SELECT rule, severity, count(*) AS n FROM (SELECT 'malformed video_id' AS rule, 'error' AS severity FROM sub WHERE NOT regexp_full_match(video_id, 'L[0-9]+_V[0-9]+') UNION ALL SELECT 'negative frame', 'error' FROM sub WHERE anchor < 0 UNION ALL SELECT 'exact duplicate', 'error' FROM dup WHERE copy > 1 UNION ALL SELECT 'past the last frame', 'warning' FROM sub WHERE anchor > last_frame UNION ALL SELECT 'free slots', 'warning' FROM (SELECT qid FROM sub GROUP BY qid HAVING count(*) < 100)) GROUP BY ALL")
def submission_issues(spark, d):
    answers = _answers(spark, d).withColumn("task", F.lit("kis")).withColumn("n_moments", F.lit(None).cast("int"))
    return scoring.issues(answers, None, fps_of(spark, d)).groupBy("rule", "severity").agg(F.count("*").alias("n"))


# ---- windows for ordered moments


def _moments(spark, d):
    """Two moments of every video: similarity of its keyframes to its first and to its last keyframe's vector."""
    v = vectors_of(spark, d).where(F.exists("embedding", lambda x: x != 0))
    ends = v.groupBy("video_id").agg(F.min_by("embedding", "n").alias("first"), F.max_by("embedding", "n").alias("last"))
    rows = v.join(ends, "video_id").join(table(spark, d, "keyframes").where("frame_idx is not null").select("video_id", "n", F.col("frame_idx").alias("frame")), ["video_id", "n"])
    return rows.select(F.lit("q").alias("query_id"), "video_id", "n", "frame", F.array(F.round(cosine("embedding", "first"), 9), F.round(cosine("embedding", "last"), 9)).alias("sims"), "embedding")


def cos_sql(a, b):
    return f"round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / ({NORM.format(a)} * {NORM.format(b)}), 9)"


MOMENTS = f"{VECS}, good AS (SELECT * FROM vecs WHERE list_sum(list_transform(embedding, lambda x: abs(x))) > 0), ends AS (SELECT video_id, arg_min(embedding, n) AS f, arg_max(embedding, n) AS l FROM good GROUP BY 1), sims AS (SELECT video_id, n, frame_idx AS frame, {cos_sql('embedding', 'f')} AS a, {cos_sql('embedding', 'l')} AS b FROM good JOIN ends USING (video_id) JOIN keyframes USING (video_id, n) WHERE frame_idx IS NOT NULL)"


@query(f"WITH {MOMENTS}, t AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame, n) AS t FROM sims) SELECT x.video_id, round(max(x.a + y.b), 6) AS total FROM t x JOIN t y ON x.video_id = y.video_id AND x.t < y.t GROUP BY x.video_id")
def dp_prefix_max_2step(spark, d):
    w = Window.partitionBy("video_id").orderBy("frame", "n").rowsBetween(Window.unboundedPreceding, -1)
    rows = _moments(spark, d).withColumn("before", F.max(F.col("sims")[0]).over(w))
    return rows.where("before is not null").groupBy("video_id").agg(r6(F.max(F.col("before") + F.col("sims")[1]), "total"))


@query(f"WITH {MOMENTS} SELECT video_id, n, round(exp((a - max(a) OVER w) / 0.05) / sum(exp((a - mx) / 0.05)) OVER w, 6) AS confidence FROM (SELECT *, max(a) OVER (PARTITION BY video_id) AS mx FROM sims) WINDOW w AS (PARTITION BY video_id)")
def softmax_confidence(spark, d):
    rows = _moments(spark, d).select("video_id", "n", F.col("sims")[0].alias("score"))
    return align.softmax_confidence(rows, ["video_id"]).select("video_id", "n", r6("confidence"))


@query(f"WITH {MOMENTS}, c AS (SELECT x.video_id, x.n, 0.85 * (max(y.a) + max(y.b)) / 2 + 0.15 * max(y.a) AS centre, arg_max(y.frame, struct_pack(s := y.a, f := -y.frame)) AS anchor FROM sims x JOIN sims y ON x.video_id = y.video_id AND y.frame BETWEEN x.frame - 225 AND x.frame + 225 GROUP BY x.video_id, x.n) SELECT video_id, n, round(centre, 6) AS centre, anchor FROM c")
def band_neighbourhood_max(spark, d):
    rows = _moments(spark, d).withColumn("full", F.col("sims")[0])
    return align.neighbourhood(rows, 2).select("video_id", "n", r6("centre"), "anchor")


# ---- review, pins, samples


@query(f"WITH {GOOD}, v AS (SELECT qid, video_id, min(rnk) AS best FROM cand GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best) AS position FROM v), k AS (SELECT cand.qid AS query_id, cand_id, position, row_number() OVER (PARTITION BY cand.qid, cand.video_id ORDER BY rnk) AS k FROM p JOIN cand ON cand.qid = p.qid AND cand.video_id = p.video_id) SELECT query_id, cand_id, row_number() OVER (PARTITION BY query_id ORDER BY k, position) AS scan FROM k WHERE position <= 60 AND k <= 4")
def review_scan_order(spark, d):
    c = candidates_of(spark, d)
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("best"))
    v = c.groupBy("query_id", "video_id").agg(F.min("rank").alias("best")).withColumn("position", position).where("position <= 60")
    k = F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy("rank"))
    return review.scan_order(c.join(v, ["query_id", "video_id"]).withColumn("k", k).where("k <= 4")).select("query_id", "cand_id", "scan")


@query(f"WITH {GOOD}, tail AS (SELECT qid AS query_id, 1 AS part, rnk AS pos, video_id, anchor AS frame, 1.0 / (pos + 40.0) AS gain FROM (SELECT *, rnk AS pos FROM cand) WHERE rnk <= 100), pins AS (SELECT query_id, 0 AS part, pos, video_id, frame, 0.0 AS gain FROM tail WHERE pos IN (7, 9)), kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame ORDER BY part, pos) AS copy FROM (SELECT * FROM pins UNION ALL SELECT * FROM tail)) SELECT query_id, video_id, frame, row_number() OVER (PARTITION BY query_id ORDER BY part, pos) AS rank, CASE WHEN part = 0 THEN 'pinned' ELSE 'greedy' END AS source, round(least(1.0, sum(gain) OVER (PARTITION BY query_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)), 6) AS cumulative FROM kept WHERE copy = 1 QUALIFY rank <= 100")
def pins_merge(spark, d):
    rows = _answers(spark, d).withColumn("gain", 1.0 / (F.col("rank") + 40.0)).withColumn("source", F.lit("greedy"))
    pins = rows.where("rank in (7, 9)").select("query_id", F.col("rank").alias("pos"), "video_id", "frame")
    return coverage.apply_pins(rows, pins).select("query_id", "video_id", "frame", "rank", "source", r6("cumulative"))


@query("WITH h AS (SELECT split_part(video_id, '_', 1) AS grp, sum(s) / 3600.0 AS hours FROM (SELECT video_id, max(pts_time) AS s FROM keyframes WHERE pts_time IS NOT NULL GROUP BY 1) GROUP BY 1), n AS (SELECT grp, hours, CAST(round_even(100 * hours / sum(hours) OVER (), 0) AS BIGINT) AS n FROM h) SELECT grp, round(hours, 6) AS hours, greatest(0, CASE WHEN lead(grp) OVER w IS NULL THEN 100 - coalesce(sum(n) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE n END) AS share FROM n WINDOW w AS (ORDER BY grp)")
def stratified_shares(spark, d):
    hours = cut(devset.group_hours(table(spark, d, "keyframes")))
    return devset.allotment(hours, 100).join(hours, "grp").select("grp", r6("hours"), F.col("n").alias("share"))


# ---- generic joins, sets and aggregates


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def grouped_sums(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), r6(F.avg("l_discount"), "discount"))


@query("SELECT c_custkey, coalesce(n, 0) AS orders, round(coalesce(total, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_lookup_default(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    return table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49) AS big FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A' AND l_quantity < 2)")
def semi_and_anti_joins(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity", "l_returnflag")
    p = table(spark, d, "part").select("p_partkey").join(l.where("l_returnflag = 'A' and l_quantity < 2"), "p_partkey", "left_anti")
    big = l.where("l_quantity >= 49").select("p_partkey").distinct().withColumn("big", F.lit(True))
    return p.join(big, "p_partkey", "left").select("p_partkey", F.coalesce("big", F.lit(False)).alias("big"))


@query("(SELECT video_id, 'missing vector' AS what FROM keyframes EXCEPT SELECT video_id, 'missing vector' FROM vectors) UNION ALL (SELECT video_id, 'both' FROM keyframes INTERSECT SELECT video_id, 'both' FROM media_info)")
def set_operations(spark, d):
    k, v, m = (table(spark, d, t).select("video_id") for t in ("keyframes", "vectors", "media_info"))
    return k.subtract(v).withColumn("what", F.lit("missing vector")).unionByName(k.intersect(m).withColumn("what", F.lit("both")))


@query("SELECT user_id, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY user_id")
def json_props(spark, d):
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


# ---- steps that SQL cannot express: rows are checked against brute force in the tests


@query()
def parse_queries(spark, d):
    return parse.parse_queries(queries_of(spark, d).select("query_id", "raw"))


def _clustered(spark, d):
    places = candidates_of(spark, d).select("query_id", "cand_id", "video_id", "rank", "fused_score", "start_frame", "end_frame", "anchor")
    near = shots.nearest_keyframes(cut(channels.cap_per_video(places)), table(spark, d, "keyframes"), "anchor")
    v = vectors_of(spark, d).withColumnRenamed("n", "nearest_n")
    return channels.leader_clusters(near.join(v, ["video_id", "nearest_n"], "left"))


def _beliefs(spark, d):
    c = cut(_clustered(spark, d).drop("embedding"))  # used by loci, beliefs and pool
    return cut(coverage.build_loci(c, fps_of(spark, d))), cut(channels.video_scores(c))


@query()
def allocate_kis(spark, d):
    loci, beliefs = _beliefs(spark, d)
    return coverage.allocate(coverage.frame_pool(loci, beliefs), loci, beliefs)


@query()
def allocate_qa(spark, d):
    loci, beliefs = _beliefs(spark, d)
    answers = spark.createDataFrame([(t, p) for t, p in parse.hedge_numeric(5)], "answer string, prob double")
    return coverage.allocate(coverage.frame_pool(loci, beliefs, least=1), loci, beliefs, answers=answers)


def _aligned(spark, d):
    return align.align_windows(_moments(spark, d).withColumnRenamed("embedding", "v"))


@query()
def alternative_paths(spark, d):
    return _aligned(spark, d).select("video_id", "frames", r6("score"), r6("confidence"))


@query()
def allocate_trake(spark, d):
    paths = cut(_aligned(spark, d))  # beliefs come from them too
    beliefs = paths.groupBy("query_id", "video_id").agg(F.max("score").alias("pi"))
    none = spark.createDataFrame([], "query_id string, video_id string, lo array<int>, hi array<int>")
    return coverage.allocate_moments(paths.drop("confidence"), beliefs, none)


@query()
def review_shortlist(spark, d):
    c, fps = cut(candidates_of(spark, d).select("query_id", "video_id", "rank", "fused_score", "start_frame", "end_frame", "anchor", "ranks")), fps_of(spark, d)
    ranks = channels.video_hits(hits_of(spark, d, by_query=True)).select("query_id", "channel", "video_id", "rank")
    videos = review.select_videos(channels.video_scores(c).select("query_id", "video_id", F.col("raw").alias("score")), ranks)
    videos = cut(videos)  # only their candidates are laid out
    shown = c.join(videos.select("query_id", "video_id"), ["query_id", "video_id"], "left_semi")
    return review.scan_order(review.review_frames(videos, review.probes(shown, fps), fps))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
