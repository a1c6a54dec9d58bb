"""Queries of the operators for training data, and the SQL that says the same."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sightline.llm import leakage, lookalikes, mixing, quality, rank_fusion, repeated_lines, similarity_clusters, term_weight, top_n
from sightline.llm.textform import form_column, words_of_form
from sightline.operators.versions import latest
from sightline.session import table

# ---- 1: lines repeated within a site


def p1_found(spark, d):
    return repeated_lines.repeated_lines(table(spark, d, "docs")).select("doc_id", "line_no")


def p1_clean(spark, d):
    return repeated_lines.without_repeated_lines(table(spark, d, "docs"))


# ---- 2: clusters of similar vectors, named by their smallest key


def _frame_clusters(spark, d):
    return similarity_clusters.frame_clusters(table(spark, d, "review_frames"), table(spark, d, "vectors"))


def p2_found(spark, d):
    return similarity_clusters.with_leads(_frame_clusters(spark, d))


def _described(found, key):
    members = found.groupBy(key, "pivot").agg(F.max("closeness").alias("closeness")).withColumnRenamed(key, "id")
    of = members.groupBy("pivot").agg(F.count("*").alias("size"), F.min("id").alias("cluster_id"))
    told = similarity_clusters.describe(members.join(of.select("pivot", "size"), "pivot"))
    return told.join(of.select("pivot", "cluster_id"), "pivot").select("cluster_id", "size", "typical")


def p2_describe(spark, d):
    return _described(_frame_clusters(spark, d), "frame_key")


def _shot_clusters(spark, d):
    rows = table(spark, d, "candidates").select("cand_id", "video_id", "start_frame", "end_frame", "anchor", "ingested_at")
    return similarity_clusters.shot_clusters(latest(rows, "cand_id", "ingested_at"), table(spark, d, "keyframes"), table(spark, d, "vectors"))


def p2_shots(spark, d):
    found = _shot_clusters(spark, d)
    return found.join(found.groupBy("pivot").agg(F.min("cand_id").alias("cluster_id")), "pivot").select("cand_id", "cluster_id")


def p2_describe_shots(spark, d):
    return _described(_shot_clusters(spark, d), "cand_id")


# ---- 3: one ranking of several scores


def _fused(spark, d):
    rows = table(spark, d, "candidates").select("query_no", "cand_id", "raw", "ingested_at")
    return rank_fusion.fuse_maps(rows, "query_no", "cand_id", "raw", prepare=lambda x: latest(x, "cand_id", "ingested_at"))


def p3_found(spark, d):
    return rank_fusion.heads(_fused(spark, d), "query_no", "cand_id")


def p3_scores(spark, d):
    return _fused(spark, d).select("query_no", "cand_id", F.round("fused_score", 9).alias("fused_score"))


# ---- 4: look-alike texts


def _lookalikes(spark, d):
    docs = lookalikes.consistent(table(spark, d, "docs"), "doc_id", "text", "doc")
    return docs.unionByName(lookalikes.consistent(table(spark, d, "queries"), "query_no", "raw", "query"))


def p4_found(spark, d):
    return lookalikes.lookalike_pairs(lookalikes.keyed(_lookalikes(spark, d)))


def p4_classes(spark, d):
    return lookalikes.lookalike_classes(lookalikes.keyed(_lookalikes(spark, d)))


def p4_consistent(spark, d):
    return _lookalikes(spark, d).select("record_kind", "record_key", "form").distinct()


# ---- 5: distinctive terms


def _collection(spark, d):
    # In consistent form first: after the exchange a Python step would hide that documents are together by doc_id.
    formed = table(spark, d, "docs").select("doc_id", form_column(F.col("text")).alias("form"))
    docs = latest(formed, "doc_id").select("doc_id", words_of_form(F.col("form")).alias("terms"))
    return term_weight.Collection.of(term_weight.count_terms(docs, "doc_id", "terms"))


def _keyword_counts(spark, d):
    formed = table(spark, d, "queries").select("query_no", form_column(F.array_join("keywords", "\n")).alias("form"))
    words = latest(formed, "query_no").select("query_no", words_of_form(F.col("form")).alias("terms"))
    return term_weight.count_terms(words, "query_no", "terms")


def p5_scores(spark, d):
    docs = _collection(spark, d)
    both = docs.score(docs.counts).withColumn("record_kind", F.lit("doc")).unionByName(docs.score(_keyword_counts(spark, d)).withColumn("record_kind", F.lit("query")))
    # Six digits by plain arithmetic: round() takes decimals, which costs more than all the rest of a row.
    return both.select("record_kind", "record_key", "term", "joint", "df", (F.floor(F.col("ppmi") * 1e6 + 0.5) / 1e6).alias("ppmi"))


def p5_found(spark, d):
    """The scored terms whose counts make them a case: the statement asks for counts, not for a least score."""
    rare = (F.col("df") >= 1) & (F.col("df") <= 4)
    enough = (F.col("record_kind") == "query") | (F.col("joint") >= 4)
    return p5_scores(spark, d).where(rare & enough).select("record_kind", "record_key", "term")


# ---- 6: top items of every group


def p6_found(spark, d):
    rows = table(spark, d, "candidates").select("video_id", "cand_id", "fused_score", "ingested_at")
    return top_n.top_n(latest(rows, "cand_id", "ingested_at"), "video_id", "fused_score", "cand_id", 12).select("video_id", "cand_id")


# ---- 7: leaked items


def p7_found(spark, d):
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_summary(spark, d):
    return leakage.leaked_summary(p7_found(spark, d))


def p7_overlap(spark, d):
    return leakage.overlaps(table(spark, d, "documents"), table(spark, d, "eval_items"))


# ---- 8: mixing sources

#: Vocabulary of the public tokenizer that the test queries count with, unless the environment names another.
TOKENIZER = os.environ.get(mixing.TOKENIZER_VARIABLE, "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p8_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer=TOKENIZER)


def p8_shares(spark, d):
    return mixing.reached(p8_mix(spark, d), table(spark, d, "mix_targets"))


# ---- 9: prose or not


def p9_found(spark, d):
    return quality.not_prose(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "doc_labels")).select("doc_id")


def p9_statistics(spark, d):
    s = quality.statistics(table(spark, d, "documents"))
    return s.select("doc_id", "words", *(F.round(c, 6).alias(c) for c in quality.STATISTICS[1:]))


def p9_calibration(spark, d):
    model = quality.ProseModel.fit(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "doc_labels"))
    if model is None:
        return spark.createDataFrame([], "bin int, documents long, predicted double, observed double")
    return model.calibration()


def queries():
    made = (
        p1_found, p1_clean, p2_found, p2_describe, p2_shots, p2_describe_shots, p3_found, p3_scores, p4_found, p4_classes, p4_consistent, p5_found, p5_scores,
        p6_found, p7_found, p7_summary, p7_overlap, p8_mix, p8_shares, p9_found, p9_statistics, p9_calibration,
    )
    return {f.__name__: f for f in made}


# ---- SQL.  The consistent form is said in another way than the operators say it: by the characters of these tables alone.

# Letters of other scripts in the test tables and the Latin letters they look like.
_CYRILLIC = "АВЕЅІЈКМНОРСТУХ" + "аеѕіјорсухһ", "ABESIJKMHOPCTYX" + "aesijopcyxh"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "αγινορυ", "ABEZHIKMNOPTYX" + "ayivopu"
_STROKE = "ÐƉ", "ĐĐ"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
_FROM, _TO = ("".join(x).replace("'", "''") for x in zip(_CYRILLIC, _GREEK, _STROKE, _WIDE, strict=True))


def form_sql(x):
    shown = f"regexp_replace(replace({x}, '…', '...'), '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}]', '', 'g')"
    return f"nfc_normalize(translate(regexp_replace({shown}, '[\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g'), '{_FROM}', '{_TO}'))"


def words_sql(x):
    return f"regexp_extract_all(lower({form_sql(x)}), '[\\pL\\p{{Nd}}]+')"


def _quoted(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + "]"


_DOCS = "one AS (SELECT doc_id, any_value(video_id) AS video_id, any_value(text) AS text FROM docs WHERE doc_id IS NOT NULL GROUP BY doc_id)"
_LINES = f"lines AS (SELECT doc_id, split_part(video_id, '_', 1) AS site, unnest(string_split(f, chr(10))) AS line, generate_subscripts(string_split(f, chr(10)), 1) AS line_no FROM (SELECT doc_id, video_id, {form_sql('text')} AS f FROM one WHERE video_id IS NOT NULL))"
_GONE = f"WITH {_DOCS}, {_LINES}, keyed AS (SELECT doc_id, site, line_no, regexp_replace(lower(line), '[^\\pL]+', '', 'g') AS letters FROM lines), many AS (SELECT site, letters FROM keyed WHERE letters <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 8), gone AS (SELECT doc_id, line_no FROM keyed JOIN many USING (site, letters))"

_UNIT = "list_transform(v, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(v, lambda y: y::DOUBLE * y::DOUBLE))))"
_VECTORS = f"vec AS (SELECT video_id, n, {_UNIT} AS u FROM (SELECT video_id, n, max(embedding) AS v FROM vectors WHERE embedding IS NOT NULL GROUP BY ALL) WHERE list_sum(list_transform(v, lambda x: abs(x))) > 0)"


def _clusters_sql(records: str) -> str:
    """``records`` gives (key, video_id, n); a pair of one cluster has a cosine of .92, so the smallest similar key names it."""
    return f"""WITH {_VECTORS}, r AS ({records}), k AS (SELECT video_id, n, min(key) AS id, any_value(u) AS u FROM r JOIN vec USING (video_id, n) GROUP BY ALL),
        led AS (SELECT a.video_id, a.n, any_value(a.u) AS u, min(b.id) AS lead FROM k a JOIN k b ON list_dot_product(a.u, b.u) >= 0.92 GROUP BY a.video_id, a.n),
        found AS (SELECT key, lead, video_id, n, u FROM r JOIN led USING (video_id, n))"""


_TYPICAL = """, sums AS (SELECT lead, pos, sum(x) AS x FROM (SELECT lead, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM led) GROUP BY ALL), mean AS (SELECT lead, list(x ORDER BY pos) AS m FROM sums GROUP BY lead),
    told AS (SELECT lead, key, round(list_dot_product(u, m) / sqrt(list_sum(list_transform(m, lambda x: x * x))), 9) AS c FROM found JOIN mean USING (lead)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lead ORDER BY c DESC, key) AS k, count(*) OVER (PARTITION BY lead) AS size FROM told)
    SELECT lead AS cluster_id, any_value(size) AS size, list(key ORDER BY k) FILTER (k <= 3) AS typical FROM placed GROUP BY lead"""
_FRAMES = _clusters_sql("SELECT DISTINCT frame_key AS key, video_id, n FROM review_frames WHERE frame_key IS NOT NULL")
_SHOTS = _clusters_sql("""SELECT cand_id AS key, video_id, arg_min(kf.n, abs(f - frame_idx)::BIGINT * 10000000 + frame_idx) AS n
    FROM (SELECT cand_id, video_id, coalesce(anchor, (start_frame + end_frame) // 2) AS f FROM candidates WHERE cand_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY ingested_at DESC NULLS LAST) = 1)
    JOIN (SELECT video_id, frame_idx, min(n) AS n FROM keyframes WHERE frame_idx IS NOT NULL GROUP BY ALL) kf USING (video_id) WHERE f IS NOT NULL GROUP BY ALL""")  # fmt: skip

# The channels of candidates.raw.
CHANNELS = ["dense_localized", "dense_multilingual", "entity_fuzzy", "objects", "sparse_text", "sparse_title"]
_LATEST = "latest AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY ingested_at DESC) = 1)"
_SCORES = ", ".join(f"CASE WHEN isnan(raw['{c}']) THEN NULL ELSE raw['{c}'] END AS s{k}" for k, c in enumerate(CHANNELS))
_RANKS = ", ".join(f"CASE WHEN s{k} IS NULL THEN 0.0 ELSE 1.0::DOUBLE / (60.0::DOUBLE + rank() OVER (PARTITION BY query_no ORDER BY s{k} DESC NULLS LAST)) END AS r{k}" for k in range(len(CHANNELS)))
_TOTAL = " + ".join(f"r{k}" for k in range(len(CHANNELS)))
_FUSED = f"WITH {_LATEST}, scores AS (SELECT query_no, cand_id, {_SCORES} FROM latest WHERE query_no IS NOT NULL), ranks AS (SELECT query_no, cand_id, {_RANKS} FROM scores), fused AS (SELECT query_no, cand_id, {_TOTAL} AS fused_score FROM ranks)"

_FORMS = f"records AS (SELECT 'doc' AS record_kind, doc_id AS record_key, text, {form_sql('text')} AS form FROM docs UNION SELECT 'query', query_no, raw, {form_sql('raw')} FROM queries)"
_SEEN = f"WITH {_FORMS}, seen AS (SELECT * FROM records WHERE text <> '' AND record_key IS NOT NULL)"

_COUNTS = f"""WITH {_DOCS}, terms AS (SELECT doc_id AS record_key, {words_sql('text')} AS ts FROM one), asked AS (SELECT query_no AS record_key, {words_sql("array_to_string(ks, chr(10))")} AS ts FROM (SELECT query_no, any_value(keywords) AS ks FROM queries WHERE query_no IS NOT NULL GROUP BY query_no)),
    counts AS (SELECT record_key, len(ts) AS size, term, count(*) AS joint FROM (SELECT record_key, ts, unnest(ts) AS term FROM terms) GROUP BY record_key, len(ts), term),
    qcounts AS (SELECT record_key, len(ts) AS size, term, count(*) AS joint FROM (SELECT record_key, ts, unnest(ts) AS term FROM asked) GROUP BY record_key, len(ts), term),
    marginal AS (SELECT term, sum(joint) AS total, count(*) AS df FROM counts GROUP BY term), smooth AS (SELECT sum(pow(len(ts), 0.75)) AS s FROM terms WHERE len(ts) > 0),
    scored AS (SELECT record_kind, record_key, term, joint, coalesce(df, 0) AS df, round(greatest(0.0, ln(joint * s / (coalesce(total, joint) * pow(size, 0.75)))), 6) AS ppmi
        FROM (SELECT 'doc' AS record_kind, * FROM counts UNION ALL SELECT 'query', * FROM qcounts) LEFT JOIN marginal USING (term), smooth)"""

_GRAMS = "SELECT {key}, array_to_string(w[i:i + 11], ' ') AS g, i FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM {of})"
_LEAKS = f"WITH dw AS (SELECT doc_id, {words_sql('text')} AS w FROM documents WHERE text IS NOT NULL), iw AS (SELECT item_id, {words_sql('text')} AS w, text FROM eval_items WHERE text IS NOT NULL), dg AS ({_GRAMS.format(key='doc_id', of='dw')}), ig AS ({_GRAMS.format(key='item_id', of='iw')}), hits AS (SELECT DISTINCT doc_id, item_id, ig.i FROM dg JOIN ig USING (g))"
_OVERLAP = f"""{_LEAKS}, places AS (SELECT DISTINCT doc_id, item_id, unnest(range(i, i + 12)) AS place FROM hits), sizes AS (SELECT item_id, len(w) AS item_words, len({words_sql("regexp_extract(text, '(?s)^(.*?)[^.!;\\n?]*\\?[^?]*$', 1)")}) AS first, len({words_sql("regexp_extract(text, '(?s)([^.!;\\n?]*)\\?[^?]*$', 1)")}) AS question_words FROM iw)
    SELECT doc_id, item_id, item_words, count(*) AS shared_words, question_words, count(*) FILTER (place > first AND place <= first + question_words AND question_words > 0) AS shared_question FROM places JOIN sizes USING (item_id) GROUP BY doc_id, item_id, item_words, question_words"""


def _statistics_sql():
    lines = "list_filter(string_split(f, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r]'))"
    words = "list_filter(regexp_split_to_array(lower(f), '[ \\t\\n\\r]+'), lambda w: w <> '')"
    return f"""WITH f AS (SELECT doc_id, {form_sql("coalesce(text, '')")} AS f FROM documents WHERE doc_id IS NOT NULL), m AS (SELECT doc_id, f, {words} AS ws, {lines} AS ls FROM f)
        SELECT doc_id, len(ws) AS words, CASE WHEN len(ws) = 0 THEN 0 ELSE round(list_sum(list_transform(ws, lambda w: length(w))) / len(ws), 6) END AS mean_word_length,
        CASE WHEN len(ws) = 0 THEN 0 ELSE round(len(regexp_extract_all(f, '[^\\pL\\pN \\t\\n\\r]')) / length(f), 6) END AS symbol_share,
        CASE WHEN len(ws) = 0 THEN 0 ELSE round(len(list_filter(ls, lambda x: regexp_matches(x, '[.!?…]["”»)\\]'' \\t\\r]*$'))) / len(ls), 6) END AS punctuated_line_share,
        CASE WHEN len(ws) = 0 THEN 0 ELSE round(len(list_filter(ws, lambda w: list_contains({_quoted(quality.common_words())}, w))) / len(ws), 6) END AS common_word_share FROM m"""


def oracle_sql():
    return {
        "p1_found": f"{_GONE} SELECT doc_id, line_no FROM gone",
        "p1_clean": f"{_GONE}, raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM one), kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM raw WHERE (doc_id, line_no) NOT IN (SELECT doc_id, line_no FROM gone) GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS removed FROM gone GROUP BY doc_id) SELECT doc_id, video_id, CASE WHEN one.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(removed, 0) AS removed FROM one LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)",
        "p2_found": f"{_FRAMES} SELECT key AS frame_key, lead AS lead_key FROM found QUALIFY count(*) OVER (PARTITION BY lead) > 1",
        "p2_describe": f"{_FRAMES}{_TYPICAL}",
        "p2_shots": f"{_SHOTS} SELECT key AS cand_id, lead AS cluster_id FROM found",
        "p2_describe_shots": f"{_SHOTS}{_TYPICAL}",
        "p3_found": f"{_FUSED} SELECT query_no, cand_id FROM fused QUALIFY row_number() OVER (PARTITION BY query_no ORDER BY fused_score DESC, cand_id) = 1",
        "p3_scores": f"{_FUSED} SELECT query_no, cand_id, round(fused_score, 9) AS fused_score FROM fused",
        "p4_found": f"{_SEEN} SELECT a.record_kind, a.record_key AS key_a, b.record_key AS key_b FROM seen a JOIN seen b ON a.record_kind = b.record_kind AND a.form = b.form AND a.record_key < b.record_key AND a.text <> b.text",
        "p4_classes": f"{_SEEN} SELECT a.record_kind, a.record_key, least(a.record_key, min(b.record_key), any_value(c.m)) AS class_key, count(*) AS links FROM seen a JOIN seen b ON a.record_kind = b.record_kind AND a.form = b.form AND a.text <> b.text JOIN (SELECT record_kind, form, min(record_key) AS m FROM seen GROUP BY ALL) c ON c.record_kind = a.record_kind AND c.form = a.form GROUP BY a.record_kind, a.record_key",
        "p4_consistent": f"WITH {_FORMS} SELECT DISTINCT record_kind, record_key, form FROM records",
        "p5_scores": f"{_COUNTS} SELECT * FROM scored",
        "p5_found": f"{_COUNTS} SELECT record_kind, record_key, term FROM scored WHERE df BETWEEN 1 AND 4 AND (record_kind = 'query' OR joint >= 4)",
        "p6_found": f"WITH {_LATEST} SELECT video_id, cand_id FROM latest WHERE video_id IS NOT NULL AND fused_score IS NOT NULL AND NOT isnan(fused_score) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY fused_score DESC, cand_id) <= 12",
        "p7_found": f"{_LEAKS} SELECT DISTINCT doc_id, item_id FROM hits",
        "p7_summary": f"{_LEAKS} SELECT item_id, count(DISTINCT doc_id) AS documents FROM hits GROUP BY item_id",
        "p7_overlap": _OVERLAP,
        "p9_statistics": _statistics_sql(),
    }
