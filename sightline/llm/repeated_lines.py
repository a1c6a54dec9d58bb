"""Lines repeated across one site's documents.

Each line of a site has a bitmap of the documents that hold it, kept as its
non-zero 64-document words.  Variants of a line (spacing, digits, punctuation,
case, look-alike characters) share a key, so their bitmaps are united; the bits
set give the exact number of documents, and a line is deleted where its
document's bit is set in the bitmap of a line above the threshold.

Two lines are the same if their letters are, in consistent form and lower case.
Lines without a letter are never repeated lines.  Null and empty texts have no
lines and come out as they are; documents without a video_id have no site and
keep all lines; a document delivered more than once counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.textform import form_column
from sightline.operators.versions import latest
from sightline.session import cut

LEAST_DOCUMENTS = 8


def site_of(video_id: Column) -> Column:
    return F.substring_index(video_id, "_", 1)


def lines_of(docs: DataFrame) -> DataFrame:
    """(key, check, word, bit, doc_id, line_no) of every line that has a letter.

    key and check are 96 bits of hash over the site and the line's letters; word and
    bit place the document in a bitmap.
    """
    letters = F.regexp_replace(F.lower(form_column(F.col("text"))), "[^\\p{L}\\n]+", "")
    lines = (
        docs.where(F.col("video_id").isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", site_of(F.col("video_id")).alias("site"), letters.alias("letters"))
        .select("doc_id", "site", F.posexplode_outer(F.split("letters", "\n", -1)).alias("at", "line"))
        .where("line <> ''")
    )
    return lines.select(
        F.xxhash64("site", "line").alias("key"), F.hash("line", "site").alias("check"), F.expr("shiftright(doc_id, 6)").alias("word"),
        F.expr("cast(doc_id & 63 as int)").alias("bit"), "doc_id", (F.col("at") + 1).cast("long").alias("line_no"),
    )


def bitmaps(lines: DataFrame) -> DataFrame:
    """(key, check, word, bits): which documents of a site hold a line, variants united.  Fixed-width, combined before the shuffle."""
    return lines.groupBy("key", "check", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))


def above(maps: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """The bitmaps of lines in ``least_documents`` or more documents, with that number."""
    many = maps.groupBy("key", "check").agg(F.sum(F.bit_count("bits")).alias("documents")).where(F.col("documents") >= least_documents)
    return maps.join(many, ["key", "check"])


def repeated_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, line_no, documents) of the lines to delete, found by bitmap lookup.

    The lookup key holds the word, at most 64 documents, so a line that fills a
    third of a site is spread like any other.
    """
    lines = cut(lines_of(docs))  # texts are formed and split once
    found = lines.join(above(bitmaps(lines), least_documents), ["key", "check", "word"])
    return found.where("(shiftright(bits, bit) & 1L) = 1").select("doc_id", "line_no", "documents").distinct()


def without_repeated_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, video_id, text, removed): each document once, without its repeated lines, which are counted."""
    gone = repeated_lines(docs, least_documents).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    one = latest(docs.select("doc_id", "video_id", "text"), "doc_id").join(gone, "doc_id", "left")
    numbered = F.transform(F.split("text", "\n", -1), lambda line, at: F.struct((at + 1).cast("long").alias("n"), line.alias("line")))
    kept = F.filter(numbered, lambda x: ~F.array_contains("gone", x["n"]))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return one.select("doc_id", "video_id", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
