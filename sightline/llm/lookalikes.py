"""Visually identical text with different characters: groups of equal skeleton.

The skeleton of a text is its decomposition with every character replaced by the
prototype of its look-alike class, decomposed again; its composed form is the
consistent form.  Originals are grouped by a 128-bit hash of it.

Null and empty texts are no case.  A record delivered more than once counts once.
Texts equal as stored are one class, which is never expanded unless a look-alike
of it differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.textform import form_column
from sightline.session import cut

#: Records of one class that a salt may hold.
SALT_ROWS = 2000


def consistent(records: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(record_kind, record_key, text, form) of each record; null stays null."""
    return records.select(F.lit(kind).alias("record_kind"), F.col(key).alias("record_key"), F.col(text).alias("text"), form_column(F.col(text)).alias("form"))


def keyed(records: DataFrame) -> DataFrame:
    """(record_kind, record_key, skeleton, stored): hashes of the consistent form and of the text as stored, each record once; worked out once and written."""
    has = records.where(F.col("record_key").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    return cut(has.select("record_kind", "record_key", F.unhex(F.md5("form")).alias("skeleton"), F.unhex(F.md5("text")).alias("stored"))).distinct()


def _classes(hashes: DataFrame) -> DataFrame:
    """(record_kind, skeleton, class_key, spellings, records) of skeletons that occur in two or more stored spellings.

    Counted per spelling first, so a notice stored a million times is one row a task.
    """
    spelled = hashes.groupBy("record_kind", "skeleton", "stored").agg(F.count("*").alias("n"), F.min("record_key").alias("key"))
    return spelled.groupBy("record_kind", "skeleton").agg(F.min("key").alias("class_key"), F.count("*").alias("spellings"), F.sum("n").alias("records")).where("spellings > 1")


def lookalike_classes(hashes: DataFrame) -> DataFrame:
    """(record_kind, record_key, class_key, links): each record that looks like one stored differently, its class named by the smallest key,
    and with how many records it looks alike while they differ as stored."""
    by = ["record_kind", "skeleton"]
    inside = hashes.join(_classes(hashes), by)
    same = inside.groupBy(*by, "stored").agg(F.count("*").alias("same"))
    return inside.join(same, [*by, "stored"]).select("record_kind", "record_key", "class_key", (F.col("records") - F.col("same")).alias("links"))


def lookalike_pairs(hashes: DataFrame) -> DataFrame:
    """(record_kind, key_a, key_b), key_a < key_b: records that look alike and differ as stored.

    All pairs are wanted here; ``lookalike_classes`` says the same in a row a record.
    A class of many records is dealt out over salts, so that its pairs are made by many tasks.
    """
    by = ["record_kind", "skeleton"]
    groups = hashes.join(_classes(hashes).select(*by, F.ceil(F.col("records") / SALT_ROWS).cast("int").alias("salts")), by)
    salt = F.pmod(F.xxhash64("record_key"), F.col("salts")).cast("int")
    a = groups.select(*by, salt.alias("salt"), F.col("record_key").alias("key_a"), F.col("stored").alias("stored_a"))
    b = groups.select(*by, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("record_key").alias("key_b"), F.col("stored").alias("stored_b"))
    return a.join(b, [*by, "salt"]).where("key_a < key_b and stored_a <> stored_b").select("record_kind", "key_a", "key_b")
