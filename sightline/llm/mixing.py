"""Mixing sources to target weights, to the exact token.

Every document gets a hash-random key; within each source the documents are
range-sorted by it and distributed prefix sums of their token counts place each at
an offset.  A source's budget is cut at exactly its share of the mix: whole epochs
of the source first, then the documents whose offset lies below the remainder, the
last of them in part (``used`` < ``tokens``).

Source names count without regard to case and surrounding space.  Sources without
a target are left out; targets without documents get nothing and the other shares
are scaled up.  Unless a total is given, it is the greatest at which every share
can be met with no document used more than ``max_repeats`` times; with a greater
total, sources that run out contribute all they may, and the reached shares show
it.  Null and empty texts have no tokens and are left out; a repeated doc_id counts
once; targets that are null or not positive ask for nothing.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.prefix import running_totals
from sightline.operators.versions import latest
from sightline.session import cut

SEED = 17
#: Environment variable that names the byte-level vocabulary where a caller gives no path.
TOKENIZER_VARIABLE = "SIGHTLINE_TOKENIZER"
#: Fixed value: how the byte-level vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            encode = encode or _tokenizer(path).encode_ordinary
            counts = pa.array([len(encode(t)) for t in b["text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source_name"], counts], names=["doc_id", "source_name", "tokens"])

    return run


def tokenizer_path(path: str | None = None) -> str:
    path = path or os.environ.get(TOKENIZER_VARIABLE)
    if not path:
        raise ValueError(f"give the path of a tokenizer's vocabulary, or name it in {TOKENIZER_VARIABLE}")
    return path


def source_name(column) -> F.Column:
    return F.lower(F.trim(column))


def token_counts(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source_name, tokens) of the documents whose source has a target, each once."""
    names = [r[0] for r in targets.select("source_name").collect()]  # one row per source, as many as a recipe names
    wanted = documents.where(F.col("doc_id").isNotNull() & (F.col("text") != "")).withColumn("source_name", source_name(F.col("source"))).where(F.col("source_name").isin(names))
    counted = wanted.select("doc_id", "source_name", "text").mapInArrow(_counter(tokenizer_path(tokenizer)), "doc_id long, source_name string, tokens long")
    return latest(counted, "doc_id", F.struct("source_name", "tokens"))


def clean_targets(targets: DataFrame) -> DataFrame:
    named = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).withColumn("source_name", source_name(F.col("source_name")))
    return named.groupBy("source_name").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[dict]:
    """Per source with documents: size, share, budget and what it can give, from sums only."""
    rows = sizes.groupBy("source_name").agg(F.sum("tokens").alias("size")).where("size > 0").join(F.broadcast(targets), "source_name").collect()
    asked = sum(r["target_share"] for r in rows)
    if not rows:
        return []
    share = {r["source_name"]: r["target_share"] / asked for r in rows}
    if total is None:
        total = int(min(r["max_repeats"] * r["size"] / share[r["source_name"]] for r in rows))
    out = []
    for r in rows:
        budget = min(round(total * share[r["source_name"]]), r["max_repeats"] * r["size"])
        out.append({"source_name": r["source_name"], "size": r["size"], "target_share": r["target_share"], "budget": budget, "epochs": budget // r["size"], "rest": budget % r["size"]})
    return out


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source_name, epoch, tokens, used): the documents of the mix, one row per use."""
    spark = documents.sparkSession
    wanted = clean_targets(targets)
    sizes = cut(token_counts(documents, wanted, tokenizer).where("tokens > 0"))
    plan = budgets(sizes, wanted, total)
    if not plan:
        return spark.createDataFrame([], "doc_id long, source_name string, epoch int, tokens long, used long")
    keyed = sizes.withColumn("random", F.xxhash64(F.lit(seed), "doc_id"))
    placed = running_totals(keyed, ["source_name"], [F.col("random"), F.col("doc_id")], "tokens", "offset")
    recipe = spark.createDataFrame([(p["source_name"], p["epochs"], p["rest"]) for p in plan], "source_name string, epochs long, rest long")
    cutoff = F.greatest(F.lit(0), F.least("tokens", F.col("rest") - F.col("offset")))
    uses = placed.join(F.broadcast(recipe), "source_name").withColumn("part", cutoff).withColumn("n", F.col("epochs") + (F.col("part") > 0).cast("long")).where("n > 0")
    each = uses.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return each.select("doc_id", "source_name", "epoch", "tokens", F.when(F.col("epoch") <= F.col("epochs"), F.col("tokens")).otherwise(F.col("part")).alias("used"))


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_name, target_share, tokens, share, documents, uses): what each target asked for and got."""
    got = mixed.groupBy("source_name").agg(F.sum("used").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.count("*").alias("uses"))
    totals = got.agg(F.sum("tokens").alias("all"))
    wanted = clean_targets(targets).select("source_name", "target_share").join(got, "source_name", "left")
    return wanted.join(F.broadcast(totals), F.lit(True)).select(
        "source_name", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("uses", F.lit(0)).alias("uses"),
    )
