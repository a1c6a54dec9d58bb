"""How distinctive a term is of a record: positive pointwise mutual information.

For term t in record r: ``ppmi = max(0, ln(p(t, r) / (p(t) * p_a(r))))`` with
``p(t, r) = joint / N``, ``p(t) = total / N`` and the record's (context's) share
smoothed by a fractional exponent, ``p_a(r) = size(r)^a / sum(size^a)``; ``N`` is
the number of term occurrences in the collection.  Group-bys and joins only.

Null and empty texts have no terms and give no rows; records without a key are left
out; a record delivered more than once counts once.  Records outside the collection (queries) are scored against
the collection's marginals; a term that the collection lacks has df 0 and counts
as occurring there as often as in the record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.session import cut

#: Terms in more than 1/FREQUENT of all (record, term) rows; so there are at most FREQUENT of them.
FREQUENT = 200_000


def count_terms(records: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, size, term, joint) from one array of terms per record.

    No shuffle where the records are partitioned by ``key`` already, as after ``latest``.
    """
    # explode_outer: for a plain explode the optimizer adds a filter that works the terms out a second time.
    one = records.where(F.col(key).isNotNull()).select(F.col(key).alias("record_key"), F.size(terms).cast("long").alias("size"), F.explode_outer(terms).alias("term")).where("term is not null")
    return one.groupBy("record_key", "size", "term").agg(F.count("*").alias("joint"))


@dataclass
class Collection:
    """Joint and marginal counts of a collection, written once."""

    counts: DataFrame
    marginals: DataFrame
    occurrences: int
    pairs: int
    smoothed: float
    exponent: float

    @classmethod
    def of(cls, counts: DataFrame, exponent: float = 0.75) -> Collection:
        counts = cut(counts)
        # A record's joint counts sum to its size, so joint * size^(a-1) sums to size^a.
        row = counts.agg(F.sum("joint"), F.count("*"), F.sum(F.col("joint") * F.pow("size", F.lit(exponent - 1)))).first()
        marginals = counts.groupBy("term").agg(F.sum("joint").alias("total"), F.count("*").alias("df"))
        return cls(counts, marginals, row[0] or 0, row[1], row[2] or 0.0, exponent)

    def score(self, counts: DataFrame) -> DataFrame:
        """(record_key, term, joint, size, total, df, ppmi) for rows of ``count_terms``.

        Frequent terms are joined by a broadcast of at most FREQUENT rows (the counts
        of all terms sum to the pairs), so the shuffled join has no hot key.
        """
        bar = self.pairs / FREQUENT
        frequent = F.broadcast(self.marginals.where(F.col("df") > bar))
        rare = self.marginals.where(F.col("df") <= bar)
        rest = counts.join(F.broadcast(frequent.select("term")), "term", "left_anti")
        joined = counts.join(frequent, "term").unionByName(rest.join(rare, "term", "left"), allowMissingColumns=True)
        total = F.when(F.coalesce("total", F.lit(0)) > 0, F.col("total")).otherwise(F.col("joint"))
        ratio = F.col("joint") * F.lit(float(self.smoothed)) / (total * F.pow("size", F.lit(self.exponent)))
        return joined.select(
            "record_key", "term", "joint", "size", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("df", F.lit(0)).alias("df"),
            F.greatest(F.lit(0.0), F.log(ratio)).alias("ppmi"),
        )
