"""Deliveries and running totals."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from sightline.operators import prefix
from sightline.operators.versions import latest


def test_latest_keeps_one_row(spark):
    df = spark.createDataFrame([(1, 5, "old"), (1, 7, "new"), (1, 7, "new"), (2, None, "only"), (None, 9, "no key")], "k long, v int, x string")
    assert sorted(map(tuple, latest(df, "k", "v").collect())) == [(1, 7, "new"), (2, None, "only")]
    assert latest(df.where("false"), "k", "v").count() == 0


def test_running_totals_over_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(9)}", k, rng.randrange(5)) for k in range(3000)] + [("null", -1, None)]
    got = {(g, k): t for g, k, _, t in prefix.running_totals(spark.createDataFrame(rows, "g string, k long, n long"), ["g"], [F.col("k")], "n", "t").collect()}
    sums = defaultdict(int)
    for g, k, n in sorted(rows, key=lambda r: r[1]):
        assert got[g, k] == sums[g]
        sums[g] += n or 0
    assert prefix.running_totals(spark.createDataFrame([], "g string, k long, n long"), ["g"], [F.col("k")], "n", "t").count() == 0
