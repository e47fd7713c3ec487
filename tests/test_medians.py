"""Exact medians by counting passes, against sorting."""

import math
import random

import pytest

from evigraph.operators import evaluate


def brute(rows):
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    return {k: sorted(v, key=lambda x: (math.isnan(x), 0 if math.isnan(x) else x))[len(v) // 2] for k, v in by.items()}


@pytest.mark.parametrize("bins", [4, 4096])
def test_medians_equal_sorting(spark, bins):
    """Ties, nulls, null keys, infinite and tiny values, integers that a double cannot tell apart."""
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([None, r.random(), round(r.random(), 1), -r.random() * 1e300, r.random() * 1e-300])) for _ in range(400)]
    rows += [("inf", x) for x in (math.inf, math.inf, 1.0, -math.inf)] + [("nan", x) for x in (math.nan, math.nan, 2.0)] + [("one", 5.0), ("two", 5.0), ("two", 7.0), ("none", None)]
    rows += [("wide", x) for x in (-1.7e308, 1.7e308, 0.0, 1.6e308)] + [("low", -math.inf), ("low", -math.inf), ("low", 3.0)]
    got = {x["k"]: x["median"] for x in evaluate.upper_medians(spark.createDataFrame(rows, "k string, v double").repartition(3), "k", "v", bins).collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(got[k] == want[k] or math.isnan(got[k]) and math.isnan(want[k]) for k in want)
    big = [("x", (1 << 62) + k) for k in (0, 1, 2, 3, 3, 7)]
    assert evaluate.upper_medians(spark.createDataFrame(big, "k string, v long"), "k", "v", bins).first()["median"] == (1 << 62) + 3
    assert evaluate.upper_medians(spark.createDataFrame([], "k string, v double"), "k", "v").count() == 0


def test_one_group_of_a_million(spark):
    rows = spark.range(1_000_000).selectExpr("'all' AS k", "cast(pmod(xxhash64(id), 1000003) AS double) / 7 AS v")
    want = sorted(x["v"] for x in rows.select("v").toPandas().to_dict("records"))[500_000]
    assert evaluate.upper_medians(rows, "k", "v").first()["median"] == want
