"""Labels of near-duplicate components meet a node's row, not each of its buckets."""

from pyspark.sql import functions as F

from evigraph.llm import near_dedup


def test_closed_buckets_leave_the_rounds(spark):
    """Buckets 1 and 2 hold one component, bucket 3 two."""
    places = [(1, [(1, 0), (3, 1)]), (2, [(1, 0), (2, 1)]), (3, [(2, 1), (3, 1)]), (4, [(1, 0)])]
    held = spark.createDataFrame(places, "node long, places array<struct<bucket:long,band:tinyint>>")
    label = spark.createDataFrame([(1, 1), (2, 1), (4, 1), (3, 1)], "node long, label long")
    assert near_dedup.still_open(held, label, 4).isEmpty()
    two = label.withColumn("label", F.when(F.col("node") == 3, 3).otherwise(F.lit(1)).cast("long"))
    got = {r["node"]: sorted(p["bucket"] for p in r["places"]) for r in near_dedup.still_open(held, two, 4).collect()}
    assert got == {1: [3], 2: [2], 3: [2, 3]}
    assert near_dedup.placed(held, label).count() == 7
