"""Connected components by contracting random stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.session import materialise


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(eid, component): the smallest eid reachable over ``edges`` (a, b).

    Every round each node points to whichever of itself and its neighbours comes first
    in an order drawn for that round; edges are contracted along the pointers. The
    rounds are logarithmic in the number of nodes. ``nodes`` (eid) adds single ones.
    """
    pointers: list[DataFrame] = []
    edges = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    kind = dict(edges.dtypes)["a"]
    while not edges.isEmpty():
        salt = F.lit(len(pointers))
        ends = edges.union(edges.select("b", "a"))
        mine = F.struct(F.xxhash64("a", salt).alias("o"), F.col("a").alias("v"))
        near = ends.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", salt).alias("o"), F.col("b").alias("v"))).alias("near"))
        point = materialise(near.select(F.col("a").alias("eid"), F.least(mine, "near")["v"].alias("up")), "pointers")
        pointers.append(point)
        moved = edges.join(point.toDF("a", "ua"), "a").join(point.toDF("b", "ub"), "b").where("ua <> ub")
        edges = materialise(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
    if pointers:
        up = pointers[-1]
        for point in reversed(pointers[:-1]):
            up = point.join(up.toDF("up", "root"), "up", "left").select("eid", F.coalesce("root", "up").alias("up"))
        least = up.groupBy("up").agg(F.min("eid").alias("component"))
        out = up.join(least, "up").select("eid", "component")
    else:
        out = edges.sparkSession.createDataFrame([], f"eid {kind}, component {kind}")
    if nodes is not None:
        out = nodes.select("eid").join(out, "eid", "left").select("eid", F.coalesce("component", "eid").alias("component"))
    return out
