"""A property graph of the star-schema tables, in the shapes of the ontology.

Suppliers and customers are companies, parts products, market segments segments,
nations and regions locations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators.graph import Graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _row(prefix: str, *columns: str):
    return F.sha1(F.concat(F.lit(prefix), F.concat_ws("-", *[F.col(c).cast("string") for c in columns])))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        ("S", "COMPANY", "s_suppkey", "s_name", read(spark, d, "supplier")),
        ("C", "COMPANY", "c_custkey", "c_name", read(spark, d, "customer")),
        ("P", "PRODUCT", "p_partkey", "p_name", read(spark, d, "part")),
        ("G", "SEGMENT", "c_mktsegment", "c_mktsegment", read(spark, d, "customer").select("c_mktsegment").distinct()),
        ("N", "LOCATION", "n_nationkey", "n_name", read(spark, d, "nation")),
        ("R", "LOCATION", "r_regionkey", "r_name", read(spark, d, "region")),
    ]
    none = F.lit(None).cast("array<string>").alias("aliases")
    out = [t.select(_id(p, key).alias("eid"), F.lit(label).alias("label"), F.col(name).alias("name"), none) for p, label, key, name, t in parts]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def edges(spark: SparkSession, d: str) -> DataFrame:
    s, c, line = read(spark, d, "supplier"), read(spark, d, "customer"), read(spark, d, "lineitem")
    # The hash as bytes, of the same order and half the length.
    src = F.min(F.unhex(_row("lineitem:", "l_orderkey", "l_linenumber"))).alias("source")
    sold = line.groupBy("l_suppkey", "l_partkey").agg(src)
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    # An order is one row and a quarter of its lines: each task hashes its share of orders, and the lines pass by unsorted.
    served = line.join(orders.hint("shuffle_hash"), "l_orderkey").groupBy("l_suppkey", "o_custkey").agg(src)

    hexed = F.lower(F.hex("source"))

    def edge(t: DataFrame, a: tuple, rel: str, b: tuple, source) -> DataFrame:
        return t.select(_id(*a).alias("src"), F.lit(rel).alias("rel"), _id(*b).alias("dst"), source.alias("triplet_source_id"))

    out = edge(s, ("S", "s_suppkey"), "HEADQUARTERED_IN", ("N", "s_nationkey"), _row("supplier:", "s_suppkey"))
    out = out.unionByName(edge(c, ("C", "c_custkey"), "HEADQUARTERED_IN", ("N", "c_nationkey"), _row("customer:", "c_custkey")))
    out = out.unionByName(edge(c, ("C", "c_custkey"), "OPERATES_SEGMENT", ("G", "c_mktsegment"), _row("customer:", "c_custkey")))
    out = out.unionByName(edge(sold, ("S", "l_suppkey"), "OFFERS_PRODUCT", ("P", "l_partkey"), hexed))
    return out.unionByName(edge(served, ("S", "l_suppkey"), "SUPPLIES_TO", ("C", "o_custkey"), hexed))


def star_graph(spark: SparkSession, d: str) -> Graph:
    return Graph(nodes(spark, d), edges(spark, d))


def places(spark: SparkSession, d: str) -> Graph:
    """Companies in nations and nations in regions: a sparse graph, with parts out of reach."""
    n = read(spark, d, "nation").select(_id("N", "n_nationkey").alias("src"), F.lit("OPERATES_IN").alias("rel"), _id("R", "n_regionkey").alias("dst"), _row("nation:", "n_nationkey").alias("triplet_source_id"))
    return Graph(nodes(spark, d), edges(spark, d).where("rel = 'HEADQUARTERED_IN'").unionByName(n))


SQL = r"""
nodes AS (
  SELECT 'S' || s_suppkey AS eid, 'COMPANY' AS label, s_name AS name FROM supplier UNION ALL
  SELECT 'C' || c_custkey, 'COMPANY', c_name FROM customer UNION ALL
  SELECT 'P' || p_partkey, 'PRODUCT', p_name FROM part UNION ALL
  SELECT DISTINCT 'G' || c_mktsegment, 'SEGMENT', c_mktsegment FROM customer UNION ALL
  SELECT 'N' || n_nationkey, 'LOCATION', n_name FROM nation UNION ALL
  SELECT 'R' || r_regionkey, 'LOCATION', r_name FROM region),
edges AS (
  SELECT 'S' || s_suppkey AS src, 'HEADQUARTERED_IN' AS rel, 'N' || s_nationkey AS dst, sha1('supplier:' || s_suppkey) AS triplet_source_id FROM supplier UNION ALL
  SELECT 'C' || c_custkey, 'HEADQUARTERED_IN', 'N' || c_nationkey, sha1('customer:' || c_custkey) FROM customer UNION ALL
  SELECT 'C' || c_custkey, 'OPERATES_SEGMENT', 'G' || c_mktsegment, sha1('customer:' || c_custkey) FROM customer UNION ALL
  SELECT 'S' || l_suppkey, 'OFFERS_PRODUCT', 'P' || l_partkey, min(sha1('lineitem:' || l_orderkey || '-' || l_linenumber)) FROM lineitem GROUP BY l_suppkey, l_partkey UNION ALL
  SELECT 'S' || l_suppkey, 'SUPPLIES_TO', 'C' || o_custkey, min(sha1('lineitem:' || l_orderkey || '-' || l_linenumber)) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey)
"""
