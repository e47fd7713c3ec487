"""Components that are kept up to date as links come in (H15 over L4).

Three keyed tables: every node's home, every home's root, and every root's smallest node.
New links are looked up as links between roots, and the components of these few say which
roots meet. The root with the most homes stays, the homes of the others move to it; nodes
never do. So what is written grows with the new links: a row for each new node, and for
each home no more than about log2 of their number over all time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from evigraph.operators.components import components
from evigraph.session import materialise
from evigraph.sources.stores import KeyedTable


class LinkedTable:
    """Components of all links that were ever added, stored below a path.

    Links are (a, b); a null end says nothing of its link, a link of a node with itself
    makes it known; repeated links change nothing. Adding the same links again, as after a
    crash, gives the same components: a version of the tables is written root first, and
    roots that have met go last.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "string", bucket_rows: int | None = None):
        more = {} if bucket_rows is None else {"bucket_rows": bucket_rows}
        schema = lambda text: StructType.fromDDL(text)
        self.spark, self.kind = spark, kind
        self.nodes = KeyedTable(spark, f"{path}/nodes", schema(f"eid {kind}, home {kind}"), ["eid"], **more)
        self.homes = KeyedTable(spark, f"{path}/homes", schema(f"home {kind}, root {kind}"), ["home"], **more)
        self.roots = KeyedTable(spark, f"{path}/roots", schema(f"root {kind}, least {kind}, homes long"), ["root"], **more)

    def labels(self) -> DataFrame:
        """(eid, component): every known node with the smallest node of its component."""
        known = self.nodes.read().join(self.homes.read(), "home").join(self.roots.read(), "root")
        return known.select("eid", F.col("least").alias("component"))

    def add(self, links: DataFrame) -> int:
        """Take links in; the number of rows that were written."""
        links = materialise(links.select(F.col("a").cast(self.kind).alias("a"), F.col("b").cast(self.kind).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
        ends = links.select(F.col("a").alias("eid")).union(links.select("b")).distinct()
        known = ends.join(self.nodes.read(), "eid", "left").join(self.homes.read(), "home", "left")
        # A node that is new stands for itself until it has a root.
        ends = materialise(known.select("eid", F.col("root").isNull().alias("fresh"), F.coalesce("root", "eid").alias("at")), "ends")
        of = lambda c: ends.select(F.col("eid").alias(c), F.col("at").alias(f"at_{c}"))
        between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("at_a").alias("a"), F.col("at_b").alias("b"))
        # Roots are nodes too, so a new node is no root that is known.
        group = materialise(components(between, ends.select(F.col("at").alias("eid")).distinct()).toDF("at", "group"), "groups")
        old = self.roots.read().join(group.select(F.col("at").alias("root"), "group"), "root")
        fresh = ends.where("fresh").select("eid", "at").join(group, "at").select("eid", "group")
        first = old.groupBy("group").agg(F.max_by("root", F.struct("homes", "root")).alias("root"), F.min("least").alias("least"), F.sum("homes").alias("homes"), F.count(F.lit(1)).alias("met"))
        new = fresh.groupBy("group").agg(F.min("eid").alias("least_new"))
        both = first.join(new, "group", "full")
        least = F.least("least", "least_new")  # a null says nothing
        met = both.select("group", F.coalesce("root", "least_new").alias("root"), least.alias("least"), F.coalesce("homes", F.lit(1)).alias("homes"), F.col("root").isNull().alias("made"), (F.coalesce("met", F.lit(0)) > 1).alias("merged"), (least != F.coalesce("least", "least_new")).alias("smaller"))
        met = materialise(met, "met")
        moved = old.join(met.where("merged").select("group", F.col("root").alias("to")), "group").where("root <> to").select("root", "to")
        moved = materialise(moved, "moved")
        put = materialise(met.where("made OR merged OR smaller").select("root", "least", "homes"), "roots")
        homes = met.where("made").select(F.col("root").alias("home"), "root").unionByName(self.homes.read().join(moved, "root").select("home", F.col("to").alias("root")))
        homes = materialise(homes, "homes")
        nodes = materialise(fresh.join(met.select("group", F.col("root").alias("home")), "group").select("eid", "home"), "nodes")
        written = 0
        for table, rows in ((self.roots, put), (self.homes, homes), (self.nodes, nodes)):
            if n := rows.count():
                table.upsert(rows)
                written += n
        if n := moved.count():
            self.roots.upsert(self.spark.createDataFrame([], self.roots.schema), moved.select("root"))
            written += n
        return written


def link_stream(links: DataFrame, table: LinkedTable, checkpoint: str) -> StreamingQuery:
    """Add a stream of links (a, b), batch by batch, once for all that is there."""
    return links.writeStream.foreachBatch(lambda df, _: table.add(df) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
