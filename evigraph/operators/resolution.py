"""Entity resolution: equal canonical names and similar vectors, within a label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import canonical
from evigraph.operators.components import components
from evigraph.operators.graph import Graph
from evigraph.operators.maintain import apply_merge
from evigraph.operators.vectors import pairs_between, similar_links, similar_pairs

THRESHOLD, NEAR = 0.90, 0.08


def exact_links(entities: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(a, b): each entity with the first of its label and canonical name."""
    keyed = entities.select("eid", "label", canonical("name").alias("key"))
    if not keep_empty:
        keyed = keyed.where("key <> ''")
    head = keyed.groupBy("label", "key").agg(F.min("eid").alias("a"))
    return keyed.join(head, ["label", "key"]).where("a <> eid").select("a", F.col("eid").alias("b"))


def numbered(entities: DataFrame) -> DataFrame:
    """Entities with a long ``vec_id`` by which pairs are named: a hash of the eid."""
    return entities.withColumn("vec_id", F.xxhash64("eid"))


def cosine_links(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of entities (eid, label, embedding) of one label."""
    n = numbered(entities)
    pairs = similar_pairs(n, threshold, "label")
    who = n.select("vec_id", "eid")
    named = pairs.join(who.toDF("a", "ea"), "a").join(who.toDF("b", "eb"), "b")
    return named.select(F.least("ea", "eb").alias("a"), F.greatest("ea", "eb").alias("b"), "similarity")


def cosine_stars(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): links whose components are those of cosine_links()."""
    n = numbered(entities)
    who = n.select("vec_id", "eid")
    pairs = similar_links(n, threshold, "label")
    return pairs.join(who.toDF("a", "ea"), "a").join(who.toDF("b", "eb"), "b").select(F.col("ea").alias("a"), F.col("eb").alias("b"))


def near_matches(vectors: DataFrame, threshold: float = THRESHOLD, band: float = NEAR, group_col: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """All pairs of rows a little below the threshold, for reviewing it, copies' too (I4)."""
    return pairs_between(vectors, threshold - band, threshold, group_col, id_col, vec_col)


def component_survivors(entities: DataFrame, component: DataFrame) -> DataFrame:
    """(component, survivor, name, aliases, members), a row for each component: the longest name survives, all names are aliases."""
    named = entities.select("eid", "name").join(component, "eid")
    best = named.groupBy("component").agg(
        F.min_by(F.struct("eid", "name"), F.struct(-F.length("name"), "eid")).alias("s"), F.array_sort(F.collect_set("name")).alias("aliases"), F.count(F.lit(1)).alias("members")
    )
    return best.select("component", F.col("s.eid").alias("survivor"), F.col("s.name").alias("name"), "aliases", "members")


def survivors(entities: DataFrame, component: DataFrame) -> DataFrame:
    """(eid, survivor, name, aliases, members) of every entity: what its component has, with all aliases beside each member.

    Of large components take component_survivors(), which has the names once.
    """
    return component.join(component_survivors(entities, component), "component").select("eid", "survivor", "name", "aliases", "members")


def plan(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The merges that resolution would make: survivors of components of several members."""
    links = exact_links(entities).unionByName(cosine_stars(entities, threshold))
    return survivors(entities, components(links, entities.select("eid"))).where("members > 1")


def apply(g: Graph, planned: DataFrame) -> Graph:
    """Carry a plan out: nodes merged, edges moved, aliases noted."""
    out = apply_merge(g, planned.select("eid", "survivor"))
    noted = planned.where("eid = survivor").select("eid", F.col("aliases").alias("_known"))
    nodes = out.nodes.join(noted, "eid", "left").withColumn("aliases", F.coalesce("_known", "aliases")).drop("_known")
    return Graph(nodes.select("eid", "label", "name", "aliases"), out.edges, out.mentions, out.chunks)
