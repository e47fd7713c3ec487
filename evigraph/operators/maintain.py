"""Keeping the graph clean: keyed merge, junk, merging nodes, self-loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import canonical, is_junk
from evigraph.operators.graph import Graph


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each eid; of several the first by label and name (A10)."""
    best = F.min(F.struct("label", "name", "aliases")).alias("n")
    return nodes.groupBy("eid").agg(best).select("eid", "n.label", "n.name", "n.aliases")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, rel, dst), with the least source chunk and all of them (A10)."""
    ids = F.array_sort(F.collect_set("triplet_source_id"))
    return edges.groupBy("src", "rel", "dst").agg(F.min("triplet_source_id").alias("triplet_source_id"), ids.alias("src_chunks"))


def valid_triples(triples: DataFrame, allowed: DataFrame) -> DataFrame:
    """Triples (s_type, rel, o_type, ...) of an allowed shape; the shapes are a fixed table."""
    return triples.join(F.broadcast(allowed.select("s_type", "rel", "o_type")), ["s_type", "rel", "o_type"], "left_semi")


def detach_delete(g: Graph, gone: DataFrame) -> Graph:
    """Without the nodes of ``gone`` (eid) and their edges."""
    ids = gone.select("eid").distinct()
    edges = g.edges.join(ids.select(F.col("eid").alias("src")), "src", "left_anti").join(ids.select(F.col("eid").alias("dst")), "dst", "left_anti")
    mentions = g.mentions.join(ids, "eid", "left_anti") if g.mentions is not None else None
    return Graph(g.nodes.join(ids, "eid", "left_anti"), edges.select(g.edges.columns), mentions, g.chunks)


def junk(g: Graph) -> DataFrame:
    """Entities that are no names."""
    return g.entities().where(is_junk("name", "label"))


def rewire(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """Edges with ends moved to their survivors (eid, survivor), parallel ones merged."""
    # An id has one survivor: each task hashes its share of them, and the edges pass by unsorted.
    s = survivors.where("eid <> survivor").hint("shuffle_hash")
    moved = edges.join(s.toDF("src", "s2"), "src", "left").join(s.toDF("dst", "d2"), "dst", "left")
    moved = moved.select(F.coalesce("s2", "src").alias("src"), "rel", F.coalesce("d2", "dst").alias("dst"), "triplet_source_id")
    return merge_edges(moved)


def drop_self_loops(edges: DataFrame) -> DataFrame:
    """Without any self-loop, old or new."""
    return edges.where("src <> dst")


def canonical_survivors(g: Graph, keep_empty: bool = False) -> DataFrame:
    """(eid, survivor): entities of one label and canonical name go to the longest name.

    keep_empty: names whose key is empty also meet; by default they are left apart.
    """
    keyed = g.entities().select("eid", "label", canonical("name").alias("key"), "name")
    if not keep_empty:
        keyed = keyed.where("key <> ''")
    best = keyed.groupBy("label", "key").agg(F.min_by("eid", F.struct(-F.length("name"), "eid")).alias("survivor"))
    return keyed.join(best, ["label", "key"]).select("eid", "survivor")


def apply_merge(g: Graph, survivors: DataFrame) -> Graph:
    """Merge nodes into their survivors, whose properties win; self-loops go."""
    gone = survivors.where("eid <> survivor")
    nodes = g.nodes.join(gone, "eid", "left_anti")
    edges = drop_self_loops(rewire(g.edges, survivors)).select("src", "rel", "dst", "triplet_source_id")
    mentions = g.mentions
    if mentions is not None:
        mentions = mentions.join(gone, "eid", "left").select("chunk_id", F.coalesce("survivor", "eid").alias("eid")).distinct()
    return Graph(nodes, edges, mentions, g.chunks)


def cleanup(g: Graph, keep_empty: bool = False) -> Graph:
    """Junk goes, canonical duplicates merge, self-loops go."""
    clean = detach_delete(g, junk(g))
    return apply_merge(clean, canonical_survivors(clean, keep_empty))
