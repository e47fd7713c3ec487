"""Shortest paths by breadth-first search over DataFrames.

The edges are stored once, in their own direction, and read in both. Each round joins
the frontier with them and drops what was visited; only one state a node moves on. Rounds end when the frontier is empty or the depth
bound is met, and each is materialised, so the plan does not grow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators.graph import Graph
from evigraph.session import materialise

MOST_HOPS = 5


def _links(edges: DataFrame) -> DataFrame:
    """(here, rel, there) in both directions of stored edges (src, rel, dst); parallel ones and self-loops stay."""
    e = edges.select(F.col("src").alias("here"), "rel", F.col("dst").alias("there"))
    return e.unionByName(e.select(F.col("there").alias("here"), "rel", F.col("here").alias("there")))


def hop_distances(g: Graph, names: Sequence[str], most_hops: int = MOST_HOPS) -> DataFrame:
    """(eid, depth) of all nodes within ``most_hops`` of the named ones."""
    links = _links(materialise(g.edges.select("src", F.lit("").alias("rel"), "dst"), "links"))  # read once a round
    seen = frontier = materialise(g.anchors(names).select("eid", F.lit(0).alias("depth")).distinct(), "frontier")
    for depth in range(1, most_hops + 1):
        reached = links.join(frontier.select(F.col("eid").alias("here")), "here", "left_semi").select(F.col("there").alias("eid")).distinct()
        frontier = materialise(reached.join(seen, "eid", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def path_between(g: Graph, a: str, b: str, most_hops: int = MOST_HOPS, include_mentions: bool = False) -> DataFrame:
    """(path, relations): for each pair of end nodes one shortest undirected path.

    Of several shortest paths the first by relations and node ids is taken. A node that
    is its own end has the empty path of one node. include_mentions: paths may cross
    chunks, whose names are null.
    """
    edges = g.edges.select("src", "rel", "dst")
    if include_mentions and g.mentions is not None:
        edges = edges.unionByName(g.mentions.select(F.col("chunk_id").alias("src"), F.lit("MENTIONS").alias("rel"), F.col("eid").alias("dst")))
    # Of parallel edges the first relation is on the path that is taken, as the least state of a node moves on.
    links = _links(materialise(edges, "links"))
    start = g.anchors([a]).select(F.col("eid").alias("root"), "eid", F.array("eid").alias("nodes"), F.array().cast("array<string>").alias("relations"))
    frontier = materialise(start, "paths")
    seen = frontier.select("root", "eid")
    ends = g.anchors([b]).select("eid")
    found = frontier.join(ends, "eid", "left_semi").select("root", "eid", "nodes", "relations")
    for _ in range(most_hops):
        step = frontier.join(links, frontier["eid"] == links["here"])
        step = step.select("root", F.col("there").alias("eid"), F.concat("nodes", F.array("there")).alias("nodes"), F.concat("relations", F.array("rel")).alias("relations"))
        step = step.join(seen, ["root", "eid"], "left_anti")
        best = F.min(F.struct("relations", "nodes")).alias("p")
        frontier = materialise(step.groupBy("root", "eid").agg(best).select("root", "eid", "p.nodes", "p.relations"), "paths")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("root", "eid"))
        found = found.unionByName(frontier.join(ends, "eid", "left_semi").select(found.columns))
    steps = found.select("root", F.col("eid").alias("end"), "relations", F.posexplode("nodes").alias("pos", "eid"))
    named = steps.join(g.nodes.select("eid", "name"), "eid", "left")
    paths = named.groupBy("root", "end", "relations").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("p"))
    return paths.select(F.transform("p", lambda x: x["name"]).alias("path"), "relations")


def paths_between(g: Graph, pairs: DataFrame, most_hops: int = MOST_HOPS) -> DataFrame:
    """(a, b, hops, path, relations): a shortest undirected path for each pair of node ids (a, b).

    All pairs are searched at once, from both ends by turns; a pair is done in the first
    round in which its two frontiers share a node. A state is a pair and a node, however
    many paths lead there. Then the nodes that lie between are marked backwards from the
    shared ones, each takes one step on, and the paths are put together along these steps;
    this goes by the links that the search took, kept by level, so that the edges are read
    once a round and once for the relations.
    Of several shortest paths that is taken whose first node in which they differ has the
    smallest id, and of parallel edges the first relation. A node that is its own end has
    the path of one node; pairs without a path of most_hops, unknown or null ids give no row;
    repeated pairs give one.
    """
    links = _links(materialise(g.edges.select("src", "rel", "dst"), "links"))
    pairs = pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    known = g.nodes.select("eid").distinct()
    pairs = pairs.join(known.withColumnRenamed("eid", "a"), "a", "left_semi").join(known.withColumnRenamed("eid", "b"), "b", "left_semi")
    pairs = materialise(pairs, "pairs")
    # Levels of either side: the nodes at each distance from a, and from b.
    sides = [[materialise(pairs.select("a", "b", F.col(end).alias("eid")), "level")] for end in ("a", "b")]
    # Links (a, b, eid, there) from each level to the next.
    taken: list[list[DataFrame]] = [[], []]
    met = materialise(pairs.where("a = b").select("a", "b", F.col("a").alias("eid"), F.lit(0).alias("i"), F.lit(0).alias("j")), "met")
    found = met
    for turn in range(most_hops):
        mine, other = sides[turn % 2], sides[1 - turn % 2]
        open_ = mine[-1].join(met.select("a", "b").distinct(), ["a", "b"], "left_anti")
        seen = mine[0]
        for level in mine[1:]:
            seen = seen.unionByName(level)
        step = open_.join(links.select(F.col("here").alias("eid"), "there"), "eid").select("a", "b", "eid", "there")
        step = materialise(step.join(seen.withColumnRenamed("eid", "there"), ["a", "b", "there"], "left_anti").select("a", "b", "eid", "there"), "taken")
        new = materialise(step.select("a", "b", F.col("there").alias("eid")).distinct(), "level")
        taken[turn % 2].append(step)
        mine.append(new)
        if new.isEmpty():
            break
        i, j = len(sides[0]) - 1, len(sides[1]) - 1
        now = new.join(other[-1], ["a", "b", "eid"], "left_semi").select("a", "b", "eid", F.lit(i).alias("i"), F.lit(j).alias("j"))
        now = materialise(now, "met")
        found, met = found.unionByName(now), met.select("a", "b").unionByName(now.select("a", "b"))

    # Steps (a, b, eid, depth, to): on the first side only those that lead to a shared node.
    ahead, steps = None, []
    for depth in range(len(sides[0]) - 2, -1, -1):
        here = found.where(F.col("i") == depth + 1).select("a", "b", F.col("eid").alias("there"))
        here = here if ahead is None else here.unionByName(ahead.select("a", "b", F.col("eid").alias("there")))
        back = taken[0][depth].join(here.distinct(), ["a", "b", "there"], "left_semi")
        ahead = materialise(back.groupBy("a", "b", "eid").agg(F.min("there").alias("to")), "steps")
        steps.append(ahead.withColumn("depth", F.lit(depth)))
    # On the other side every node steps to its least neighbour that is nearer to b.
    for near in range(len(sides[1]) - 1):
        least = taken[1][near].groupBy("a", "b", F.col("there").alias("eid")).agg(F.min("eid").alias("to"))
        ends = found.groupBy("a", "b").agg(F.max(F.col("i") + F.col("j")).alias("hops"), F.max("i").alias("first"))
        placed = least.join(ends, ["a", "b"]).withColumn("depth", F.col("hops") - near - 1).where("depth >= first")
        steps.append(materialise(placed.select("a", "b", "eid", "to", "depth"), "steps"))

    walk = found.groupBy("a", "b").agg(F.max(F.col("i") + F.col("j")).alias("hops"))
    walk = walk.select("a", "b", "hops", F.col("a").alias("eid"), F.array("a").alias("nodes"))
    if steps:
        every = steps[0]
        for s in steps[1:]:
            every = every.unionByName(s.select(every.columns))
        for depth in range(most_hops):
            on = every.where(F.col("depth") == depth).select("a", "b", "eid", "to")
            walk = walk.join(on, ["a", "b", "eid"], "left").select("a", "b", "hops", F.coalesce("to", "eid").alias("eid"), F.when(F.col("to").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array("to"))).alias("nodes"))
    placed = materialise(walk.select("a", "b", "hops", "nodes"), "walks").select("a", "b", "hops", "nodes", F.posexplode("nodes").alias("pos", "here"))
    placed = materialise(placed.withColumn("there", F.try_element_at("nodes", F.col("pos") + 2)), "placed")
    rels = links.join(placed.select("here", "there").distinct(), ["here", "there"], "left_semi").groupBy("here", "there").agg(F.min("rel").alias("rel"))
    placed = placed.join(rels, ["here", "there"], "left")
    named = placed.join(g.nodes.select(F.col("eid").alias("here"), "name"), "here", "left")
    out = named.groupBy("a", "b", "hops").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "rel"))).alias("p"))  # most_hops + 1 at most
    return out.select("a", "b", "hops", F.transform("p", lambda x: x["name"]).alias("path"), F.filter(F.transform("p", lambda x: x["rel"]), lambda x: x.isNotNull()).alias("relations"))


def drawing_layers(edges: DataFrame, first: str, most_hops: int = 64) -> DataFrame:
    """(eid, depth) in an evidence graph from the first edge's source."""
    nodes = edges.select(F.col("src").alias("eid")).union(edges.select(F.col("dst").alias("eid"))).distinct().withColumn("name", F.col("eid"))
    g = Graph(nodes.withColumn("label", F.lit("")).withColumn("aliases", F.lit(None).cast("array<string>")), edges.withColumn("triplet_source_id", F.lit(None).cast("string")))
    return hop_distances(g, [first], most_hops)
