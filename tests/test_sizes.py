"""Steps whose memory or traffic must not grow faster than their input."""

import pytest
from pyspark.sql import functions as F

from evigraph import schemas as S
from evigraph.operators import answers, graph, maintain, paths
from evigraph.operators.graph import Graph
from evigraph.plans import star_graph


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(spark):
    """A graph that Spark can't take for small: nodes 0 to 999,999, each with an edge to the next."""
    n = spark.range(1_000_000)
    eid = F.col("id").cast("string")
    nodes = n.select(eid.alias("eid"), F.lit("COMPANY").alias("label"), F.concat(F.lit("n"), eid).alias("name"), F.lit(None).cast("array<string>").alias("aliases"))
    edges = n.select(eid.alias("src"), F.lit("OWNS").alias("rel"), (F.col("id") + 1).cast("string").alias("dst"), F.lit("k").alias("triplet_source_id"))
    return Graph(nodes, edges)


def test_ends_are_attached_without_sorting_the_edges(spark, large):
    named = graph.attached(graph.attached(large.edges, large.nodes, "src", "s"), large.nodes, "dst", "t")
    moved = maintain.rewire(large.edges, large.nodes.select("eid", F.lit("0").alias("survivor"))).select("src", "rel", "dst")
    for df in (named, moved):
        assert "ShuffledHashJoin" in plan(df) and "SortMergeJoin" not in plan(df) and "Sort [" not in plan(df)


def test_graph_queries_do_not_sort_the_edges(spark):
    from evigraph.plans import registry

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for q in (registry.verbalize_rows, registry.triple_validation, registry.triples_view):
            assert "SortMergeJoin" not in plan(q(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_evidence_tells_an_end_once_before_it_is_sorted(spark):
    t = spark.createDataFrame([("Acme", "OWNS", "Beta"), ("Acme", "OWNS", "Gamma"), ("Beta", "RUNS", "acme"), ("Beta", "RUNS", None)], "source string, relation string, target string")
    df = answers.evidence_nodes(t, S.end_types(spark))
    assert plan(df).index("SortAggregate") < plan(df).index("HashAggregate")  # a plan lists its last step first
    assert sorted(map(tuple, df.where("label IS NOT NULL").collect())) == [("acme", "Acme", "COMPANY", "anchor"), ("beta", "Beta", "COMPANY", "anchor"), ("gamma", "Gamma", "COMPANY", "target")]


def test_source_hashes_move_as_bytes(spark):
    e = star_graph.edges(spark, "/root/testdata/sf0.001")
    assert "unhex" in plan(e)
    bad = e.where("NOT triplet_source_id RLIKE '^[0-9a-f]{40}$'")
    assert bad.isEmpty()


def test_few_anchors_are_sent_to_the_edges(spark, large):
    for df in (graph.undirected_hop(large, "n7", "OWNS", "x"), graph.neighbours(large, "n7"), graph.expand(large, large.anchors(["n7"]), "OWNS"), graph.out_hop(large, ["n7"], "OWNS", "x")):
        semi = [line for line in plan(df).splitlines() if "LeftSemi" in line]
        assert semi and all("BroadcastHashJoin" in line for line in semi)
    assert sorted(r[1] for r in graph.neighbours(large, "n7").collect()) == ["n6", "n8"]


def test_paths_take_the_edges_once(spark):
    """The edges may be a large job of their own."""
    rows = [("a", "R2", "b", None), ("a", "R1", "b", None), ("c", "R1", "b", None), ("c", "R3", "d", None), ("d", "R4", "d", None)]
    nodes = spark.createDataFrame([(x, "COMPANY", x.upper(), None) for x in "abcd"], S.NODES)
    pairs = spark.createDataFrame([("a", "d"), ("d", "b"), ("c", "c")], "a string, b string")
    for run, want in (
        (lambda g: paths.hop_distances(g, ["A"]).select("eid", "depth"), [("a", 0), ("b", 1), ("c", 2), ("d", 3)]),
        (lambda g: paths.path_between(g, "A", "D").select(F.array_join("path", ">"), F.array_join("relations", ">")), [("A>B>C>D", "R1>R1>R3")]),
        (lambda g: paths.paths_between(g, pairs).select("a", F.array_join("path", ">"), F.array_join("relations", ">")), [("a", "A>B>C>D", "R1>R1>R3"), ("c", "C", ""), ("d", "D>C>B", "R3>R1")]),
    ):
        seen = spark.sparkContext.accumulator(0)

        @F.udf("string")
        def told(x, seen=seen):
            seen.add(1)
            return x

        edges = spark.createDataFrame(rows, S.EDGES)
        g = Graph(nodes, edges.withColumn("rel", told.asNondeterministic()("rel")))
        assert sorted(map(tuple, run(g).collect())) == want
        assert seen.value <= len(rows)
