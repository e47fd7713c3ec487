"""Graph operators on small graphs, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from evigraph import schemas as S
from evigraph.operators import answers, graph, maintain, names, paths, resolution
from evigraph.operators.components import components
from evigraph.operators.graph import Graph, QueryResult


def make(spark, nodes, edges):
    n = spark.createDataFrame([(i, label, name, aliases) for i, label, name, aliases in nodes], S.NODES)
    e = spark.createDataFrame([(a, r, b, c) for a, r, b, c in edges], S.EDGES)
    return Graph(n, e)


@pytest.fixture(scope="module")
def firms(spark):
    nodes = [("a", "COMPANY", "Acme", ["ACME CORP"]), ("b", "COMPANY", "Beta", None), ("c", "COMPANY", "Gamma", None), ("r", "RISK", "Supply chain", None), ("q", "RISK", "Acme", None), ("k", "Chunk", None, None), ("z", "COMPANY", "Alone", None)]
    edges = [("a", "HAS_SUBSIDIARY", "b", "k1"), ("a", "HAS_SUBSIDIARY", "c", "k2"), ("b", "COMPETES_WITH", "a", "k1"), ("a", "COMPETES_WITH", "c", "k1"), ("a", "FACES_RISK", "r", "k3"), ("b", "FACES_RISK", "r", "k3"), ("k", "MENTIONS", "a", None), ("c", "SELF", "c", None)]
    return make(spark, nodes, edges)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_templates(spark, firms):
    t = graph.templates()
    assert rows(t["subsidiaries_of"].run(firms, name="Acme")) == [("Beta", "k1"), ("Gamma", "k2")]
    assert rows(t["count_subsidiaries"].run(firms, name="Beta")) == [(0,)]
    assert rows(t["competitors_of"].run(firms, name="Acme")) == [("Beta",), ("Gamma",)]
    assert rows(t["companies_facing_risk"].run(firms, risk="SUPPLY")) == [("Acme",), ("Beta",)]
    assert rows(t["companies_facing_risk"].run(firms, risk="")) == [("Acme",), ("Beta",)]
    assert rows(t["compare_subsidiary_counts"].run(firms, names=["Acme", "Beta"])) == [("Acme", 2)]
    near = rows(t["neighbors"].run(firms, name="Gamma"))
    assert near == [("COMPETES_WITH", "Acme"), ("HAS_SUBSIDIARY", "Acme"), ("SELF", "Gamma")]  # a self-loop once
    assert ("MENTIONS", None) not in rows(t["neighbors"].run(firms, name="Acme"))


def test_paths(spark, firms):
    r = paths.path_between(firms, "Beta", "Gamma").collect()
    assert [(list(x["path"]), list(x["relations"])) for x in r] == [(["Beta", "Acme", "Gamma"], ["COMPETES_WITH", "COMPETES_WITH"])]
    assert paths.path_between(firms, "Beta", "Alone").collect() == []
    assert rows(paths.hop_distances(firms, ["Supply chain"]).where("eid IN ('r', 'a', 'c')")) == [("a", 1), ("c", 2), ("r", 0)]


def test_distances_are_symmetric(spark):
    rng = random.Random(5)
    nodes = [(str(i), "COMPANY", f"n{i}", None) for i in range(30)]
    edges = [(str(rng.randrange(30)), "ACQUIRED", str(rng.randrange(30)), None) for _ in range(28)]
    g = make(spark, nodes, edges)
    depth = {i: dict(map(tuple, paths.hop_distances(g, [f"n{i}"], 30).collect())) for i in (0, 7, 13)}
    for i in depth:
        for j in depth:
            assert depth[i].get(str(j)) == depth[j].get(str(i))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 560)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in linked}


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert components(none).collect() == []
    assert rows(components(none, spark.createDataFrame([(3,)], "eid long"))) == [(3, 3)]


def test_resolution_prefers_equal_names_then_aliases_then_short(spark, firms):
    asked = spark.createDataFrame([("acme",), ("Acme Corp",), ("gam",), ("what about Beta?",), ("nobody",)], "s string")
    got = {r["surface"]: r["name"] for r in names.resolve_entities(firms, asked).collect()}
    assert got == {"acme": "Acme", "Acme Corp": "Acme", "gam": "Gamma", "what about Beta?": "Beta"}
    stored = names.NameIndex.build(firms)
    again = names.NameIndex(spark, stored.path)
    assert {r["surface"]: r["name"] for r in names.resolve_entities(firms, asked, again).collect()} == got


def test_names_that_contain_one_another(spark):
    """Against all pairs: empty, short and long names and texts, letters beyond ASCII, repeats."""
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abAé 日") for _ in range(n))
    given = [text(r.randrange(0, 9)) for _ in range(150)] + ["", "a", "É", None]
    asked = [text(r.randrange(0, 14)) for _ in range(120)] + ["", "a", "zz", "Ab", None]
    nodes = spark.createDataFrame([(f"e{k}", "X", n, None) for k, n in enumerate(given)], "eid string, label string, name string, aliases array<string>")
    for known in (given, [n for n in given if n]):
        g = graph.Graph(nodes.where("true" if "" in known else "name <> ''"), None)
        want = {}
        for s in {a for a in asked if a is not None}:
            best = [(-3 if n.lower() == s.lower() else -1, len(n), n) for n in known if n is not None and (n.lower() in s.lower() or s.lower() in n.lower())]
            if best:
                want[s] = (min(best)[2], -min(best)[0])
        got = {x["surface"]: (x["name"], x["score"]) for x in names.resolve_entities(g, spark.createDataFrame([(a,) for a in asked], "s string")).collect()}
        assert got == want and len(want) > 50


def test_cleanup_merges_names_but_never_labels(spark):
    nodes = [("1", "COMPANY", "Acme", None), ("2", "COMPANY", "Acme Inc.", None), ("3", "PRODUCT", "Acme", None), ("4", "COMPANY", "AAPL", None), ("5", "COMPANY", "Inc.", None), ("6", "COMPANY", "The Group", None)]
    edges = [("1", "ACQUIRED", "2", "c2"), ("1", "OFFERS_PRODUCT", "3", "c9"), ("2", "OFFERS_PRODUCT", "3", "c1"), ("4", "ACQUIRED", "1", "c1")]
    g = maintain.cleanup(make(spark, nodes, edges))
    assert rows(g.nodes.select("eid", "name")) == [("2", "Acme Inc."), ("3", "Acme"), ("5", "Inc."), ("6", "The Group")]
    assert rows(g.edges) == [("2", "OFFERS_PRODUCT", "3", "c1")]
    merged = maintain.cleanup(make(spark, nodes, edges), keep_empty=True)
    assert rows(merged.nodes.where("label = 'COMPANY'").select("eid")) == [("2",), ("6",)]


def test_rewire_leaves_no_dangling_edge(spark):
    rng = random.Random(2)
    nodes = [(str(i), "COMPANY", f"Name{i % 12}" + (" Inc" if i % 2 else ""), None) for i in range(40)]
    edges = [(str(rng.randrange(40)), "ACQUIRED", str(rng.randrange(40)), f"c{k}") for k in range(120)]
    g = maintain.cleanup(make(spark, nodes, edges))
    ids = {r["eid"] for r in g.nodes.collect()}
    assert all(r["src"] in ids and r["dst"] in ids and r["src"] != r["dst"] for r in g.edges.collect())


def test_resolution_by_vectors_and_names(spark):
    rows_ = [("1", "COMPANY", "Acme", [1.0, 0.0]), ("2", "COMPANY", "ACME Ltd", [0.0, 1.0]), ("3", "COMPANY", "Akme", [0.99, 0.01]), ("4", "PERSON", "Akme", [1.0, 0.0]), ("5", "COMPANY", "Other", [-1.0, 0.0])]
    e = spark.createDataFrame(rows_, "eid string, label string, name string, embedding array<float>")
    plan = resolution.plan(e)
    assert rows(plan.select("eid", "survivor", "name", F.array_join("aliases", "|"))) == [(i, "2", "ACME Ltd", "ACME Ltd|Acme|Akme") for i in "123"]
    g = Graph(e.select("eid", "label", "name", F.lit(None).cast("array<string>").alias("aliases")), spark.createDataFrame([("5", "ACQUIRED", "3", "c")], S.EDGES))
    out = resolution.apply(g, plan)
    assert rows(out.nodes.select("eid", F.array_join("aliases", "|"))) == [("2", "ACME Ltd|Acme|Akme"), ("4", None), ("5", None)]
    assert rows(out.edges) == [("5", "ACQUIRED", "2", "c")]


def test_statements_and_evidence_graph():
    r = QueryResult("risks_of", [{"risk": "Supply", "_src": "c"}, {"risk": "Taxes", "_src": "c"}], {"name": "Acme"})
    assert answers.statements(r) == ["Acme discloses these risks: Supply, Taxes."]
    g = answers.evidence_graph(r)
    assert g["layout"] == "radial" and [e["tag"] for e in g["edges"]] == ["G1", "G1"] and {n["type"] for n in g["nodes"]} == {"COMPANY", "RISK"}
    p = QueryResult("path_between", [{"path": ["Export controls", "Acme"], "relations": ["FACES_RISK"]}], {"a": "Acme", "b": "Other"})
    g = answers.evidence_graph(p)
    assert g["layout"] == "path" and g["edges"][0]["source"] == "acme" and g["edges"][0]["tag"] == "G1"
    c = QueryResult("compare_subsidiary_counts", [{"company": "A", "count": 2}, {"company": "B", "count": 1}], {"names": ["A", "B"]})
    assert answers.evidence_graph(c)["metrics"][1] == {"label": "B", "value": 1, "tag": "G2"} and answers.evidence_graph(c)["layout"] == "none"
    b = QueryResult("companies_facing_risk", [{"company": "A"}, {"company": "B"}], {"risk": "tax"})
    assert answers.evidence_graph(b)["layout"] == "bipartite"
    assert answers.evidence_graph(None)["nodes"] == [] and answers.statements(QueryResult("risks_of", error="no")) == []


def test_generation_is_checked_and_stripped():
    sources = [{"tag": "G1", "text": "Acme has 2 subsidiaries."}]
    drafts = iter(["Acme has two whole subsidiaries now.", "Acme has two subsidiaries now [G7]."])
    out = answers.grounded("q", sources, lambda q, s, fault: next(drafts), retries=1)
    assert out == {"answer": "Acme has two subsidiaries now.", "attempts": 2, "citations_valid": False, "uncited_claims": []}
    told = []
    answers.grounded("q", sources, lambda q, s, fault: told.append(fault) or "Bare claim of five words", retries=1)
    assert told[0] is None and "Bare claim of five words" in told[1]


def test_tables_of_questions_are_checked_like_single_ones(spark):
    """Rounds over a table give what single questions give."""
    given = [("sound", [{"tag": "G1", "text": "a"}]), ("told", [{"tag": "G1", "text": "a"}, {"tag": "P1", "text": "b"}]), ("stubborn", [{"tag": "P1", "text": "x"}]), ("stubborn", [{"tag": "P1", "text": "x"}]), ("none", [])]

    def generate(question, sources, told):
        if question == "told":
            return "- Five words stand here now [G1].\n* Five words stand bare here" if told is None else "Five words stand here now [P1]." if "bare" in told else ""
        return {"sound": "It is so [G1].", "stubborn": "Five words with invented labels [G9] and [P1]. But five words cite nothing here:\nAnd five words cite nothing here.", "none": "No."}[question]

    asked = spark.createDataFrame(given, "question string, sources array<struct<tag:string,text:string>>").repartition(2)
    for retries in (0, 2):
        got = sorted(tuple(r) for r in answers.grounded_table(asked, generate, retries).collect())
        want = [answers.grounded(q, s, generate, retries) for q, s in given]
        assert got == sorted((q, w["answer"], w["attempts"], w["citations_valid"], w["uncited_claims"]) for (q, _), w in zip(given, want, strict=True))
    assert [w["attempts"] for w in want] == [1, 2, 3, 3, 1]


def test_lists_are_bounded_and_say_so(spark):
    rows = spark.createDataFrame([("a", f"v{k:02d}") for k in range(30)] + [("b", "x"), ("b", None), ("c", None)], "k string, v string").repartition(5)
    got = {r["k"]: r["statement"] for r in answers.verbalise_list(rows, "k", "v", "{} has:", most=3).collect()}
    assert got == {"a": "a has: v00, v01, v02, and 27 more.", "b": "b has: x."}
    lines = spark.createDataFrame([("q", f"G{k}", k, f"[G{k}] f") for k in range(1, 12)] + [("q", "P1", 1, "[P1] p"), ("r", "P1", 1, "it's")], "question string, tag string, ord int, line string")
    text = {r["question"]: r["context"] for r in answers.context(lines, "question", most=2).collect()}
    assert text == {"q": "GRAPH-DERIVED FACTS (from the knowledge graph):\n[G1] f\n[G2] f\n(and 9 more)\n\nRETRIEVED PASSAGES (from vector search):\n[P1] p", "r": "RETRIEVED PASSAGES (from vector search):\nit's"}


def test_paths_of_many_pairs(spark):
    """Against breadth-first search in loops: all pairs of a graph with hubs, parallel edges, loops and islands."""
    r = random.Random(9)
    ids = [f"n{k:02d}" for k in range(26)]
    links = [(r.choice(ids[:20]), r.choice("XY"), r.choice(ids[:20])) for _ in range(24)] + [("n00", "H", i) for i in ids[3:8]] + [("n22", "Z", "n23"), ("n24", "Z", "n24")]
    nodes = spark.createDataFrame([(i, "T", i.upper(), None) for i in ids], "eid string, label string, name string, aliases array<string>")
    g = Graph(nodes, spark.createDataFrame([(a, x, b, None) for a, x, b in links], S.EDGES))
    near, rel = {i: set() for i in ids}, {}
    for a, x, b in links:
        for u, v in ((a, b), (b, a)):
            near[u].add(v)
            rel[u, v] = min(rel.get((u, v), x), x)
    want = {}
    for b in ids:
        dist, front = {b: 0}, [b]
        for u in front:
            for v in near[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    front.append(v)
        for a in ids:
            if dist.get(a, 99) <= 4:
                path = [a]
                while path[-1] != b:
                    path.append(min(v for v in near[path[-1]] if dist.get(v) == dist[path[-1]] - 1))
                want[a, b] = (len(path) - 1, [p.upper() for p in path], [rel[p, q] for p, q in zip(path, path[1:], strict=False)])
    pairs = [(a, b) for a in ids for b in ids] + [("n01", "n02"), ("n01", "gone"), (None, "n01")]
    got = paths.paths_between(g, spark.createDataFrame(pairs, "a string, b string"), 4).collect()
    assert len(got) == len(want) and {(x["a"], x["b"]): (x["hops"], x["path"], x["relations"]) for x in got} == want
    assert max(w[0] for w in want.values()) == 4
    assert paths.paths_between(g, spark.createDataFrame([], "a string, b string")).count() == 0


def test_survivors_hold_the_names_of_a_component_once(spark, monkeypatch):
    """A row for each component; er_survivors takes these, so the names don't go to every member."""
    from evigraph.plans import registry

    e = spark.createDataFrame([(k, "v" * (k % 3 + 1) + str(k)) for k in range(200)] + [(500, "alone")], "eid long, name string")
    comp = e.select("eid", F.when(F.col("eid") < 200, 0).otherwise(F.col("eid")).cast("long").alias("component"))
    best = {r["component"]: r for r in resolution.component_survivors(e, comp).collect()}
    assert set(best) == {0, 500} and best[500]["members"] == 1 and best[0]["members"] == 200
    assert best[0]["survivor"] == 101 and best[0]["aliases"] == sorted("v" * (k % 3 + 1) + str(k) for k in range(200))

    def spread(entities, component):
        raise AssertionError("aliases beside each member")

    monkeypatch.setattr(resolution, "survivors", spread)
    assert registry.er_survivors(spark, "/root/testdata/sf0.001").count() > 0


def test_context_lists_all_facts_where_it_has_no_bound(spark):
    n = answers.MOST_LISTED + 20
    lines = spark.createDataFrame([("q", f"G{k}", k, f"[G{k}] f") for k in range(1, n + 1)], "question string, tag string, ord int, line string").repartition(3)
    said = answers.context(lines, "question", most=None).first()["context"].split("\n")
    assert said[1:] == [f"[G{k}] f" for k in range(1, n + 1)]
