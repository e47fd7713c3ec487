"""The evaluation runners on small fixtures."""

import numpy as np
import pytest

from evigraph.plans import benchmark
from evigraph.plans.engine import Engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('bench')}")
    docs = [("D1", "Acme Corp has subsidiary Beta Labs. Acme Corp has subsidiary Gamma Works. Acme Corp faces the risk Supply Shortage.", "D1", "Acme Corp")]
    e.ingest(spark.createDataFrame(docs, "doc_id string, text string, ticker string, company string"))
    e.index()
    return e


def test_run_scores_both_and_records(engine, tmp_path):
    items = [(1, "aggregation", "How many subsidiaries does Acme have?", "number", ["2"]), (2, "single_hop", "What is the risk of Acme?", "contains_any", ["acme"]), (3, "out_of_scope", "How many goals were scored?", "refuse", [])]
    rows, by, overall = benchmark.run(engine, items, f"file://{tmp_path}/r")
    got = {r["id"]: (r["ours"], r["vanilla"]) for r in rows.collect()}
    assert got[1] == (True, False) and got[3][0] is True
    assert overall.first()["n"] == 3 and by.count() == 3
    again = {r["cat"]: r["ours_accuracy"] for r in benchmark.summary(engine, f"file://{tmp_path}/r").collect()}
    assert again["aggregation"] == 1.0 and benchmark.summary(engine, None).count() == 5


def test_routing_check(spark):
    q = spark.createDataFrame([("How many firms are there?", ["GRAPH"]), ("What is a segment?", ["VECTOR"]), ("Anything else", ["GRAPH", "HYBRID"]), ("What is it?", ["GRAPH"])], "question string, expected array<string>")
    confusion, accuracy = benchmark.routing_check(q)
    assert accuracy.first()["hits"] == 3
    assert {(r["expected"], r["used"], r["n"], r["ok"]) for r in confusion.collect()} == {("GRAPH", "GRAPH", 1, True), ("VECTOR", "VECTOR", 1, True), ("GRAPH/HYBRID", "HYBRID", 1, True), ("GRAPH", "VECTOR", 1, False)}


def test_effort_sweep_reaches_exact_with_all_lists(spark):
    x = np.random.default_rng(1).standard_normal((120, 6))
    v = spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    q = v.where("vec_id < 10")
    gold = spark.createDataFrame([(i, i + 1) for i in range(10)], "query_id long, vec_id long")
    r = {x["probes"]: x for x in benchmark.effort_sweep(v, q, gold, [1, 6], lists=6).collect()}
    assert r[6]["ann_recall"] == 1.0 and r[1]["ann_recall"] <= 1.0 and 0 <= r[6]["recall_at_1"] <= 1
