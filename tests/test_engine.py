"""Stores, routing, vectors, streams and the engine end to end."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.functions import text as X
from evigraph.operators import evaluate, routing, vectors
from evigraph.plans.engine import Engine
from evigraph.plans.providers import ExtractiveGenerator, HashEmbedder, PatternPlanner
from evigraph.sources import filings, stores
from evigraph.streaming import logs, rate_limit


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}")
    docs = [
        ("D1", "Acme Corp has subsidiary Beta Labs. Acme Corp has subsidiary Gamma Works. Acme Corp faces the risk Supply Shortage.", "D1", "Acme Corp"),
        ("D2", "Delta Inc has subsidiary Epsilon. Delta Inc faces the risk Supply Shortage. Delta Inc competes with Acme Corp.", "D2", "Delta Inc"),
    ]
    df = spark.createDataFrame(docs, "doc_id string, text string, ticker string, company string")
    assert e.ingest(df) == 2 and e.ingest(df) == 0  # known fingerprints are skipped
    assert e.index() == 2 and e.index() == 2
    return e


def test_count_question(engine):
    a = engine.ask("How many subsidiaries does Acme have?")
    assert a["path_used"] == "GRAPH" and a["graph_statements"] == ["Acme Corp has 2 subsidiaries recorded in the graph."]
    assert a["citations_valid"] and not a["uncited_claims"] and "[G1]" in a["answer"]


def test_list_path_and_reverse_questions(engine):
    assert engine.query_graph("What are the subsidiaries of Acme?").rows and engine.query_graph("Which companies face supply risk?").params == {"risk": "supply"}
    p = engine.query_graph("How is Beta Labs connected to Supply Shortage?")
    assert p.rows[0]["path"] == ["Beta Labs", "Acme Corp", "Supply Shortage"]


def test_unknown_questions_fail_closed(engine):
    r = engine.query_graph("Sing a song")
    assert r.rows == [] and r.error == "no such query type: none was named"
    r = engine.query_graph("Compare the subsidiaries of Zzz.")
    assert r.rows == [] and r.error.startswith("too few known entities for names")

    class Broken:
        def plan(self, q):
            raise ValueError("no model")

    broken = Engine(engine.spark, engine.path, planner=Broken())
    assert broken.query_graph("x").error == "planning failed: no model"


def test_hybrid_merges_and_logs(engine, spark):
    a = engine.ask("Tell me about Delta")
    assert a["path_used"].startswith("HYBRID") and any(s["tag"] == "P1" for s in a["sources"])
    log = stores.read_log(spark, f"{engine.path}/log")
    assert log.where("low_confidence").count() >= 1
    assert {r["path"] for r in evaluate.log_summary(log).collect()} >= {"HYBRID"}
    assert engine.baseline("Tell me about Delta").count("[P") == 2


def test_clean_keeps_the_graph_consistent(engine):
    engine.clean()
    g = engine.graph()
    ids = {r["eid"] for r in g.nodes.collect()}
    assert all(r["src"] in ids and r["dst"] in ids for r in g.edges.collect())


def test_reingest_replaces_chunks(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    row = "doc_id string, text string, ticker string, company string"
    e.ingest(spark.createDataFrame([("D", "w " * 1000, "D", "D")], row))
    assert e.graph().chunks.count() == 3
    e.ingest(spark.createDataFrame([("D", "short text", "D", "D")], row))
    assert [r["pos"] for r in e.graph().chunks.collect()] == [0]


def test_upsert_is_idempotent(spark, tmp_path):
    t = stores.KeyedTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([(1, "a")], "k int, v string").schema, ["k"])
    assert t.count() == 0
    new = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    t.upsert(spark.createDataFrame([(1, "a"), (3, "d")], "k int, v string"))
    t.upsert(new)
    t.upsert(new)
    assert sorted(map(tuple, t.read().collect())) == [(1, "b"), (2, "c"), (3, "d")]


def test_routing(spark):
    qs = ["How many firms?", "What is risk?", "What is the number of firms?", "Hello", "Who are Acme's suppliers", "Explain it"]
    d = spark.createDataFrame([(q,) for q in qs], "question string").select("question", routing.rule("question").alias("r")).collect()
    assert [r["r"] for r in d] == ["GRAPH", "VECTOR", "GRAPH", None, "GRAPH", None]
    failed = routing.decisions(spark.createDataFrame([("What is risk?",), ("Hello",)], "question string")).collect()
    # The rule alone sits at the threshold and isn't low; without one, both paths run.
    assert [(r["used"], r["confidence"], r["low_confidence"]) for r in failed] == [("VECTOR", 0.6, False), ("HYBRID", 0.0, True)]
    assert routing.snap("subsidiary_of", ["subsidiaries_of", "risks_of"]) == "subsidiaries_of" and routing.snap("zzz", ["risks_of"]) is None
    assert routing.display("($name)-[X]->()", {"name": 'a"b'}) == '("a\\"b")-[X]->()'


def test_planner():
    p = PatternPlanner().plan("Compare the subsidiaries of Apple and Microsoft.")
    assert p == {"query_type": "compare_subsidiary_counts", "entities": ["Apple", "Microsoft"], "value": ""}


def test_extractive_answers_pass_the_check():
    from evigraph.operators.answers import check_answer

    text = ExtractiveGenerator()("q", [{"tag": "G1", "text": "A has 2 subsidiaries in all."}, {"tag": "P1", "text": "First sentence is long here. Second."}])
    assert check_answer(text, {"G1", "P1"}) == ([], [])


def test_topk_and_index(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8))
    v = spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    got = vectors.topk_batch(v, v.where("vec_id % 20 = 0"), 5)
    for q in range(0, 300, 20):
        assert {r["vec_id"] for r in got.where(f"query_id = {q}").collect()} == set(np.argsort(-sims[q])[:5])
    ivf = vectors.IvfIndex(v, lists=8)
    full = ivf.topk_batch(v.where("vec_id % 20 = 0"), 5, probes=8)
    assert vectors.recall(full, got).first()["recall_micro"] == 1.0
    some = vectors.recall(ivf.topk_batch(v.where("vec_id % 20 = 0"), 5, probes=5), got).first()["recall_micro"]
    assert some >= 0.9
    one = ivf.topk([float(t) for t in x[3]], 3, probes=8).collect()
    assert one[0]["vec_id"] == 3
    pairs = vectors.similar_pairs(v, 0.8, block=64).collect()
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if sims[i, j] >= 0.8}
    assert {(r["a"], r["b"]) for r in pairs} == want and len(pairs) == len(want)


def test_topk_of_copies_takes_the_smallest_ids(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1200, 64)).astype(np.float32)
    kind = np.where(np.arange(1200) < 1003, 0, np.arange(1200))
    ids = rng.permutation(1200)
    v = spark.createDataFrame([(int(i), [float(t) for t in x[c]]) for i, c in zip(ids, kind, strict=True)], "vec_id long, embedding array<float>").coalesce(1)
    near = x[0] + 0.3 * rng.standard_normal((200, 64))
    q = spark.createDataFrame([(5000 + i, [float(t) for t in r]) for i, r in enumerate(near)], "vec_id long, embedding array<float>")
    copies = sorted(int(i) for i in ids[:1003])
    want = {5000 + i: copies[:5] for i in range(200)} | {c: [i for i in copies if i != c][:5] for c in copies[:8]}
    got = {}
    for r in vectors.topk_batch(v, q.unionByName(v.where(F.col("vec_id").isin(copies[:8]))), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == want


def test_similar_pairs_in_groups_with_copies(spark):
    """Against brute force: clustered vectors in groups, copies, zero and null ones, small blocks."""
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((9, 12))
    x = centre[rng.integers(0, 9, 240)] + 0.35 * rng.standard_normal((240, 12))
    x[100:140], x[140] = x[99], 0
    grp = rng.integers(0, 2, 240)
    grp[99:140] = 1
    rows = [(i, ["g", None][grp[i]], [float(t) for t in x[i]] if i != 141 else None) for i in range(240)]
    v = spark.createDataFrame(rows, "vec_id long, g string, embedding array<double>").repartition(3)
    got = vectors.similar_pairs(v, 0.9, "g", block=16).collect()
    keep = [i for i in range(240) if i not in (140, 141) and not 100 <= i < 140]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = {(i, j) for i in keep for j in keep if i < j and grp[i] == grp[j] and unit[i] @ unit[j] >= 0.9} | {(99, i) for i in range(100, 140)}
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want and len(want) > 300
    assert vectors.similar_pairs(v.limit(0), 0.9).count() == 0


def test_index_recall_on_the_tables(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    gold = vectors.topk_batch(v, v.where("vec_id % 20 = 0"))
    built = vectors.IvfIndex(v, path=f"file://{tmp_path}/ivf")
    again = vectors.IvfIndex.open(spark, f"file://{tmp_path}/ivf")
    assert (again.centroids == built.centroids).all() and again.probes == built.probes and again.recall >= 0.93
    assert vectors.recall(again.topk_batch(v.where("vec_id % 20 = 0")), gold).first()["recall_micro"] >= 0.9
    names = v.select(F.concat(F.lit("n"), "vec_id").alias("vec_id"), "embedding")
    one = vectors.IvfIndex(names, calibrate=32)
    q = v.where("vec_id = 3").first()["embedding"]
    assert one.topk(list(q), 1).first()["vec_id"] == "n3"
    read = one.topk(list(q), 1, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "(list#" in read and "PushedFilters: []" in read  # the list prunes files


def test_clustered_vectors_need_few_lists(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((40, 16))
    x = centre[np.arange(1600) % 40] + 0.1 * rng.standard_normal((1600, 16))
    v = spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    ivf = vectors.IvfIndex(v)
    assert ivf.lists == 40 and ivf.probes <= 4
    queries = v.where("vec_id % 20 = 0")
    assert vectors.recall(ivf.topk_batch(queries), vectors.topk_batch(v, queries)).first()["recall_micro"] >= 0.9


def test_rate_limit(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    hits = [(i, u, at + dt.timedelta(seconds=s)) for i, (u, s) in enumerate([(1, 0), (1, 10), (1, 20), (1, 59), (1, 60), (1, 61), (1, 69), (2, 5), (1, 130)])]
    df = spark.createDataFrame(hits, "event_id long, user_id long, ts timestamp")
    want = {0: True, 1: True, 2: False, 3: False, 4: True, 5: False, 6: False, 7: True, 8: True}
    assert {r["event_id"]: r["accepted"] for r in rate_limit.exact(df, 2).collect()} == want
    counts = {r["event_id"]: r["n_window"] for r in rate_limit.window_counts(df).collect()}
    assert counts[3] == 4 and counts[7] == 1
    df.where("event_id < 5").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.where("event_id >= 5").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = rate_limit.streaming(s, 2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(60), "the stream ends by itself"
    assert {r["event_id"]: r["accepted"] for r in spark.table("limited").collect()} == want


def test_late_hits_count_those_before_them(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    for k, seconds in enumerate([(100, 101), (50, 102)]):
        rows = [(10 * k + i, 1, at + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]
        spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = rate_limit.streaming(s, 2, late="10 minutes").writeStream.format("memory").queryName("late_hits").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {r["event_id"]: r["accepted"] for r in spark.table("late_hits").collect()}
    assert got == {0: True, 1: True, 10: True, 11: False}


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    days = F.dayofyear("ts")
    for k in range(3):  # files come in the order of their times
        e.where((days > 10 * k) & (days <= (10 * k + 10 if k < 2 else 400))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = logs.start_counts(logs.tumbling_counts(s, late="2 days"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(180)
    assert q.exception() is None
    got = {(r["window_start"], r["event_type"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {(r["window_start"], r["event_type"]): r["n"] for r in logs.tumbling_counts(e).collect()}
    # Windows that the watermark has passed are out, and none differs from the batch.
    assert got and all(batch[k] == n for k, n in got.items())


def test_incremental_ingest_skips_known(spark, tmp_path):
    docs = spark.createDataFrame([("h1", "T", "C", "x"), ("h1", "T", "C", "x"), ("h2", "U", "D", "y")], "content_hash string, ticker string, company string, text string")
    docs.write.parquet(f"{tmp_path}/in")
    table, seen = stores.manifest(spark, f"file://{tmp_path}/m"), []
    for k in range(2):
        s = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
        logs.ingest_new(s, table, f"{tmp_path}/cp{k}", lambda df: seen.append(df.count())).awaitTermination(120)
    assert seen == [2, 0] and table.count() == 2


def test_streamed_and_batch_ingest_take_the_same_documents(spark, tmp_path):
    """Of equal texts both take the smallest doc_id, in whatever order rows come; null texts are left out."""
    rows = [(f"d{k}", None if k % 9 == 0 else f"text {k % 4}", f"T{k % 3}", f"C{k % 2}") for k in range(40)]
    names = ["doc_id", "text", "ticker", "company"]
    want = {}
    for r in rows:
        if r[1] is not None:
            want[r[1]] = min(want.get(r[1], r), r)
    for k in range(3):
        random.Random(k).shuffle(rows)
        docs = spark.createDataFrame(rows, names).repartition(1 + k).withColumn("content_hash", X.fingerprint("text"))
        docs.write.parquet(f"{tmp_path}/in{k}")
        table, seen = stores.manifest(spark, f"file://{tmp_path}/m{k}"), []
        s = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in{k}")
        logs.ingest_new(s, table, f"{tmp_path}/c{k}", lambda df, seen=seen: seen.extend(map(tuple, df.select(*names).collect()))).awaitTermination(120)
        assert sorted(seen) == sorted(want.values())
        assert {(r["ticker"], r["company"]) for r in table.read().collect()} == {(r[2], r[3]) for r in want.values()} and table.count() == len(want)
        assert sorted(tuple(r) for r in stores.firsts(docs, names).select(*names).collect()) == sorted(want.values())


def test_filings(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"0": {"cik_str": 7, "ticker": "ABC", "title": "Abc"}, "1": {"cik_str": 9, "ticker": "XYZ", "title": "Xyz"}}')
    t = filings.ticker_ids(spark, f"file://{tmp_path}/t.json")
    assert filings.ticker_to_id(t, "abc") == 7
    with pytest.raises(LookupError):
        filings.ticker_to_id(t, "none")
    f = spark.createDataFrame([("c", ["8-K", "10-K", "10-K"], ["1-1", "2-2", "3-3"], ["a", "b", "c"])], "k string, form array<string>, accessionNumber array<string>, primaryDocument array<string>")
    assert tuple(filings.latest_of_form(f, "k", "10-K").first()) == ("c", "22", "b")
    d = spark.createDataFrame([("x", "Item 1. Ours Item 1A. Risks Item 1. Our much longer business Item 2. Other"), ("y", "nothing here")], "doc_id string, text string")
    got = {r["doc_id"]: r["text"] for r in filings.filing_text(d, 8000).collect()}
    assert got == {"x": "Item 1. Our much longer business\n\nItem 1A. Risks", "y": "nothing here"}


def test_scoring_and_published_numbers(spark):
    r = [("It has 7 units", "number", ["7"]), ("It has 17", "number", ["7"]), ("I don't have data", "refuse", []), ("Big APPLE", "contains_any", ["apple", "x"]), ("apple", "contains_all", ["apple", "x"]), (None, "number", ["1"])]
    df = spark.createDataFrame(r, "a string, k string, v array<string>")
    assert [x["s"] for x in df.select(evaluate.score("a", "k", "v").alias("s")).collect()] == [True, False, True, True, False, False]
    p = evaluate.published(spark)
    t = p.agg(F.sum("n").alias("n"), F.sum(F.round(F.col("ours_accuracy") * F.col("n"))).alias("o"), F.sum(F.round(F.col("vanilla_accuracy") * F.col("n"))).alias("v")).first()
    assert (t["n"], t["o"], t["v"]) == (36, 28, 20)
    assert [evaluate.gate(0, 1, False), evaluate.gate(2, 1, True), evaluate.gate(1, 1, False), evaluate.gate(1, 1, True)] == ["pass", "block", "hold", "pass"]


def test_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("single_hop", True, False), ("single_hop", False, False)], "cat string, ours boolean, vanilla boolean")
    stores.write_results(rows, {"ours_median_s": 1.5}, f"file://{tmp_path}/r")
    back, summary = stores.read_results(spark, f"file://{tmp_path}/r", "cat string, ours boolean, vanilla boolean")
    assert summary == {"ours_median_s": 1.5} and evaluate.accuracy_overall(back).first()["ours_accuracy"] == 0.5


def test_embedder_is_deterministic_and_unit():
    a = HashEmbedder().embed(["supply chain risk", "", "supply chain risk"])
    assert np.array_equal(a[0], a[2]) and np.isclose(np.linalg.norm(a[0]), 1) and not a[1].any()


def test_accounts(spark, tmp_path):
    from evigraph.sources import accounts

    table = accounts.accounts(spark, f"file://{tmp_path}/accounts")
    at = dt.datetime(2024, 1, 1)
    rows = [("a@x", "A", "pending", "user", at, None, None, True, at), ("b@x", "B", "approved", "user", at + dt.timedelta(1), at, "z", True, at)]
    table.upsert(spark.createDataFrame(rows, table.schema))
    who = spark.createDataFrame([("A@x",), ("none@x",)], "email string")
    table.upsert(accounts.decided(table.read(), who, "approved", "boss", F.lit(at)))
    assert {r["email"] for r in accounts.subscribers(table.read()).collect()} == {"a@x", "b@x"}
    table.upsert(accounts.promoted(table.read(), who, F.lit(at)))
    got = {r["email"]: (r["role"], r["decided_by"]) for r in accounts.by_status(table.read(), "approved").collect()}
    assert got == {"a@x": ("admin", "boss"), "b@x": ("user", "z")} and table.count() == 2
    with pytest.raises(ValueError):
        accounts.decided(table.read(), who, "gone", "boss", F.lit(at))


def test_texts_are_fetched_once(spark, tmp_path):
    calls = []
    get = lambda url: calls.append(url) or "a text, ü".encode()
    for _ in range(2):
        assert filings.read_through(spark, f"file://{tmp_path}/kept/t.txt", "http://x/y", get) == "a text, ü"
    assert calls == ["http://x/y"]


def test_replies_of_models():
    from evigraph.plans.providers import ReplyClassifier, ReplyPlanner

    said = lambda text: lambda _: text
    assert ReplyClassifier(said('ok {"path": "graph", "confidence": 0.9}')).classify("q") == ("GRAPH", 0.9)
    assert ReplyClassifier(said('{"path": "hybrid"}')).classify("q") == ("HYBRID", 0.5)
    assert all(ReplyClassifier(said(t)).classify("q") is None for t in ("", "no", '{"path": "x"}', '{"path": "graph", "confidence": "high"}', "[1]"))
    plan = ReplyPlanner(said('{"query_type": "risks_of", "entities": "Acme", "value": null}')).plan("q")
    assert plan == {"query_type": "risks_of", "entities": ["Acme"], "value": ""}
    with pytest.raises(ValueError):
        ReplyPlanner(said("nothing")).plan("q")


def test_answers_are_plain_json(engine):
    import json

    r = engine.respond("How many subsidiaries does Acme have?")
    assert json.loads(json.dumps(r)) == r and r["path"] == "GRAPH" and r["cited"] == ["G1"] and r["sources"][0]["kind"] == "graph"
    a = engine.ask("Tell me about Delta", log=False)
    assert json.loads(json.dumps(a)) == a and a["vector_hits"][0]["filing_date"] is None
    shaped = engine.respond("Tell me about Delta", log=False)
    assert shaped["path"] == "HYBRID" and shaped["passages"][0]["tag"] == "P1" and not shaped["demo"]
