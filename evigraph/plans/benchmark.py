"""Running labelled questions: answers against a baseline, routing, retrieval effort."""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import evaluate, routing, vectors
from evigraph.plans.engine import Engine
from evigraph.sources import stores

ROWS = "id long, cat string, q string, kind string, want array<string>, ours_ans string, van_ans string, ours_lat double, van_lat double"


def run(engine: Engine, items: Iterable[tuple[int, str, str, str, Sequence[str]]], path: str | None = None, only: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, by category, overall) of items (id, category, question, kind, values) (K1).

    Each question is answered by the engine and by passages alone, scored and timed; the
    rows and the median latencies are recorded at ``path``. only: the numbers of a
    subset, for a short run.
    """
    rows = []
    for number, cat, q, kind, want in items:
        if only is not None and number not in only:
            continue
        t0 = time.perf_counter()
        ours = engine.ask(q, log=False)["answer"]
        t1 = time.perf_counter()
        other = engine.baseline(q)
        rows.append((number, cat, q, kind, list(want), ours, other, t1 - t0, time.perf_counter() - t1))
    df = engine.spark.createDataFrame(rows, ROWS)
    df = df.withColumns({"ours": evaluate.score("ours_ans", "kind", "want"), "vanilla": evaluate.score("van_ans", "kind", "want")})
    if path:
        m = df.agg(evaluate.upper_median("ours_lat").alias("o"), evaluate.upper_median("van_lat").alias("v")).first()
        stores.write_results(df, {"ours_median_s": m["o"] and round(m["o"], 1), "van_median_s": m["v"] and round(m["v"], 1), "n": len(rows)}, path)
    return df, evaluate.accuracy_by_category(df), evaluate.accuracy_overall(df)


def summary(engine: Engine, path: str | None) -> DataFrame:
    """(cat, ours_accuracy, vanilla_accuracy, n) of the recorded run, else the published ones (K2)."""
    if path is None:
        return evaluate.published(engine.spark)
    rows, _ = stores.read_results(engine.spark, path, ROWS + ", ours boolean, vanilla boolean")
    return evaluate.accuracy_by_category(rows).select("cat", "ours_accuracy", "vanilla_accuracy", "n")


def routing_check(questions: DataFrame, classifier_path: str | None = None, classifier_conf: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(confusion, accuracy) of questions (question, expected array) (K4)."""
    used = routing.decisions(questions, "question", classifier_path, classifier_conf)
    return evaluate.confusion(used), evaluate.routing_accuracy(used)


def effort_sweep(table: DataFrame, queries: DataFrame, gold: DataFrame, probes: Sequence[int], k: int = 5, **index: object) -> DataFrame:
    """Recall against labelled ids and against the exact answer for each effort (K3).

    ``gold`` is (query_id, vec_id). Columns: probes, recall (labelled), ann_recall (exact),
    recall_at_1 (share of queries whose first hit is labelled).
    """
    ivf, exact = vectors.IvfIndex(table, **index), vectors.topk_batch(table, queries, k)
    out = None
    for n in probes:
        found = ivf.topk_batch(queries, k, n)
        labelled = vectors.recall(found, gold).select(F.col("recall_micro").alias("recall"))
        ann = vectors.recall(found, exact).select(F.col("recall_micro").alias("ann_recall"))
        first = found.where("rank = 1").join(gold, ["query_id", "vec_id"], "left_semi").select("query_id").distinct()
        n_queries = gold.select("query_id").distinct()
        one = n_queries.join(first.withColumn("hit", F.lit(1)), "query_id", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall_at_1"))
        row = labelled.crossJoin(ann).crossJoin(one).withColumn("probes", F.lit(n))  # one row each
        out = row if out is None else out.unionByName(row)
    return out.select("probes", "recall", "ann_recall", "recall_at_1")
