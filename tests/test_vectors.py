"""Similarity joins that prune, and batch top-k in blocks, against loops."""

import math

import numpy as np
import pytest

from evigraph.operators import resolution, vectors
from evigraph.plans import registry

DATA = "/root/testdata/sf0.1"


def table(spark, x, groups=None):
    rows = [(k, [float(c) for c in v], None if groups is None else groups[k]) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, g string")


def brute(x, threshold, groups=None):
    u = [np.array(v) / (np.linalg.norm(v) or 1) for v in x]
    out = {}
    for a in range(len(x)):
        for b in range(a + 1, len(x)):
            s = float(u[a] @ u[b])
            if s >= threshold and np.any(u[a]) and np.any(u[b]) and (groups is None or groups[a] == groups[b]):
                out[a, b] = s
    return out


def clustered(seed, n, d, k):
    r = np.random.default_rng(seed)
    return (r.normal(size=(k, d)) * 3)[r.integers(0, k, n)] + r.normal(size=(n, d))


@pytest.mark.parametrize(("block", "threshold"), [(8192, 0.8), (16, 0.8), (16, 0.95), (40, 0.3)])
def test_pairs_equal_loops(spark, block, threshold):
    """One block and many, in groups, with zero rows; copies link with their first only."""
    x = np.concatenate([clustered(3, 150, 12, 6), np.zeros((2, 12))])
    groups = ["a" if k % 3 else None for k in range(len(x))]
    for g in (None, groups):
        got = vectors.similar_pairs(table(spark, x, groups), threshold, None if g is None else "g", block=block).collect()
        want = brute(x, threshold, g)
        assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == set(want)
        assert all(math.isclose(r["similarity"], want[r["a"], r["b"]], abs_tol=1e-9) for r in got)


def test_boxes_keep_far_clusters_apart(spark):
    """Blocks of far clusters don't meet, and few pairs inside blocks are worked out whole."""
    x = clustered(5, 600, 24, 12)
    row = vectors.pairs_met(table(spark, x), 0.9, block=64).first()
    assert (row["vectors"], row["pairs"], row["links"]) == (600, 600 * 599 // 2, len(brute(x, 0.9)))
    assert row["links"] <= row["met"] < 0.2 * row["pairs"]


def test_less_than_a_tenth_is_worked_out_on_the_given_vectors(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    for threshold in (0.37, 0.8, 0.9):
        row = vectors.pairs_met(v, threshold).first()
        assert row["pairs"] == 2000 * 1999 // 2 and row["links"] <= row["met"] < 0.1 * row["pairs"], row


def test_uneven_and_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 2.0]), (5, []), (6, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["a"], r["b"]) for r in vectors.similar_pairs(v, 0.9).collect()}
    assert {(1, 2), (3, 4)} <= got and not any(5 in p or 6 in p for p in got)


@pytest.mark.parametrize(("block", "rows"), [(4096, 65536), (7, 50)])
def test_topk_in_blocks_equals_loops(spark, block, rows):
    """Queries of one block are sent; those of many meet every block of vectors."""
    x = np.round(clustered(8, 220, 6, 5), 1)
    v = table(spark, x).repartition(3)
    got = vectors.topk_batch(v, v.where("vec_id % 5 = 0"), 4, block=block, rows=rows).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 220, 5):
        order = sorted((-round(float(u[q] @ u[k]), 12), k) for k in range(220) if k != q)[:4]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [k for _, k in order]
    assert vectors.topk_batch(v, v.limit(0), 4).count() == 0 and vectors.topk_batch(v.limit(0), v, 4, block=block).count() == 0


def _reach(pairs, n):
    root = list(range(n))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(n)]


@pytest.mark.parametrize(("block", "threshold"), [(8192, 0.8), (24, 0.8), (24, 0.95)])
def test_stars_have_the_components_of_all_pairs(spark, block, threshold):
    """In groups of near copies there are about as many links as vectors, not as pairs; no end is lost."""
    x = np.concatenate([clustered(3, 150, 12, 4), np.repeat(clustered(4, 3, 12, 3), 60, axis=0) + np.random.default_rng(1).normal(size=(180, 12)) * 1e-3])
    got = [(r["a"], r["b"]) for r in vectors.similar_links(table(spark, x), threshold, block=block).collect()]
    want = brute(x, threshold)
    assert _reach(got, len(x)) == _reach(want, len(x)) and {i for p in got for i in p} == {i for p in want for i in p}
    if block > len(x):
        assert len(got) < len(x) < len(want) / 10


def test_single_precision_keeps_pairs_at_the_threshold():
    """Pairs that lie within single precision of the threshold are judged in double precision."""
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = vectors._Rotation(x, 40, 1)
    s = (x[:, None, :] * x[None, :, :]).sum(axis=2)
    for threshold in np.sort(s[np.triu_indices(300, 1)])[[-1, -7, -200, -2000]]:
        i, j, sims, met = vectors._near(x, x, turn.of(x), turn.of(x), threshold)
        assert set(zip(i, j, strict=True)) == set(zip(*np.nonzero(s >= threshold), strict=True)) and met >= len(i)
        assert (sims == s[i, j]).all()


def test_an_index_chooses_lists_in_steps(spark, monkeypatch):
    """The lists of a batch of queries are sorted some queries at a time, with the same answer."""
    x = clustered(6, 400, 8, 5)
    v = table(spark, x)
    q = v.where("vec_id % 4 = 0").coalesce(1)
    ivf = vectors.IvfIndex(v, lists=20)
    monkeypatch.setattr(vectors, "CHOICES", 60)
    row = vectors.recall(ivf.topk_batch(q, probes=20), vectors.topk_batch(v, q)).first()
    assert (row["queries"], row["hits"], row["gold"]) == (100, 500, 500)


def _sql(con, name, folder):
    con.execute(f"create or replace view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    return sorted(con.sql(registry.SQL[name]).fetchall())


@pytest.mark.parametrize("copies", [1024, 3])
def test_near_matches_have_the_pairs_of_all_copies(spark, tmp_path, monkeypatch, copies):
    """Copies, rows and ids twice, rows without id or vector, zero and odd numbers, many copies in parts: the rows of the SQL."""
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(vectors, "COPIES", copies)
    x = np.random.default_rng(11).normal(size=(60, 8)).round(2)
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    rows += [(100 + k, x[27].tolist()) for k in range(10)] + [(-k, x[7].tolist()) for k in range(1, 8)] + rows[20:24]
    rows += [(k + 1, x[k].tolist()) for k in range(30, 34)] + [(None, x[9].tolist()), (None, (x[9] + 0.01).tolist()), (200, None)]
    rows += [(210 + k, [0.0] * 8) for k in range(2)] + [(220 + k, [float("nan"), *x[3, 1:].tolist()]) for k in range(2)] + [(230, [float("inf"), *x[3, 1:].tolist()])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["er_near_matches"](spark, str(tmp_path)).select("a", "b", "similarity").collect())
    want = _sql(duckdb.connect(), "er_near_matches", tmp_path)
    assert got == want and {(a, b) for a in (*range(-7, 0), 7) for b in (27, *range(100, 110))} <= {(a, b) for a, b, _ in want}
    assert len(set(want)) < len(want)  # rows that are there twice


def test_pairs_at_the_threshold_are_judged_as_in_sql(spark, tmp_path):
    """Whole numbers give cosines of just 0.4, whose last bit decides."""
    duckdb = pytest.importorskip("duckdb")
    r = range(-4, 5)
    x = [(a, b, c, d) for a in r for b in r for c in r for d in r if a * a + b * b + c * c + d * d in (9, 25)]
    spark.createDataFrame([(k, [float(t) for t in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = _sql(duckdb.connect(), "er_near_matches", tmp_path)
    assert sorted(tuple(r) for r in registry.QUERIES["er_near_matches"](spark, str(tmp_path)).select("a", "b", "similarity").collect()) == want
    v = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    exact = {(i, j) for i, p in enumerate(x) for j in range(i + 1, len(x)) if (dot := sum(map(int.__mul__, p, x[j]))) > 0 and 25 * dot * dot == 4 * sum(map(int.__mul__, p, p)) * sum(map(int.__mul__, x[j], x[j]))}
    assert len(exact) > 100 and exact <= {(r["a"], r["b"]) for r in vectors.similar_pairs(v, 0.4).collect()}


def test_near_matches_of_copies_with_themselves(spark):
    """Where 1 is in the band, copies come out together; so do vectors whose squares pass doubles."""
    x = [[3.0, 4.0]] * 3 + [[6e-200, 8e-200], [3e200, 4e200], [0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [float("nan"), 1.0], [float("nan"), 1.0]]
    got = sorted((r["a"], r["b"]) for r in resolution.near_matches(table(spark, x), 1.05, 0.1).collect())
    assert got == [(a, b) for a in range(5) for b in range(a + 1, 5)]
    assert {(r["a"], r["b"]) for r in resolution.near_matches(table(spark, x, ["p", "q", "p", *"rstuvwx"]), 1.05, 0.1, "g").collect()} == {(0, 2)}
    assert resolution.near_matches(table(spark, x).limit(0), 0.9).count() == 0
