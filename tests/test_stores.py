"""Keyed tables: buckets that follow the rows, upserts that write what they bring, versions that are whole."""

import random
from pathlib import Path

import pytest

from evigraph.sources import stores

KV = "k int, v string"


def table(spark, tmp_path, **more):
    return stores.KeyedTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], KV).schema, ["k"], **more)


def frame(spark, rows):
    return spark.createDataFrame(rows, KV)


def held(t, version=None):
    return sorted((tuple(r) for r in t.read(version).collect()), key=str)


def test_linear_hashing(spark):
    """Under more buckets a row stays or moves to a new one, and only out of those that split."""
    keys = spark.range(3000)
    for n, more in ((1, 2), (3, 4), (3, 5), (5, 6), (4, 8), (5, 17), (7, 100)):
        moved = keys.select(stores.bucket_of(["id"], n).alias("a"), stores.bucket_of(["id"], more).alias("b")).distinct().collect()
        split = stores.splitting(n, more)
        assert all(0 <= r["a"] < n and 0 <= r["b"] < more for r in moved)
        assert all(r["a"] == r["b"] if r["a"] not in split else r["b"] == r["a"] or r["b"] >= n for r in moved)
        assert {r["b"] for r in moved} == set(range(more))


def test_buckets_follow_the_rows(spark, tmp_path):
    t = table(spark, tmp_path, bucket_rows=50)
    t.upsert(frame(spark, [(k, "a") for k in range(100)]))
    assert t.state().buckets == 2
    t.upsert(frame(spark, [(k, "b") for k in range(50, 10_000)]))
    assert t.state().buckets == 200 and t.state().deltas == []
    assert held(t) == sorted(((k, "a" if k < 50 else "b") for k in range(10_000)), key=str)
    t.upsert(frame(spark, [(k, "c") for k in range(10_000, 12_600)]))
    before = t._base(t.state(t.version() - 1))
    after = t._base(t.state())
    assert t.state().buckets == 252 and t.count() == 12_600 and len(before) == 200 and len(after) == 252


def test_a_split_leaves_other_buckets_where_they_are(spark, tmp_path):
    t = table(spark, tmp_path, bucket_rows=100)
    t.upsert(frame(spark, [(k, "a") for k in range(1000)]))
    before = t._base(t.state())
    t.bucket_rows = 80  # 13 buckets in place of 10
    t.compact()
    after = t._base(t.state())
    split = stores.splitting(10, 13)
    assert len(split) == 3 and all((before[k] == after[k]) == (k not in split) for k in before) and len(after) == 13
    assert t.count() == 1000


def test_an_upsert_of_one_row_writes_kilobytes(spark, tmp_path):
    t = table(spark, tmp_path, bucket_rows=10_000)
    t.replace(frame(spark, [(k, str(k) * 9) for k in range(40_000)]))
    files = lambda: {p: p.stat().st_size for p in Path(tmp_path, "t").rglob("*") if p.is_file()}
    before = files()
    t.upsert(frame(spark, [(7, "b")]), gone=frame(spark, [(8, "")]))
    new = {p: s for p, s in files().items() if p not in before}
    assert sum(new.values()) < 16_384 and sum(before.values()) > 200_000
    assert len(t.state().deltas) == 1 and t.count() == 39_999 and t.read().where("k = 7").first()["v"] == "b"


def test_repeated_and_null_keys_have_one_row(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(frame(spark, [(1, "c"), (1, "b"), (None, "y"), (None, "x"), (2, None), (2, "a")]))
    assert held(t) == [(1, "b"), (2, None), (None, "x")]
    t.upsert(frame(spark, [(None, "w"), (None, "z"), (1, "q"), (1, "q")]))
    assert held(t) == [(1, "q"), (2, None), (None, "w")]
    old = frame(spark, [(1, "a"), (None, "n"), (5, "e")])
    assert sorted(map(tuple, stores.upsert(old, frame(spark, [(1, "d"), (1, "b"), (None, "m")]), ["k"]).collect()), key=str) == [(1, "b"), (5, "e"), (None, "m")]


def test_many_upserts_equal_a_dictionary(spark, tmp_path):
    """Rows put in, replaced and taken out, over foldings."""
    r, t, want = random.Random(2), table(spark, tmp_path, bucket_rows=40), {}
    folded = 0
    for step in range(12):
        put = {r.randrange(120): f"{step}" for _ in range(60 if step < 2 else 4)}
        out = [r.randrange(120) for _ in range(3)]
        t.upsert(frame(spark, list(put.items())), gone=frame(spark, [(k, "") for k in out]))
        want = {k: v for k, v in want.items() if k not in out} | put
        folded += not t.state().gone
        if step % 4 == 3:
            assert held(t) == sorted(want.items(), key=str)
    assert held(t) == sorted(want.items(), key=str) and 0 < folded < 12


def test_versions_are_whole(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(frame(spark, [(k, "a") for k in range(100)]))
    first = t.version()
    reader = t.read()  # begun before the next versions, read after them
    t.upsert(frame(spark, [(7, "b")]))
    assert held(t, first) == sorted(((k, "a") for k in range(100)), key=str) == sorted((tuple(r) for r in reader.collect()), key=str)
    with pytest.raises(stores.WrittenMeanwhile):  # of two writers that began with one version the second fails
        t._commit(t.state(first), first)
    t.replace(frame(spark, [(1, "c")]))
    assert t.vacuum(1) >= 3 and t.versions() == [3] and held(t) == [(1, "c")]
    none = stores.KeyedTable(spark, f"file://{tmp_path}/none", t.schema, ["k"])
    assert none.count() == 0 and none.version() == 0
