"""A bucket's links come out as a forest of its components, not as all its near pairs."""

import numpy as np
import pytest

from evigraph.llm import bytetext as B
from evigraph.llm import near_dedup

SETS = "node long, size long, parity array<long>, shingles binary"


def joined(roots, links):
    for a, b in links:
        old, new = roots[a], roots[b]
        roots = {n: new if x == old else x for n, x in roots.items()}
    return {frozenset(n for n in roots if roots[n] == x) for x in roots.values()}, roots


@pytest.mark.parametrize("cell", [1024, 8])
def test_links_are_a_forest_and_lose_no_component(spark, monkeypatch, cell):
    """30 sets of which all pairs are similar, 12 of which few are, batches that end within a cell."""
    monkeypatch.setattr(near_dedup, "CELL", cell)
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)
    sets = []
    for n in range(42):
        s, changed = base.copy(), 8 if n < 30 else 28
        s[r.choice(200, changed, replace=False)] = r.integers(0, 1 << 63, changed, dtype=np.uint64)
        sets.append(np.unique(s))
    share = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    pairs = [(a, b) for a in range(42) for b in range(a) if share(sets[a], sets[b]) >= 0.8]
    assert len(pairs) >= 30 * 29 / 2
    want, _ = joined({n: n for n in range(42)}, pairs)
    odd = [B.signed(near_dedup.parity(B.mix(s ^ B.U64(0x6A09E667F3BCC909)), near_dedup.SET_BITS)).tolist() for s in sets]
    whole = spark.createDataFrame([(n, len(s), o, s.tobytes()) for n, (s, o) in enumerate(zip(sets, odd, strict=True))], SETS)
    held = whole.select("node", "size", "parity").crossJoin(spark.createDataFrame([([(7,), (9,)],)], "places array<struct<bucket:long>>"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "5")
    try:
        rows = lambda roots: near_dedup.placed(held, spark.createDataFrame(list(roots.items()), "node long, label long"), "size", "parity")
        roots = {n: n for n in range(42)}
        crowd = near_dedup.crowded(rows(roots), 42)
        assert [x["cells"] for x in crowd.collect()] == ([] if cell > 42 else [6, 6])
        links = near_dedup.links_in_cells(near_dedup.own_cells(rows(roots), crowd), whole, 80, 42).collect()
        got, roots = joined(roots, links)
        assert len(links) <= 2 * 41 and set(links) <= {p for a, b in pairs for p in ((a, b), (b, a))}
        if cell < 42:
            more = near_dedup.links_in_cells(near_dedup.grid_cells(rows(roots), crowd), whole, 80, 42).collect()
            got, _ = joined(roots, more)
        assert got == want
    finally:
        spark.conf.set(key, before)
