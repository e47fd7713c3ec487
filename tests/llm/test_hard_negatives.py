"""Hard negatives against a brute-force version."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from evigraph.llm import hard_negatives as H

VEC = "vec_id long, embedding array<float>, label int, id string, score string, v string, rank string"


def brute(rows):
    one = {}
    for i, x, label, *_ in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = tuple(math.floor(256 * float(np.float32(c))) for c in x)
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        one[i] = min(one.get(i, (label, v)), (label, v))
    out = []
    for a, (la, va) in one.items():
        if a % 100:
            continue
        scores = [(-sum(p * q for p, q in zip(va, v, strict=False)), o, lo) for o, (lo, v) in one.items() if o != a]
        for ps, p, _ in sorted(s for s in scores if s[2] == la)[:5]:
            good = sorted(s for s in scores if s[2] != la and 80 * -ps <= 100 * -s[0] <= 100 * -ps)
            out += [(a, p, k + 1, o, -ps, -s) for k, (s, o, _) in enumerate(good[:5])]
    return sorted(out)


def mined(spark, rows):
    df = H.mine(spark.createDataFrame(rows, VEC).repartition(3))
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def rows(seed, n=420, d=6, clusters=None):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(clusters or 1)]
    out = []
    for i in range(n):
        c = r.choice(centres) if clusters else [0] * d
        out.append((i * 5 % (5 * n) + (0 if r.random() < 0.9 else 1), [x + r.gauss(0, 0.1 if clusters else 1) for x in c], r.randrange(4), "", "", "", ""))
    odd = [None, [], [1.0] * 3, [float("nan")] * d, [float("inf"), *[0.0] * (d - 1)], [None] * d, [0.0] * d, [1.0] * d]
    out += [(1000 * k, x, 1, "", "", "", "") for k, x in enumerate(odd)]
    out += [(700, [0.5] * d, None, "", "", "", ""), (None, [1.0] * d, 1, "", "", "", ""), *out[:30]]
    out += [(9000 + k, [0.3] * d, k % 3, "", "", "", "") for k in range(60)]  # ties
    return out


@pytest.mark.parametrize(("seed", "clusters", "chunk", "block", "run"), [(1, None, 8 << 20, 16 << 20, 512), (2, 5, 300, 4000, 8)])
def test_hard_negatives(spark, monkeypatch, seed, clusters, chunk, block, run):
    """One chunk of anchors and several, wide runs and narrow ones."""
    for name, value in (("CHUNK_BYTES", chunk), ("BLOCK_BYTES", block), ("RUN_ROWS", run), ("ANCHOR_ROWS", 3 if run == 8 else 64)):
        monkeypatch.setattr(H, name, value)
    data = rows(seed, clusters=clusters)
    want = brute(data)
    assert len(want) > 20 and mined(spark, data) == want


def test_large_components_are_exact(spark):
    r = random.Random(4)
    data = [(10 * i, [r.choice([-1, 1]) * float(1 << 19) + r.randrange(4), float(r.randrange(1 << 18))], i % 3, "", "", "", "") for i in range(60)]
    want = brute(data)
    assert want and max(w[4] for w in want) > 1 << 53 and mined(spark, data) == want


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1, "", "", "", ""), (2, [1.0], 2, "", "", "", "")]) == []
    assert mined(spark, [(100, None, 1, "", "", "", "")]) == []


def test_clustered_rows_are_mostly_passed_over():
    """Brackets hold every score in question and leave most rows of far clusters out."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 32)) * 100
    v = np.floor(centres[r.integers(0, 20, 4000)] + r.normal(size=(4000, 32)) * 5).astype(np.int64)
    norm = (v * v).sum(axis=1).astype(float)
    pivots = H.Pivots(v[:500], float(norm.max()), 32)
    block = H.Block(np.arange(4000), np.zeros(4000, int), v, pivots.distances(v), pivots)
    few = H.Anchors(np.arange(10), np.zeros(10, int), v[:10], pivots.distances(v[:10], anchors=True), norm[:10])
    low = norm[:10] * 0.9
    got = {(int(a), int(block.ids[x])): int(s) for aa, rows_, out in block.scores(few, True, low, np.full(10, np.inf)) for a, x, s in zip(aa, rows_, out, strict=True)}
    dots = v[:10] @ v.T
    assert got == {(a, x): int(dots[a, x]) for a in range(10) for x in range(4000) if dots[a, x] >= low[a] and a != x}
    assert block.met < 0.2 * block.pairs


def test_short_lists_go_on_with_zeros():
    assert H._matrix(pa.array([[1, 2], [], [3]]), 2).tolist() == [[1, 2], [0, 0], [3, 0]]
