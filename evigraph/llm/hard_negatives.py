"""Hard negatives of anchors: rows of another label that score nearly as high as a positive.

Scores are inner products of whole numbers. One more component, sqrt(M2 - |x|^2) with M2
the largest squared length, puts all rows on a sphere; for an anchor it is 0. Then
distance^2 = |q|^2 + M2 - 2 * score, so a score's bounds are a distance's. A pivot table
stores each row's distances from PIVOTS rows that lie far apart; by the triangle
inequality |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p) for every pivot p, which
brackets each score before it is worked out. Inside a cell, rows in the order of their
nearest pivot form runs with the range of their distances; runs that cannot hold a
score in question are passed over whole, rows of the others are bracketed one by one and
the survivors' scores are worked out exactly.

Anchors against all rows go by a grid: blocks of rows by chunks of anchors, both of a
bounded number of bytes; a cell returns the best few of its rows and these are ranked
again. That happens twice, as the positives' scores say which negatives count.

Cases: rows with a null id, label or vector or with a null or non-finite component take
no part; of rows that share an id the one of smallest label, then vector, counts; a
shorter vector goes on with zeros; an empty vector scores 0; equal scores go by the
smaller id; further columns are ignored; an empty table, or one without anchors, gives an
empty result; an anchor without positives, or a positive without negatives, has no rows.
Products of 2**53 and more are worked out in Python's whole numbers, and held at the ends
of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.shared import cut, prepare

SCALE, RELABEL_EVERY, LABELS, ANCHOR_EVERY = 256, 7, 10, 100
POSITIVES, NEGATIVES = 5, 5
#: Per cent of the positive's score that a negative has at least and at most.
LOW, HIGH = 80, 100
#: Pivots, and rows of smallest hash among which they are chosen.
PIVOTS, PIVOT_SAMPLE = 16, 1024
#: Bytes of components in a block of rows and in a chunk of anchors.
BLOCK_BYTES, CHUNK_BYTES = 16 << 20, 8 << 20
#: Rows in a run, and anchors that are held against it at once.
RUN_ROWS, ANCHOR_ROWS = 512, 64
#: From this squared length on a double no longer holds every product.
EXACT = 1 << 52


def _whole(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, v (whole components) and norm of the rows that take part."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    broken = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == math.inf))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~broken)
    label = F.when(F.col("id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    v = F.transform("x", lambda c: F.floor(c * SCALE).cast("long"))
    one = rows.select("id", F.struct(label.cast("long").alias("label"), v.alias("v")).alias("row")).groupBy("id").agg(F.min("row").alias("row"))
    norm = F.aggregate("row.v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return one.select("id", "row.label", "row.v", norm.alias("norm"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column, with zeros up to the width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), flat.dtype)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


class Pivots:
    """Pivot rows on the sphere, and distances from them."""

    def __init__(self, sample: np.ndarray, most: float, width: int):
        self.most, self.width = most, width
        x = self.raised(sample.astype(np.float64))
        chosen, far = [], np.full(len(x), np.inf)
        for _ in range(min(PIVOTS, len(x))):
            chosen.append(int(np.argmax(far)))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        self.rows = x[chosen] if chosen else np.zeros((1, width + 1))

    def raised(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))])

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Of rows on the sphere, or of anchors, which have 0 for the further component."""
        x = x.astype(np.float64)
        x = np.column_stack([x, np.zeros(len(x))]) if anchors else self.raised(x)
        square = (x * x).sum(axis=1)[:, None] + (self.rows * self.rows).sum(axis=1) - 2 * (x @ self.rows.T)
        return np.sqrt(np.maximum(square, 0))


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of all rows of a with all of b."""
    if exact:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    big = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, big.min, big.max).astype(np.int64)


class Block:
    """Rows of a cell in runs by nearest pivot, with their brackets."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, away: np.ndarray, pivots: Pivots):
        order = np.lexsort((ids, away.min(axis=1), away.argmin(axis=1)))
        self.ids, self.labels, self.v, self.away = ids[order], labels[order], v[order], away[order]
        self.most, self.exact = pivots.most, pivots.most < EXACT
        runs = [slice(a, min(a + RUN_ROWS, len(ids))) for a in range(0, len(ids), RUN_ROWS)]
        self.runs = [(s, self.away[s].min(axis=0), self.away[s].max(axis=0)) for s in runs]
        self.pairs = self.met = 0

    def scores(self, few: Anchors, same: bool, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, rows, scores) with every pair of low <= score <= high, run by run.

        same: rows of the anchor's own label, or of the others. What is raised in ``low``
        meanwhile holds for the runs that follow.
        """
        slack = 1e-6 * (self.most + few.norms) + 1e-3  # what rounding can do to a bound
        reach = few.norms + self.most
        for s, least, most in self.runs:
            self.pairs += len(few.ids) * (s.stop - s.start)
            far, near = np.sqrt(np.maximum(reach - 2 * low + slack, 0)), np.sqrt(np.maximum(reach - 2 * high - slack, 0))
            apart = np.maximum(few.away - most, least - few.away).max(axis=1)
            live = np.flatnonzero((apart <= far) & ((few.away + most).min(axis=1) >= near))
            fit = (self.labels[s] == few.labels[live, None]) == same
            for mine, theirs in zip(few.away[live].T, self.away[s].T, strict=True):
                gap = np.abs(mine[:, None] - theirs)
                fit &= gap <= far[live, None]
                fit &= mine[:, None] + theirs >= near[live, None]
            rows, anchors = np.flatnonzero(fit.any(axis=0)), np.flatnonzero(fit.any(axis=1))
            if len(rows):
                self.met += int(np.count_nonzero(fit))
                out = _products(few.v[live[anchors]], self.v[s][rows], self.exact)
                a, r = np.nonzero(fit[np.ix_(anchors, rows)])
                out, a, r = out[a, r], live[anchors[a]], rows[r] + s.start
                good = (out >= low[a]) & (out <= high[a]) & (self.ids[r] != few.ids[a])
                yield a[good], r[good], out[good]


class Anchors(NamedTuple):
    """Some anchors of a cell."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    away: np.ndarray
    norms: np.ndarray

    def part(self, s: slice) -> Anchors:
        return Anchors(*(x[s] for x in self))


def _best(group: np.ndarray, ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each group by score, then id."""
    order = np.lexsort((ids, -scores, group))
    g = group[order]
    first = np.searchsorted(g, g)
    return order[np.arange(len(g)) - first < n]


def _positives(block: Block, few: Anchors) -> list[np.ndarray]:
    """Anchor, positive, score: the first rows of each anchor's label in the block."""
    a, ids, got = (np.empty(0, np.int64) for _ in range(3))
    low = np.full(len(few.ids), -np.inf)
    for x, rows, scores in block.scores(few, True, low, np.full(len(few.ids), np.inf)):
        a, ids, got = np.concatenate([a, x]), np.concatenate([ids, block.ids[rows]]), np.concatenate([got, scores])
        keep = _best(a, ids, got, POSITIVES)
        a, ids, got = a[keep], ids[keep], got[keep]
        full = np.bincount(a, minlength=len(low)) == POSITIVES
        last = np.flatnonzero(np.append(a[1:] != a[:-1], True)) if len(a) else a
        low[a[last]] = np.where(full[a[last]], got[last], low[a[last]])
    return [few.ids[a], ids, got]


def _negatives(block: Block, few: Anchors, place: np.ndarray, positive: np.ndarray, ps: np.ndarray) -> list[np.ndarray]:
    """Anchor, positive, its score, negative, score: the first negatives of each positive in the block.

    place, positive, ps: anchors' places and their positives.
    """
    least, most = -(-LOW * ps // 100), HIGH * ps // 100
    low, high = np.full(len(few.ids), np.inf), np.full(len(few.ids), -np.inf)
    np.minimum.at(low, place, least)
    np.maximum.at(high, place, most)
    some = list(block.scores(few, False, low, high))
    a, rows, scores = (np.concatenate([x[k] for x in some] or [np.empty(0, np.int64)]) for k in range(3))
    order = np.argsort(a, kind="stable")
    a, ids, scores = a[order], block.ids[rows[order]], scores[order]
    out = []
    for k, (p, lo, hi) in enumerate(zip(place.tolist(), least.tolist(), most.tolist(), strict=True)):
        i, j = np.searchsorted(a, [p, p + 1])
        fit = np.flatnonzero((scores[i:j] >= lo) & (scores[i:j] <= hi)) + i
        best = fit[_best(np.zeros(len(fit), np.int64), ids[fit], scores[fit], NEGATIVES)]
        out.append((np.full(len(best), k), ids[best], scores[best]))
    k, ids, scores = (np.concatenate([x[c] for x in out] or [np.empty(0, np.int64)]) for c in range(3))
    return [few.ids[place[k]], positive[k], ps[k], ids, scores]


def _grid(rows: DataFrame, anchors: DataFrame, n_blocks: int, n_chunks: int):  # noqa: ANN202
    """Both sides, grouped by cell: every block of rows by every chunk of anchors."""
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumns({"block": part(n_blocks), "chunk": every(n_chunks)})
    right = anchors.withColumns({"chunk": part(n_chunks), "block": every(n_blocks)})
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))


def _first(df: DataFrame, by: list[str], other: str, n: int) -> DataFrame:
    """The first n of each group by score, then id."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(other))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = prepare(vectors.sparkSession)
    whole = cut(_whole(vectors, id_col, vector_col, label_col), "whole-vectors")
    anchor: Column = F.col("id") % ANCHOR_EVERY == 0
    size = whole.agg(F.count("*"), F.count(F.when(anchor, 1)), F.max("norm"), F.max(F.size("v"))).first()
    n, n_anchors, most, width = size[0], size[1], float(size[2] or 0), max(size[3] or 0, 1)
    sample = whole.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").toArrow().column("v")
    pivots = Pivots(_matrix(sample, width), most, width)
    sent = spark.sparkContext.broadcast(pivots)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = sent.value.distances(_matrix(batch.column(2), width))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(away) + 1, dtype=np.int32) * away.shape[1]), pa.array(away.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "away"])

    table = cut(whole.mapInArrow(stored, "id long, label long, v array<long>, norm double, away array<double>"), "pivot-table")
    anchors = table.where(anchor).drop("away")
    n_blocks = max(-(-n * width * 8 // BLOCK_BYTES), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    n_chunks = max(-(-n_anchors * width * 8 // CHUNK_BYTES), 1)

    def cell(rows: pa.Table, few: pa.Table) -> tuple[Block, Anchors]:
        column = lambda t, c: t.column(c).to_numpy()
        block = Block(column(rows, "id"), column(rows, "label"), _matrix(rows.column("v"), width), _matrix(rows.column("away"), len(sent.value.rows)), sent.value)
        v = _matrix(few.column("v"), width)
        return block, Anchors(column(few, "id"), column(few, "label"), v, sent.value.distances(v, anchors=True), column(few, "norm"))

    def positives(rows: pa.Table, few: pa.Table) -> pa.Table:
        found = []
        if len(rows) and len(few):
            block, anchors = cell(rows, few)
            found = [_positives(block, anchors.part(slice(a, a + ANCHOR_ROWS))) for a in range(0, len(few), ANCHOR_ROWS)]
        return _table(found, ["anchor", "positive", "score"])

    def negatives(rows: pa.Table, few: pa.Table) -> pa.Table:
        found = []
        if len(rows) and len(few):
            block, anchors = cell(rows, few)
            lists = few.column("positives").combine_chunks()
            n, flat = lists.value_lengths().to_numpy(), lists.flatten()
            place, (positive, ps) = np.repeat(np.arange(len(n)), n), (flat.field(c).to_numpy() for c in ("id", "score"))
            for a in range(0, len(few), ANCHOR_ROWS):
                i, j = np.searchsorted(place, [a, a + ANCHOR_ROWS])
                found.append(_negatives(block, anchors.part(slice(a, a + ANCHOR_ROWS)), place[i:j] - a, positive[i:j], ps[i:j]))
        return _table(found, ["anchor", "positive", "positive_score", "negative", "score"])

    some = _grid(table, anchors, n_blocks, n_chunks).applyInArrow(positives, "anchor long, positive long, score long")
    best = _first(some, ["anchor"], "positive", POSITIVES).groupBy("anchor").agg(F.collect_list(F.struct(F.col("positive").alias("id"), "score")).alias("positives"))
    asked = cut(anchors.join(best, anchors["id"] == best["anchor"]).drop("anchor"), "anchors")
    some = _grid(table, asked, n_blocks, n_chunks).applyInArrow(negatives, "anchor long, positive long, positive_score long, negative long, score long")
    return _first(some, ["anchor", "positive", "positive_score"], "negative", NEGATIVES).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _table(parts: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    return pa.table({c: pa.array(np.concatenate([p[k] for p in parts] or [np.empty(0, np.int64)]), pa.int64()) for k, c in enumerate(names)})


#: The same in SQL, with the standard parameters.
SQL = """
WITH sound AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS (SELECT * FROM sound QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1),
scores AS (
    SELECT a.vec_id AS anchor_id, o.vec_id AS other, o.label = a.label AS same, list_inner_product(a.v, o.v)::BIGINT AS score
    FROM one a JOIN one o ON a.vec_id % 100 = 0 AND o.vec_id <> a.vec_id),
positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
