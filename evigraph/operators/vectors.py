"""Exact and approximate nearest neighbours, similarity joins, recall.

The heavy part is a matrix product: vectors come in Arrow batches, queries are
broadcast in blocks of bounded size, and only the best k of each batch leave a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions.vectors import cosine
from evigraph.session import fresh_path, materialise

#: Queries that are broadcast at once.
QUERY_BLOCK = 4096
#: Vectors that such a block meets in one task, where there are several blocks.
TOPK_ROWS = 65_536
#: Pairs of a query and a row in a matrix product of the batch top-k.
TOPK_PAIRS = 1 << 18
#: Products of queries and centroids that an index sorts at once.
CHOICES = 1 << 18
#: How far products of equal vectors may differ by the order of their sums.
NOISE = 1e-11
#: Vectors in a block of the similarity join, those held against a block at once, and pairs worked out at once.
PAIR_BLOCK, PAIR_ROWS, PAIR_STEP = 8192, 512, 1 << 16
#: Tasks that pairs of blocks are dealt to, at most; rows of one vector in a list, about.
MOST_PARTS, COPIES = 4096, 1024
#: Vectors that its rotation is fitted on, slices of either coordinate, coordinates of a box.
PAIR_SAMPLE, MOST_SLICES, BOX = 4096, 64, 8
#: Lists of an index, vectors that its centroids are fitted on, and rows in a part of a list, about.
MOST_LISTS, MOST_SAMPLE, PART_ROWS = 4096, 65_536, 50_000


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column, shorter ones end in zeros, and their lengths; rows whose squares pass doubles are scaled by a power of two."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if n else 0
    out = np.zeros((n, width))
    if width:
        out[np.arange(width)[None, :] < lengths[:, None]] = flat
    size = np.linalg.norm(out, axis=1, keepdims=True)
    far = ((size < 1e-70) | (size > 1e70))[:, 0]
    if width and far.any():
        out[far] = np.ldexp(out[far], -np.frexp(np.abs(out[far]).max(axis=1, keepdims=True))[1])
        size[far] = np.linalg.norm(out[far], axis=1, keepdims=True)
    return out, size


def _unit(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column; zero rows stay zero, shorter ones end in zeros."""
    return _unit(*_rows(column))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = min(a.shape[1], b.shape[1])
    return a[:, :w] @ b[:, :w].T


def exact_topk(vectors: DataFrame, query: list[float], k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, similarity) of the k most similar vectors; ties go to the smaller id (F1)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, cosine(vec_col, q).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def _places(sorted_keys: np.ndarray) -> np.ndarray:
    """Each row's place, from 0, among its equals."""
    first = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    return np.arange(len(sorted_keys)) - np.repeat(first, np.diff(first, append=len(sorted_keys)))


def _distinct_enough(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k nearest: of equal vectors k of each of the k + 1 smallest ids, as one may be the query's."""
    same = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    change = np.diff(same[order], prepend=-1) != 0
    pair = np.cumsum(change | (np.diff(ids[order], prepend=ids[order[:1]]) != 0))
    return order[(_places(pair) < k) & (pair - pair[change][np.cumsum(change) - 1] <= k)]


def _best(ids: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids, similarities and these rounded to 12 digits of each query's k best rows, ties by id.

    The product only tells which rows may be among them; their similarities are then
    summed up alike for each pair, so that equal vectors have equal ones.
    """
    sims = _common(q, x)
    sims[(ids[:, None] == own[None, :]) | ~np.isfinite(sims)] = -np.inf
    least = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k] if 0 < k < len(own) else -np.inf
    who, row = np.nonzero(np.isfinite(sims) & (sims >= least - NOISE))
    w = min(q.shape[1], x.shape[1])
    sim = (q[who, :w] * x[row, :w]).sum(axis=1)
    key = np.round(sim, 12) + 0.0
    order = np.lexsort((own[row], -key, who))
    order = order[_places(who[order]) < k]
    return ids[who[order]], own[row[order]], sim[order], key[order]


def topk_batch(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = QUERY_BLOCK, rows: int = TOPK_ROWS) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar vectors of each query, itself left out (F2).

    Up to ``block`` queries, which are counted, go to all tasks and the vectors stay where
    they are. More of them, and the vectors, are dealt to blocks of bounded size; every block
    of queries meets every block of vectors in a task of its own, and the best of these are
    ranked again. No query passes the driver but those of one block. Similarities count as
    rounded to 12 digits, ties go to the smaller id.
    """
    wanted = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("q"))
    own = vectors.select(F.col(id_col).cast("long").alias("num"), F.col(vec_col).alias("v"))
    names = ["query_id", "num", "similarity", "key"]

    def best(ids: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = _distinct_enough(x, own, k)
        own, x = own[some], x[some]
        step = max(1, TOPK_PAIRS // len(own))
        for at in range(0, len(ids), step):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(ids[at : at + step], q[at : at + step], own, x, k)], names)

    schema = "query_id long, num long, similarity double, key double"
    if wanted.limit(block + 1).count() <= block:
        few = wanted.toArrow()
        order = np.argsort(few["query_id"].to_numpy(), kind="stable")
        sent = vectors.sparkSession.sparkContext.broadcast((few["query_id"].to_numpy()[order], matrix(few["q"])[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from best(*sent.value, batch.column(0).to_numpy(), matrix(batch.column(1)))

        parts = own.mapInArrow(run, schema)
    else:
        wanted = materialise(wanted, "queries")
        across, down = -(-wanted.count() // block), max(1, -(-own.count() // rows))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = own.select(dealt("num", down).alias("row"), every(across).alias("col"), "num", "v")
        right = wanted.select(every(down).alias("row"), dealt("query_id", across).alias("col"), "query_id", "q")

        def cell(one: pa.Table, two: pa.Table) -> pa.Table:
            if not one.num_rows or not two.num_rows:
                return pa.table({n: pa.array([], pa.int64() if n in names[:2] else pa.float64()) for n in names})
            return pa.Table.from_batches(best(two["query_id"].to_numpy(), matrix(two["q"]), one["num"].to_numpy(), matrix(one["v"])))

        parts = left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInArrow(cell, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "num")
    ranked = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("num").alias(id_col), "similarity", "rank")


def _mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow over batches that aren't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


class _Rotation:
    """An orthogonal matrix whose first coordinates hold most of the vectors' length, and slices of the first two.

    It is fitted on a bounded sample; which one it is decides how early pairs end, not
    which pairs come out.
    """

    def __init__(self, sample: np.ndarray, width: int, slices: int):
        x = np.zeros((len(sample), width))
        x[:, : sample.shape[1]] = np.where(np.isfinite(sample), sample, 0)
        self.turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        y = x @ self.turn[:, :2]
        inner = np.linspace(0, 1, slices + 1)[1:-1]
        self.cuts = [np.quantile(y[:, c], inner) if len(y) else np.zeros(slices - 1) for c in range(y.shape[1])]
        self.slices = slices

    def of(self, x: np.ndarray) -> np.ndarray:
        return x @ self.turn[: x.shape[1]]

    def slice_of(self, y: np.ndarray) -> np.ndarray:
        at = [np.searchsorted(cut, y[:, c], "right") for c, cut in enumerate(self.cuts)]
        return (at[0] * self.slices + (at[1] if len(at) > 1 else 0)).astype(np.int32)


def _rest(y: np.ndarray, head: int) -> np.ndarray:
    """Lengths of what follows the head."""
    return np.linalg.norm(y[:, head:], axis=1)


def _near(x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(i, j, similarity) of all pairs from the threshold on, and how many were worked out whole.

    By Cauchy and Schwarz a product is at most that of the heads of the turned vectors and
    the lengths of their rests, which are one more number of each head. One product in
    single precision tells that for all pairs by three quarters of the numbers; the others
    get their last quarter, and those within the rounding of the threshold are worked out
    from the vectors as given.
    """
    d = tx.shape[1]
    head = max(1, 3 * d // 4)
    slack = 1.2e-7 * (d + 8)  # single precision's worst, for vectors of length 1
    fx, fy = (np.concatenate([t[:, :head], _rest(t, head)[:, None]], axis=1, dtype=np.float32) for t in (tx, ty))
    most = fx @ fy.T
    at = np.flatnonzero(most >= np.float32(threshold - slack))
    met, w = len(at), min(x.shape[1], y.shape[1])
    lx, ly = tx[:, head:].astype(np.float32), ty[:, head:].astype(np.float32)
    found: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for a in range(0, met, PAIR_STEP):
        k = at[a : a + PAIR_STEP]
        i, j = np.divmod(k, len(y))
        about = most.reshape(-1)[k] - fx[i, head] * fy[j, head] + np.einsum("nk,nk->n", lx[i], ly[j])
        few = np.flatnonzero(about >= threshold - 3 * slack)
        i, j = i[few], j[few]
        sims = (x[i, :w] * y[j, :w]).sum(axis=1)
        good = sims >= threshold
        found.append((i[good], j[good], sims[good]))
    i, j, sims = (np.concatenate(c) for c in zip(*found, strict=True))
    return i, j, sims, met


def _summed(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added up in their order."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _cosines(x: np.ndarray, y: np.ndarray, xx: np.ndarray, yy: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows i of x and j of y, whose squares' sums are xx and yy, to the bit as DuckDB has them; 0 without length."""
    w = min(x.shape[1], y.shape[1])
    steps = [slice(at, at + PAIR_STEP) for at in range(0, len(i), PAIR_STEP)]
    dot = np.concatenate([np.zeros(0), *(_summed(x[i[k], :w] * y[j[k], :w]) for k in steps)])
    size = np.sqrt(xx[i] * yy[j])
    return np.clip(np.divide(dot, size, out=np.zeros(len(i)), where=size > 0), -1, 1)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the smallest end of each component of links (a, b) with its other ends."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(one):
        least = np.minimum(root[one], root[two])
        np.minimum.at(root, root[one], least)
        np.minimum.at(root, root[two], least)
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
        apart = root[one] != root[two]
        one, two = one[apart], two[apart]
    rest = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[rest]], ids[rest]


def similar_pairs(vectors: DataFrame, threshold: float, group_col: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", block: int = PAIR_BLOCK) -> DataFrame:
    """(a, b, similarity) with a < b and cosine >= threshold within a group.

    Equal vectors of a group are one: all links of the one of smallest id come out, and
    the others' link with it. Vectors are turned so that a few numbers hold most of their
    length, and dealt to blocks by slices of the first two; blocks whose boxes rule out a
    similar pair don't meet, so a vector is sent once for each block that it has to meet.
    Inside a pair of blocks a product of heads in single precision rules most pairs out.
    """
    return _pairs(vectors, threshold, group_col, id_col, vec_col, block).where("a IS NOT NULL").select("a", "b", "similarity")


def pairs_between(vectors: DataFrame, low: float, high: float, group_col: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", block: int = PAIR_BLOCK) -> DataFrame:
    """(a, b, similarity) of all pairs of rows with a < b and low <= cosine < high within a group (I4).

    Equal vectors are one only while they are held against others: a pair of distinct
    vectors comes out for every two of their rows, rows that repeat an id included, and
    equal ones come out together where 1 is in the band. Rows without id or vector have
    no pairs. The result is as long as there are such pairs, the square of the copies of
    two vectors; pairs from ``high`` on don't leave their task.
    """
    return _pairs(vectors, low, group_col, id_col, vec_col, block, high=high)


def similar_links(vectors: DataFrame, threshold: float, group_col: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", block: int = PAIR_BLOCK) -> DataFrame:
    """(a, b): links whose ends and components are those of similar_pairs(), for components of them.

    Every pair is judged as there, but a pair of blocks leaves only a star for each
    component that its links make, so there are at most as many links as vectors met.
    """
    return _pairs(vectors, threshold, group_col, id_col, vec_col, block, stars=True).where("a IS NOT NULL").select("a", "b")


def pairs_met(vectors: DataFrame, threshold: float, group_col: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", block: int = PAIR_BLOCK) -> DataFrame:
    """One row (vectors, pairs, met, links): distinct vectors, all their pairs, those worked out whole, links."""
    found = _pairs(vectors, threshold, group_col, id_col, vec_col, block)
    distinct = vectors.groupBy(*([group_col] if group_col else []), vec_col).count()
    if threshold > 0:
        distinct = distinct.where(F.exists(vec_col, lambda x: x != 0))
    n = distinct.groupBy(*([group_col] if group_col else [])).agg(F.count(F.lit(1)).alias("n"))
    n = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))
    return n.crossJoin(found.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.count("a").alias("links")))  # one row with one row


def _of_rows(pairs: DataFrame, v: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b, similarity) with a < b of all rows of v whose vectors are a pair by their numbers in own.

    Rows of a vector come in lists of about COPIES. Where one has several lists, each pair
    of lists is dealt by itself, so that no task has all rows of a pair.
    """
    parts = F.ceil(F.col("n") / COPIES).cast("int")
    many = v.join(own.where("n > 1").select("grp", "v", F.col("id").alias("own"), "n"), ["grp", "v"])
    lists = many.groupBy("own", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part")).agg(F.collect_list("id").alias("rows"))
    lists = own.where("n = 1").select(F.col("id").alias("own"), F.lit(0).alias("part"), F.array("first").alias("rows")).unionByName(lists)
    hot = own.where(F.col("n") > COPIES).select("id", parts.alias("parts"))
    several = not hot.isEmpty()
    for end in "ab":
        if several:
            pairs = pairs.join(hot.toDF(end, "parts"), end, "left")
            pairs = pairs.withColumn(f"part_{end}", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        else:
            pairs = pairs.withColumn(f"part_{end}", F.lit(0))
    for end in "ab":
        pairs = pairs.join(lists.toDF(end, f"part_{end}", f"rows_{end}"), [end, f"part_{end}"])
    if several:
        pairs = pairs.repartition("a", "part_a", "b", "part_b")
    rows = pairs.withColumn("row_a", F.explode("rows_a")).withColumn("row_b", F.explode("rows_b"))
    met = rows.where("row_a < row_b OR a <> b AND row_a <> row_b")
    return met.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b"), "similarity")


def _pairs(vectors: DataFrame, threshold: float, group_col: str | None, id_col: str, vec_col: str, block: int, stars: bool = False, high: float | None = None) -> DataFrame:
    """(a, b, similarity, met): links, or stars of them without similarity, and for each pair of blocks a row with the pairs worked out whole.

    Where there is a bound ``high``, (a, b, similarity) of all rows below it instead.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")) if group_col else F.lit("")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), group.alias("grp"), F.col(vec_col).alias("v"))
    kind = v.schema["v"].dataType.simpleString()
    if threshold > 0:  # a vector without length is like nothing
        v = v.where(F.exists("v", lambda x: x != 0))
    v = materialise(v.where("id IS NOT NULL AND v IS NOT NULL"), "vectors")
    own = v.groupBy("grp", "v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    own = materialise(own.withColumn("id", F.col("first") if high is None else F.monotonically_increasing_id()), "distinct")
    if high is None:
        copies = v.join(own.where("n > 1").select("grp", "v", "first"), ["grp", "v"]).where("id <> first")
        copies = copies.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit(None).cast("long").alias("met"))
    else:  # a vector that has length, and finite numbers, with itself
        alike = F.when(F.exists("v", lambda x: x != 0), F.lit(1.0)).otherwise(F.lit(0.0))
        copies = own.where("n > 1").where(F.forall("v", lambda x: F.abs(x.cast("double")) < float("inf")))
        copies = copies.select(F.col("id").alias("a"), F.col("id").alias("b"), alike.alias("similarity"), F.lit(None).cast("long").alias("met"))
        copies = copies.where((F.col("similarity") >= threshold) & (F.col("similarity") < high))

    size = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    slices = int(min(MOST_SLICES, max(1, np.ceil((size["n"] / block) ** 0.5))))
    few = own.orderBy(F.xxhash64("id", F.lit("turn")), "id").limit(PAIR_SAMPLE).select("v").toArrow()
    sent = v.sparkSession.sparkContext.broadcast(_Rotation(matrix(few.column(0)) if few.num_rows else np.zeros((0, 1)), max(1, size["d"]), slices))
    box = min(BOX, max(1, size["d"]))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        y = sent.value.of(matrix(batch.column(2)))
        head = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(y[:, :box]).reshape(-1)), box).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.slice_of(y)), head, pa.array(_rest(y, box))], ["id", "grp", "v", "slice", "head", "rest"])

    placed = materialise(_mapped(own.select("id", "grp", "v"), place, f"id long, grp string, v {kind}, slice int, head array<double>, rest double"), "placed")
    ends = [f(F.col("head")[c]).alias(f"{n}{c}") for c in range(box) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = placed.groupBy("grp", "slice").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("salts"), F.max("rest").alias("rest"), *ends)
    boxes = materialise(boxes.select("grp", "slice", "salts", "rest", F.array(*(f"lo{c}" for c in range(box))).alias("lo"), F.array(*(f"hi{c}" for c in range(box))).alias("hi")), "boxes")
    one, two = boxes.select("grp", *(F.col(c).alias(f"{c}_a") for c in boxes.columns[1:])), boxes.select("grp", *(F.col(c).alias(f"{c}_b") for c in boxes.columns[1:]))
    # The largest product that two boxes can hold, coordinate by coordinate.
    most = F.lit(0.0) + F.col("rest_a") * F.col("rest_b")
    for c in range(box):
        most = most + F.greatest(*(F.col(f"{p}_a")[c] * F.col(f"{q}_b")[c] for p in ("lo", "hi") for q in ("lo", "hi")))
    cells = one.join(two, "grp").where("slice_a <= slice_b").where(most >= threshold - 1e-9)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = cells.select("grp", "slice_a", "slice_b", "salts_a", "salts_b", every("salts_a").alias("salt_a")).select("*", every("salts_b").alias("salt_b"))
    cells = materialise(cells.where("slice_a < slice_b OR salt_a <= salt_b"), "cells")
    key = ["grp", "slice_a", "salt_a", "slice_b", "salt_b"]
    dealt = placed.join(boxes.select("grp", "slice", "salts"), ["grp", "slice"]).select("grp", "slice", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), "id", "v")
    side = lambda s: dealt.withColumnsRenamed({"slice": f"slice_{s}", "salt": f"salt_{s}"}).join(cells.select(*key), ["grp", f"slice_{s}", f"salt_{s}"]).select(*(F.col(c).alias(c) for c in [*key, "id", "v"]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        met = 0
        if left.num_rows and right.num_rows:
            same = left["slice_a"][0] == left["slice_b"][0] and left["salt_a"][0] == left["salt_b"][0]
            a, b, (x, size), (y, size_y) = left["id"].to_numpy(), right["id"].to_numpy(), _rows(left["v"]), _rows(right["v"])
            xx, yy, unit = _summed(x * x), _summed(y * y), _unit(y, size_y)
            ty = sent.value.of(unit)
            for at in range(0, len(a), PAIR_ROWS):
                part = _unit(x[at : at + PAIR_ROWS], size[at : at + PAIR_ROWS])
                i, j, _, n = _near(part, unit, sent.value.of(part), ty, threshold - NOISE)
                i, met = i + at, met + n
                sims = _cosines(x, y, xx, yy, i, j)
                keep = (sims >= threshold) & (sims < (np.inf if high is None else high))
                if same:  # a block with itself has each pair twice
                    keep &= a[i] < b[j]
                out.append((np.minimum(a[i], b[j])[keep], np.maximum(a[i], b[j])[keep], sims[keep]))
            met = (met - len(a)) // 2 if same else met
        a, b, sims = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if stars:
            a, b = _stars(a, b)
            sims = np.zeros(len(a))
        last = np.arange(len(a) + 1) == len(a)  # the row of the pair of blocks
        rows = [pa.array(np.append(c, 0), pa.int64(), mask=last) for c in (a, b)]
        return pa.table([*rows, pa.array(np.append(sims, 0.0), pa.float64(), mask=last | stars), pa.array(np.where(last, met, 0), pa.int64(), mask=~last)], ["a", "b", "similarity", "met"])

    # Cells are work and not bytes: by their bytes they would be put together into few tasks.
    parts = max(1, min(MOST_PARTS, 2 * cells.count()))
    left, right = (side(s).repartition(parts, *key).groupBy(*key) for s in ("a", "b"))
    found = left.cogroup(right).applyInArrow(run, "a long, b long, similarity double, met long")
    found = found.unionByName(copies)
    return found if high is None else _of_rows(found.where("a IS NOT NULL").drop("met"), v, own)


class IvfIndex:
    """A stored inverted file: every vector is in the list of its nearest centroid.

    There are about as many lists as the square root of the number of vectors, MOST_LISTS
    at most. Centroids are fitted on a bounded sample (``sample`` vectors of smallest hash,
    MOST_SAMPLE at most); all vectors are indexed, in files by list, so a search reads the
    lists that it probes. How many those are by default is measured when the index is
    built: the fewest with which ``calibrate`` queries of the sample find the share
    ``target`` of their exact nearest vectors. With all lists the answer is exact.
    """

    def __init__(self, vectors: DataFrame, lists: int | None = None, sample: int = 10_000, rounds: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", path: str | None = None, target: float = 0.93, calibrate: int = 256, k: int = 5):
        spark = vectors.sparkSession
        path = path or fresh_path(spark, "ivf")
        vectors = vectors.select(id_col, vec_col).where(F.col(vec_col).isNotNull())
        n = vectors.count()
        lists = min(lists or max(1, round(n**0.5)), MOST_LISTS)
        few = vectors.orderBy(F.xxhash64(id_col), id_col).limit(min(max(sample, 16 * lists), MOST_SAMPLE)).toArrow()
        x = matrix(few.column(1)) if few.num_rows else np.zeros((1, 1))
        c = x[np.random.Generator(np.random.PCG64(3)).permutation(len(x))[:lists]]
        for _ in range(rounds):
            at = _nearest(x, c)
            sums = np.zeros_like(c)
            np.add.at(sums, at, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
        share = np.bincount(_nearest(x, c), minlength=len(c)) / len(x)
        parts = np.maximum(1, np.ceil(share * n / PART_ROWS)).astype(int)
        sent = spark.sparkContext.broadcast(c)

        def place(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(_nearest(matrix(batch.column(1)), sent.value).astype(np.int32))], [id_col, vec_col, "list"])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
        placed = _mapped(vectors, place, f"{fields}, list int")
        sizes = spark.createDataFrame([(i, int(p)) for i, p in enumerate(parts)], "list int, parts int")  # MOST_LISTS rows at most
        placed = placed.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64(id_col), F.col("parts")).cast("int")).drop("parts")
        placed.repartition("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
        fields += ", part int, list int"
        self._open(spark, path, id_col, vec_col, c, parts, fields, len(c), 1.0)
        if n and calibrate:
            self.probes, self.recall = self._calibrated(vectors, few.slice(0, calibrate), target, k)
        said = {"id_col": id_col, "vec_col": vec_col, "fields": fields, "probes": self.probes, "recall": self.recall}
        spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        spark.createDataFrame([(i, int(p), [float(t) for t in r]) for i, (p, r) in enumerate(zip(parts, c, strict=True))], "list int, parts int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IvfIndex:
        """An index that was stored at a path."""
        said = json.loads(spark.read.text(f"{path}/about").first()["value"])
        rows = spark.read.schema("list int, parts int, centroid array<double>").parquet(f"{path}/centroids").orderBy("list").collect()
        out = cls.__new__(cls)
        out._open(spark, path, said["id_col"], said["vec_col"], np.array([r["centroid"] for r in rows]), np.array([r["parts"] for r in rows]), said["fields"], said["probes"], said["recall"])
        return out

    def _open(self, spark: SparkSession, path: str, id_col: str, vec_col: str, centroids: np.ndarray, parts: np.ndarray, fields: str, probes: int, recall: float) -> None:
        self.spark, self.path, self.id_col, self.vec_col = spark, path, id_col, vec_col
        self.centroids, self.parts, self.lists, self.probes, self.recall = centroids, parts, len(centroids), probes, recall
        self.table = spark.read.schema(fields).parquet(f"{path}/rows")

    def _number(self, df: DataFrame):
        """Ids as numbers, by which queries leave themselves out."""
        kind = df.schema[self.id_col].dataType.simpleString()
        return F.col(self.id_col).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(self.id_col)

    def _calibrated(self, vectors: DataFrame, few: pa.Table, target: float, k: int) -> tuple[int, float]:
        """(fewest lists that reach the target, their share of the nearest) over some vectors as queries."""
        table = self.table.select(self._number(self.table).alias("vec_id"), F.col(self.vec_col).alias("embedding"), "list")
        queries = self.spark.createDataFrame(few).select(self._number(vectors).alias("vec_id"), F.col(self.vec_col).alias("embedding"))
        gold = topk_batch(table, queries, k).select("query_id", "vec_id")
        x = {r["vec_id"]: r["embedding"] for r in queries.collect()}  # a bounded sample
        held = gold.join(table.select("vec_id", "list"), "vec_id").select("query_id", "list").collect()
        if not held:
            return self.lists, 1.0
        ids = sorted({r["query_id"] for r in held})
        order = np.argsort(-_common(matrix(pa.array([x[i] for i in ids], pa.list_(pa.float64()))), self.centroids), axis=1, kind="stable")
        rank = np.argsort(order, axis=1)
        row = {q: i for i, q in enumerate(ids)}
        need = np.sort([rank[row[r["query_id"]], r["list"]] + 1 for r in held])
        probes = int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)])
        return probes, float((need <= probes).mean())

    def topk(self, query: list[float], k: int = 5, probes: int | None = None) -> DataFrame:
        """(id, similarity) among the nearest lists; only their files are read."""
        q = np.asarray(query, float)
        w = min(len(q), self.centroids.shape[1])
        near = np.argsort(-(self.centroids[:, :w] @ q[:w]), kind="stable")[: probes or self.probes]
        return exact_topk(self.table.where(F.col("list").isin([int(x) for x in near])), list(query), k, self.id_col, self.vec_col)

    def topk_batch(self, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
        """(query_id, id, similarity, rank) for a set of queries, each against its nearest lists.

        Lists go to tasks in parts, and the queries of a list in blocks: a task has one
        matrix product at a time, and only the best of it leave.
        """
        sent, count = self.spark.sparkContext.broadcast(self.centroids), probes or self.probes
        id_col, vec_col = self.id_col, self.vec_col

        def choose(batch: pa.RecordBatch) -> pa.RecordBatch:
            q, lists = matrix(batch.column(1)), len(sent.value)
            step, some = max(1, CHOICES // lists), min(count, lists)
            near = np.empty((len(q), some), np.int32)
            for at in range(0, len(q), step):
                near[at : at + step] = np.argsort(-_common(q[at : at + step], sent.value), axis=1, kind="stable")[:, :some]
            ends = pa.array(np.arange(len(q) + 1, dtype=np.int32) * some)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(near.reshape(-1)))], ["query_id", "q", "near"])

        kind = dict(queries.dtypes)[vec_col]
        probe = _mapped(queries.select(self._number(queries).alias("query_id"), F.col(vec_col).alias("q")), choose, f"query_id long, q {kind}, near array<int>")
        probe = materialise(probe.select("query_id", "q", F.explode("near").alias("list")), "probes")
        asked = {r["list"]: r["n"] for r in probe.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # MOST_LISTS rows at most
        sizes = [(i, int(self.parts[i]), -(-n // QUERY_BLOCK)) for i, n in asked.items()]
        sizes = F.broadcast(self.spark.createDataFrame(sizes, "list int, parts int, blocks int"))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        rows = self.table.select(self._number(self.table).alias("num"), F.col(vec_col).alias("v"), "part", "list").where(F.col("list").isin(sorted(asked)))
        rows = rows.join(sizes, "list").select("list", "part", every("blocks").alias("block"), "num", "v")
        asks = probe.join(sizes, "list").select("list", every("parts").alias("part"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", "q")

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "num": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64()), "key": pa.array([], pa.float64())})
            own, x = left["num"].to_numpy(), matrix(left["v"])
            some = _distinct_enough(x, own, k)
            own, x = own[some], x[some]
            ids, q = right["query_id"].to_numpy(), matrix(right["q"])
            step = max(1, TOPK_PAIRS // len(own))
            found = [_best(ids[at : at + step], q[at : at + step], own, x, k) for at in range(0, len(ids), step)]
            return pa.table(dict(zip(("query_id", "num", "similarity", "key"), (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))

        keys = ["list", "part", "block"]
        found = rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(best, "query_id long, num long, similarity double, key double")
        order = Window.partitionBy("query_id").orderBy(F.desc("key"), "num")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", F.col("num").alias(id_col), "similarity", "rank")


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, some rows at a time."""
    return np.concatenate([np.argmax(_common(x[at : at + 4096], c), axis=1) for at in range(0, max(len(x), 1), 4096)])


def recall(found: DataFrame, gold: DataFrame, query_col: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """One row (queries, hits, gold, recall_micro, recall_macro) of found against gold."""
    g = gold.select(query_col, id_col).distinct()
    hit = g.join(found.select(query_col, id_col, F.lit(1).alias("hit")).distinct(), [query_col, id_col], "left")
    by = hit.groupBy(query_col).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("h"))
    return by.agg(
        F.count(F.lit(1)).alias("queries"), F.sum("h").alias("hits"), F.sum("n").alias("gold"),
        (F.sum("h") / F.sum("n")).alias("recall_micro"), F.avg(F.col("h") / F.col("n")).alias("recall_macro"),
    )
