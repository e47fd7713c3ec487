"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are hashed words, runs of three byte classes (so that tables, symbols,
capitals and punctuation show), and bands of a few ratios (repeated words, repeated
neighbours, length). Term weights are log(1 + count) times the inverse document
frequency, rows have length 1; a truncated singular value decomposition of the
labelled rows gives the latent space. The labelled vectors are broadcast - at most
MOST_LABELLED of DIMENSIONS numbers - and every text is compared with all of them, a
block of texts by one matrix product. The NEIGHBOURS nearest vote with their
similarities as weights, smoothed by the share of label 1.

The fit uses a bounded sample of the labelled rows: the MOST_LABELLED of smallest
hash of the id. All texts are scored whole.

Cases: a null or empty text has the terms of its length bands only, and is scored by
them; without labelled rows all scores are 0.5; with several labels or texts of one
id the smallest counts; null labels are no labels; similarities count as rounded to
DIGITS, equal ones are taken in the labelled rows' hash order; repeated rows give
repeated results; further columns are ignored; an empty table gives an empty result; a
very long text is counted whole, with 16 bytes held a word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import bytetext as B
from evigraph.llm.shared import prepare

MOST_LABELLED = 4096
DIMENSIONS = 64
NEIGHBOURS = 25
#: Digits of a similarity that count; the others depend on the order of a sum.
DIGITS = 9
#: Similarities count with this power, and the prior with this weight.
SHARPNESS, PRIOR = 8, 0.05
BLOCK = 256

_WORD_TERMS = 1 << 10
_CLASSES = 12
_RATIO_BANDS = 12
_N_RATIOS = 6
TERMS = _WORD_TERMS + _CLASSES**3 + _N_RATIOS * _RATIO_BANDS

#: Classes of bytes: others 0, then lower case, upper case, digits, blanks, line ends, stops, quotes, symbols, bars, exclamation marks, beyond ASCII.
_CLASS = np.zeros(256, np.int64)
for _k, _set in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?", b"'\"()-", b"#*$%&<>@=+/\\_^~`{}[]", b"|", b"!", bytes(range(128, 256))), 1
):
    _CLASS[list(_set)] = _k


def _band(x: float) -> int:
    return min(_RATIO_BANDS - 1, int(x * _RATIO_BANDS))


def term_counts(w: B.Words) -> np.ndarray:
    """The counts of a text's terms."""
    out = np.zeros(TERMS, np.float32)
    n = len(w.hashes)
    if n:
        out[:_WORD_TERMS] = np.bincount((w.hashes >> B.U64(54)).astype(np.int64), minlength=_WORD_TERMS)
    data = w.data
    for a in range(0, max(len(data) - 2, 0), B.PIECE):
        c = _CLASS[data[a : a + B.PIECE + 2]]
        out[_WORD_TERMS : _WORD_TERMS + _CLASSES**3] += np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=_CLASSES**3)
    kinds = np.bincount(_CLASS[data], minlength=_CLASSES) if len(data) <= 4 * B.PIECE else sum(np.bincount(_CLASS[data[a : a + B.PIECE]], minlength=_CLASSES) for a in range(0, len(data), B.PIECE))
    size = max(len(data), 1)
    ratios = (
        np.log2(n + 1) / 16,
        1 - len(np.unique(w.hashes)) / n if n else 0.0,
        np.count_nonzero(w.hashes[1:] == w.hashes[:-1]) / n if n else 0.0,
        3 * kinds[2] / size,
        6 * (kinds[8] + kinds[9]) / size,
        12 * kinds[10] / size,
    )
    base = TERMS - _N_RATIOS * _RATIO_BANDS
    for k, x in enumerate(ratios):
        out[base + k * _RATIO_BANDS + _band(float(x))] = 8
    return out


def _rows(docs: Iterator[B.Words]) -> np.ndarray:
    rows = [term_counts(w) for w in docs]
    return np.stack(rows) if rows else np.empty((0, TERMS), np.float32)


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float64)
        self.share = float(self.labels.mean()) if len(labels) else 0.5
        n = len(counts)
        self.idf = np.log((1 + n) / (1 + np.count_nonzero(counts, axis=0))).astype(np.float32) + 1
        x = self._weighted(counts)
        k = min(DIMENSIONS, n)
        # Randomised decomposition: a random range, refined by four passes.
        q = np.random.Generator(np.random.PCG64(9)).standard_normal((TERMS, k + 8)).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(x.T @ (x @ q)) if n else (q, None)
        if n:
            _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
            q = q @ vt.T
        self.space = np.ascontiguousarray(q[:, :k]).astype(np.float64)
        self.vectors = self.latent(counts)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(counts) * self.idf)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        """The unit vectors of rows in the latent space, in double precision."""
        return self._unit(self._weighted(counts).astype(np.float64) @ self.space)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest neighbours of each row."""
        if not len(self.labels) or not len(counts):
            return np.full(len(counts), self.share)
        sims = np.round(self.latent(counts) @ self.vectors.T, DIGITS)
        # Distinct numbers in the order of the similarities, then of the rows: no ties are left.
        rank = np.rint(sims * -(10.0**DIGITS)).astype(np.int64) * sims.shape[1] + np.arange(sims.shape[1])
        k = min(NEIGHBOURS, sims.shape[1])
        near = np.sort(np.partition(rank, k - 1, axis=1)[:, :k], axis=1) % sims.shape[1]
        weight = np.clip(np.take_along_axis(sims, near, axis=1), 0, 1) ** SHARPNESS
        ones = (weight * self.labels[near]).sum(axis=1) + PRIOR * self.share
        return np.clip(ones / (weight.sum(axis=1) + PRIOR), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", most: int = MOST_LABELLED) -> Model:
    """Fit on the ``most`` labelled rows of smallest hash; labels is (id, label)."""
    named = labels.select(F.col(labels.columns[0]).alias("id"), F.col(labels.columns[1]).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    named = named.groupBy("id").agg(F.min("label").alias("label"))
    order = F.xxhash64("id")
    few = named.withColumn("o", order).orderBy("o", "id").limit(most)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    src = found.groupBy("o", "id").agg(F.min("label").alias("label"), F.min("text").alias("text")).select("text", "label", "o", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(B.words(batch.column(0), fold=True))
            places = [np.flatnonzero(r) for r in rows]
            counts = [r[p] for r, p in zip(rows, places, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p.astype(np.int32) for p in places], pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32())), batch.column(1), batch.column(2), batch.column(3)],
                ["term", "n", "label", "o", "id"],
            )

    kind = src.schema
    table = src.mapInArrow(run, f"term array<int>, n array<float>, label {kind['label'].dataType.simpleString()}, o long, id {kind['id'].dataType.simpleString()}").toArrow().to_pylist()
    table.sort(key=lambda r: (r["o"], r["id"]))
    counts = np.zeros((len(table), TERMS), np.float32)
    for k, r in enumerate(table):
        counts[k, r["term"]] = r["n"]
    return Model(counts, np.array([r["label"] for r in table]))


_models: dict[str, Model] = {}


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """A score beside all other columns but the text."""
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))
    rest = [c for c in docs.columns if c != text_col]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value[1]
        for batch in batches:
            out, block = [], []
            for w in B.words(batch.column(text_col), fold=True):
                block.append(term_counts(w))
                if len(block) == BLOCK:
                    out.append(model.scores(np.stack(block)))
                    block = []
            if block:
                out.append(model.scores(np.stack(block)))
            values = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(values, pa.float64())], [*rest, "score"])

    return docs.mapInArrow(run, f"{kinds}, score double")
