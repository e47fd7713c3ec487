"""Toxicity scores by a convolutional text classifier.

A word is one row of hashed embeddings for the whole word and one for each of its
beginnings of 4, 5 and 6 bytes, so that inflected forms share what is learnt of a stem.
Filters over one, two and three words run over the whole text; the largest value of each
filter, at least 0, goes into a logistic unit. All of it is trained in NumPy by Adagrad in
the tasks that hold the labelled texts; only the place where a filter was largest is learnt from. So that these places are worth
learning from at once, the first number of an embedding begins as the log-odds of its row
between texts of either label, the others at random. Only words and beginnings that
KNOWN_TEXTS training texts hold have embeddings other than 0. The epoch of least loss on a
part kept apart is taken.

The same part gives each language the threshold of its best F1; a language with fewer
than CALIBRATE positives takes that of all together. A score is the probability bent so
that the threshold of the text's language lies at 0.5. The language is told from the
text, by naive Bayes over hashed words learnt from the training texts.

The fit uses every labelled row. Counts of rows and languages are summed up by Spark. In an
epoch each task trains a copy of the numbers on its own texts, about SHARD_ROWS of them and
more where that would make over MOST_SHARDS tasks; the copies' changes are averaged after
it, those of an embedding over the tasks that changed it. Training ends with the first
epoch that lowers the loss by less than LEAST_GAIN, EPOCHS at most. The driver holds the model, never texts. Which texts are
trained on together depends on how the stored files are read, so clusters of other sizes
have slightly different scores. All texts are scored whole.

Cases: a null or empty text has no words, all its filters are 0; without labelled rows
all scores are 0; with labels of one kind only, the share of that kind decides; of several
labels of one id the smallest counts, of several texts the smallest; null labels are no
labels; a null language is ``und``; repeated rows give repeated results, equal but for the
rounding of sums in single precision (1e-6); further columns are kept; an empty table gives an empty result; a very long
text is scored in pieces that overlap, with 40 bytes held a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm import bytetext as B
from evigraph.llm.shared import cut, prepare

#: Texts that a task trains on, about, and tasks at most.
SHARD_ROWS, MOST_SHARDS = 4096, 64
#: What an epoch must take off the loss for another to follow.
LEAST_GAIN = 0.005
#: Rows of a table whose changes are averaged at once; steps of probability told apart by thresholds.
CHUNK_ROWS, STEPS = 1 << 14, 1 << 16
#: Rows of each table, numbers of each row, filters of each width.
TABLE_BITS, WIDTH, FILTERS, WIDTHS = 17, 6, 8, 3
#: Bytes of the beginnings that have a table each, after the whole word's.
BEGINNINGS = (4, 5, 6)
#: Texts with a word before it has an embedding.
KNOWN_TEXTS = 3
#: Texts of either label that every row counts as seen in beside its own.
SMOOTH = 2
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 32, 0.05, 1e-4, 13
#: One of CALIBRATE_EVERY labelled rows is kept apart, by hash; positives that a language needs there.
CALIBRATE_EVERY, CALIBRATE = 4, 5
#: Buckets of words, and languages at most, of the language model.
LANGUAGE_BITS, MOST_LANGUAGES = 13, 256
#: Words in a piece that is convolved at once.
PIECE_WORDS = 1 << 15

_N = FILTERS * WIDTHS
_ROWS = 1 << TABLE_BITS


class Text(NamedTuple):
    """A text's row in each table for every word, and its words' counts by bucket of the language model."""

    rows: np.ndarray
    bag: np.ndarray


def text_of(w: B.Words) -> Text:
    keys = [w.hashes]
    data, starts = np.concatenate([w.data, np.zeros(max(BEGINNINGS), np.uint8)]), w.starts.astype(np.int64)
    size, key = w.ends - w.starts, np.zeros(len(starts), np.uint64)
    for k in range(max(BEGINNINGS)):
        key = (key << B.U64(8)) | np.where(k < size, B.FOLD[data[starts + k]], 0).astype(np.uint64)
        if k + 1 in BEGINNINGS:
            keys.append(B.mix(key + B.U64(1)))
    bag = np.bincount((w.hashes >> B.U64(64 - LANGUAGE_BITS)).astype(np.int64), minlength=1 << LANGUAGE_BITS)
    return Text(np.stack([(k >> B.U64(64 - TABLE_BITS)).astype(np.int32) for k in keys]), bag.astype(np.float32))


class Filters:
    """Embeddings, filters and the logistic unit. Row _ROWS of a table is 0: no word."""

    def __init__(self, odds: list[np.ndarray], share: float):
        """odds: of every row of each table the log-odds, NaN for rows that stay 0."""
        r = np.random.default_rng(SEED)
        self.tables = []
        for known in odds:
            rows = np.flatnonzero(~np.isnan(known))
            t = np.zeros((_ROWS + 1, WIDTH), np.float32)
            t[rows] = r.normal(0, 0.1, (len(rows), WIDTH))
            t[rows, 0] = known[rows] / 4
            self.tables.append(t)
        # One column for each filter and word of its window.
        self.kernel = r.normal(0, 0.2, (len(odds) * WIDTH, FILTERS * WIDTHS * (WIDTHS + 1) // 2)).astype(np.float32)
        self.kernel[::WIDTH] = np.abs(self.kernel[::WIDTH])
        self.bias = np.zeros(_N, np.float32)
        self.out = np.abs(r.normal(0, 0.2, _N)).astype(np.float32)
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.base = np.float32(np.log(share / (1 - share)))

    def arrays(self) -> list[np.ndarray]:
        return [*self.tables, self.kernel, self.bias, self.out, np.atleast_1d(self.base)]

    def copy(self) -> list[np.ndarray]:
        return [a.copy() for a in self.arrays()]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Filters:
        out = cls.__new__(cls)
        out.tables = [None] * (len(arrays) - 4)
        out.restore(arrays)
        return out

    def restore(self, arrays: list[np.ndarray]) -> None:
        *self.tables, self.kernel, self.bias, self.out, base = arrays
        self.base = base[0]

    def values(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embeddings, filter values) at each word; windows reach past a text's end into rows without words."""
        x = np.concatenate([t[r] for t, r in zip(self.tables, rows, strict=True)], axis=1)
        y, z, at = x @ self.kernel, np.empty((len(x), _N), np.float32), 0
        for w in range(WIDTHS):
            own = z[:, w * FILTERS : (w + 1) * FILTERS]
            own[:] = self.bias[w * FILTERS : (w + 1) * FILTERS]
            for k in range(w + 1):
                own[: len(x) - k] += y[k:, at : at + FILTERS]
                at += FILTERS
        z[rows[0] == _ROWS] = 0
        return x, z

    def pooled(self, texts: list[Text]) -> np.ndarray:
        """The largest value of each filter over each text, at least 0."""
        out = np.zeros((len(texts), _N), np.float32)
        group: list[tuple[int, np.ndarray]] = []
        size = 0

        def done() -> None:
            rows, begins = _joined([g[1] for g in group])
            z = self.values(rows)[1]
            for (_, t), b in zip(group, begins, strict=True):
                z[b + PIECE_WORDS : b + t.shape[1]] = 0  # windows that begin in the next piece
            np.maximum.at(out, [g[0] for g in group], np.maximum.reduceat(z, begins, axis=0))

        for i, t in enumerate(texts):
            for a in range(0, t.rows.shape[1], PIECE_WORDS):
                group.append((i, t.rows[:, a : a + PIECE_WORDS + WIDTHS - 1]))
                size += group[-1][1].shape[1]
                if size >= PIECE_WORDS:
                    done()
                    group, size = [], 0
        if group:
            done()
        return out

    def probability(self, texts: list[Text]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(texts) @ self.out + self.base, -30, 30).astype(np.float64)))


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, rows without words between them, and where they begin."""
    gap = np.full((len(BEGINNINGS) + 1, WIDTHS - 1), _ROWS, np.int32)
    begins = np.cumsum([0, *(t.shape[1] + WIDTHS - 1 for t in texts[:-1])])
    return np.concatenate([y for x in texts for y in (x, gap)], axis=1), begins


class _Trainer:
    """Adagrad on batches of texts."""

    def __init__(self, net: Filters):
        self.net, self.sums = net, [np.full(a.shape, 1e-3, np.float32) for a in net.arrays()]

    def _step(self, k: int, array: np.ndarray, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.sums[k][rows] += grad * grad
        array[rows] -= RATE * grad / np.sqrt(self.sums[k][rows])

    def batch(self, texts: list[Text], labels: np.ndarray) -> None:
        net = self.net
        rows, begins = _joined([t.rows for t in texts])
        x, z = net.values(rows)
        most = np.maximum.reduceat(z, begins, axis=0)
        p = np.maximum(most, 0)
        error = (1 / (1 + np.exp(-np.clip(p @ net.out + net.base, -30, 30))) - labels).astype(np.float32) / len(labels)
        # The first place where each filter is largest over each text.
        text, f = np.nonzero((most > 0) & (error[:, None] != 0))
        ends = np.append(begins[1:], len(z))
        at = np.array([b + int(np.argmax(z[b:e, k])) for b, e, k in zip(begins[text], ends[text], f, strict=True)], np.int64)
        slope = error[text] * net.out[f]
        kernel, bias, gx, places = np.zeros_like(net.kernel), np.zeros_like(net.bias), [], []
        np.add.at(bias, f, slope)
        for w in range(WIDTHS):
            own = np.flatnonzero(f // FILTERS == w)
            begin = FILTERS * w * (w + 1) // 2
            for k in range(w + 1):
                col, src = begin + k * FILTERS + f[own] % FILTERS, np.minimum(at[own] + k, len(x) - 1)
                inside = at[own] + k < len(x)
                col, src, g = col[inside], src[inside], slope[own][inside, None]
                np.add.at(kernel.T, col, g * x[src])
                gx.append(g * net.kernel.T[col])
                places.append(src)
        n = len(net.tables)
        self._step(n, net.kernel, kernel + DECAY * net.kernel)
        self._step(n + 1, net.bias, bias)
        self._step(n + 2, net.out, error @ p + DECAY * net.out)
        base = np.atleast_1d(net.base)
        self._step(n + 3, base, np.atleast_1d(error.sum()))
        net.base = base[0]
        g, src = np.concatenate(gx), np.concatenate(places)
        for k, table in enumerate(net.tables):
            met, inverse = np.unique(rows[k][src], return_inverse=True)
            grad = np.zeros((len(met), WIDTH), np.float32)
            np.add.at(grad, inverse, g[:, k * WIDTH : (k + 1) * WIDTH])
            # Words that too few texts hold, and places without words, stay 0.
            good = table[met].any(axis=1)
            self._step(k, table, grad[good], met[good])


class Languages:
    """Naive Bayes over hashed words."""

    def __init__(self, bags: list[np.ndarray], langs: list[str]):
        n = {x: langs.count(x) for x in set(langs)}
        self.names = sorted(n, key=lambda x: (-n[x], x))[:MOST_LANGUAGES] or ["und"]
        counts = np.full((1 << LANGUAGE_BITS, len(self.names)), 0.1)
        at = {x: k for k, x in enumerate(self.names)}
        for bag, lang in zip(bags, langs, strict=True):
            if lang in at:
                counts[:, at[lang]] += bag
        self._costs(counts)

    @classmethod
    def counted(cls, names: list[str], counts: np.ndarray) -> Languages:
        """From the counts of every bucket and language; the commonest language is first."""
        out = cls.__new__(cls)
        out.names = names
        out._costs(counts + 0.1)
        return out

    def _costs(self, counts: np.ndarray) -> None:
        self.costs = np.log(counts / counts.sum(axis=0)).astype(np.float32)

    def of(self, texts: list[Text]) -> np.ndarray:
        """The likeliest language's number of each text, the commonest for a text without words."""
        return np.array([int(np.argmax(t.bag @ self.costs)) if t.rows.shape[1] else 0 for t in texts], np.int64)


def _threshold(p: np.ndarray, label: np.ndarray) -> float:
    """Halfway below the probability from which F1 is best."""
    order = np.argsort(-p, kind="stable")
    p, label = p[order], label[order]
    hit = np.cumsum(label)
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + max(hit[-1], 1))
    f1[:-1][p[:-1] == p[1:]] = -1  # no cut between equal ones
    k = int(np.argmax(f1))
    below = p[k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[k] + below) / 2, 0.02, 0.98))


def _step_threshold(low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The same from steps of probability: the least and largest in each, how many and how many positives."""
    order = np.argsort(-high, kind="stable")
    low, high, n, hit = low[order], high[order], np.cumsum(n[order]), np.cumsum(hits[order])
    k = int(np.argmax(2 * hit / (n + max(hit[-1], 1))))
    return float(np.clip((low[k] + (high[k + 1] if k + 1 < len(low) else 0.0)) / 2, 0.02, 0.98))


def _odds(seen: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log-odds of rows from how many texts of either label hold them; NaN where too few do."""
    share = (seen + SMOOTH) / (size[:, None] + 2 * SMOOTH)
    return np.where(seen.sum(axis=0) >= KNOWN_TEXTS, np.log(share[1] / share[0]), np.nan)


class Model:
    """The filters, the languages and their thresholds."""

    @classmethod
    def of(cls, languages: Languages, net: Filters, thresholds: np.ndarray, empty: bool) -> Model:
        out = cls.__new__(cls)
        out.languages, out.net, out.thresholds, out.empty = languages, net, thresholds, empty
        return out

    def __init__(self, texts: list[Text], labels: np.ndarray, langs: list[str]):
        apart = np.arange(len(texts)) % CALIBRATE_EVERY == CALIBRATE_EVERY - 1
        learn, test = np.flatnonzero(~apart), np.flatnonzero(apart)
        self.languages = Languages([texts[k].bag for k in learn], [langs[k] for k in learn])
        odds = []
        for c in range(len(BEGINNINGS) + 1):
            seen = np.zeros((2, _ROWS), np.int32)
            for k in learn:
                seen[int(labels[k] > 0), np.unique(texts[k].rows[c])] += 1
            odds.append(_odds(seen, np.bincount((labels[learn] > 0).astype(int), minlength=2)))
        self.net = Filters(odds, float(labels[learn].mean()) if len(learn) else 0.0)
        self.empty = not len(texts)
        if len(learn) and 0 < labels[learn].sum() < len(learn):
            self._train([texts[k] for k in learn], labels[learn], [texts[k] for k in test], labels[test])
        held = [texts[k] for k in test] or texts
        truth = labels[test] if len(test) else labels
        p, lang = self.net.probability(held), self.languages.of(held)
        whole = _threshold(p, truth) if len(held) and truth.any() else 0.5
        self.thresholds = np.full(len(self.languages.names), whole)
        for k in range(len(self.thresholds)):
            own = lang == k
            if truth[own].sum() >= CALIBRATE:
                self.thresholds[k] = _threshold(p[own], truth[own])

    def _train(self, texts: list[Text], labels: np.ndarray, held: list[Text], truth: np.ndarray) -> None:
        r, trainer, best = np.random.default_rng(SEED), _Trainer(self.net), (np.inf, self.net.copy())
        for _ in range(EPOCHS):
            order = r.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                some = order[a : a + BATCH]
                trainer.batch([texts[k] for k in some], labels[some])
            p = np.clip(self.net.probability(held or texts), 1e-6, 1 - 1e-6)
            t = truth if held else labels
            loss = float(-np.mean(np.where(t > 0, np.log(p), np.log1p(-p))))
            if loss < best[0]:
                best = (loss, self.net.copy())
        self.net.restore(best[1])

    def scores(self, texts: list[Text]) -> np.ndarray:
        """Probabilities, bent so that each language's threshold is 0.5."""
        if self.empty or not texts:
            return np.zeros(len(texts))
        p, t = self.net.probability(texts), self.thresholds[self.languages.of(texts)]
        return np.where(p < t, p / (2 * t), 0.5 + (p - t) / (2 * (1 - t)))


def _texts(batch: pa.RecordBatch, bags: bool = False) -> list[Text]:
    """The stored texts of a batch, whose first columns are rows, bucket and count; without bags these are empty."""
    if not bags:
        return [Text(r.values.to_numpy().reshape(len(BEGINNINGS) + 1, -1), np.empty(0, np.float32)) for r in batch.column(0)]
    out = []
    for r, b, c in zip(*(batch.column(k) for k in range(3)), strict=True):
        bag = np.zeros(1 << LANGUAGE_BITS, np.float32)
        bag[b.values.to_numpy()] = c.values.to_numpy()
        out.append(Text(r.values.to_numpy().reshape(len(BEGINNINGS) + 1, -1), bag))
    return out


def _counted(learn: DataFrame) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(texts of either label that hold each row of each table, languages, counts of each bucket and language)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, (len(BEGINNINGS) + 1) * _ROWS), np.int64)
        for batch in batches:
            for t, label in zip(_texts(batch), batch.column("label").to_pylist(), strict=True):
                for c, own in enumerate(t.rows):
                    seen[int(label > 0), c * _ROWS + np.unique(own)] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["at", "clean", "toxic"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for at, n, lang in zip(batch.column("bucket"), batch.column("count"), batch.column("lang").to_pylist(), strict=True):
                # Buckets of a text are distinct.
                counts.setdefault(lang, np.zeros(1 << LANGUAGE_BITS))[at.values.to_numpy()] += n.values.to_numpy()
        for lang, bag in counts.items():
            at = np.flatnonzero(bag)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(bag[at])], ["lang", "bucket", "n"])

    met = learn.mapInArrow(rows, "at long, clean long, toxic long").groupBy("at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # a row of the tables each
    seen = np.zeros((2, (len(BEGINNINGS) + 1) * _ROWS), np.int64)
    for k, name in enumerate(("clean", "toxic")):
        seen[k, met["at"].to_numpy()] = met[name].to_numpy()
    common = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    names = [r["lang"] for r in common.collect()] or ["und"]
    known = learn.where(F.col("lang").isin(names)).mapInArrow(words, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts, place = np.zeros((1 << LANGUAGE_BITS, len(names))), {x: k for k, x in enumerate(names)}
    counts[known["bucket"].to_numpy(), [place[x] for x in known["lang"].to_pylist()]] = known["n"].to_numpy()
    return seen.reshape(2, len(BEGINNINGS) + 1, _ROWS), names, counts


def _epoch(learn: DataFrame, arrays: list[np.ndarray], sums: list[np.ndarray]) -> None:
    """Train copies of the numbers in the tasks, and add what they changed on average; sums are Adagrad's."""
    sent = learn.sparkSession.sparkContext.broadcast((arrays, sums))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, before_sums = sent.value
        net = Filters.of([a.copy() for a in before])
        trainer, texts, labels = _Trainer(net), [], []
        trainer.sums = [a.copy() for a in before_sums]
        for batch in batches:
            texts += _texts(batch)
            labels += batch.column("label").to_pylist()
            while len(texts) >= BATCH:
                trainer.batch(texts[:BATCH], np.array(labels[:BATCH]))
                del texts[:BATCH], labels[:BATCH]
        if texts:
            trainer.batch(texts, np.array(labels))
        part = TaskContext.get().partitionId()
        for k, (a, b, x, y) in enumerate(zip(net.arrays(), before, trainer.sums, before_sums, strict=True)):
            moved, grown = ((p - q).reshape(len(p), -1) for p, q in ((a, b), (x, y)))
            for at in range(0, len(moved), CHUNK_ROWS):
                own = at + np.flatnonzero(grown[at : at + CHUNK_ROWS].any(axis=1))
                if len(own):
                    lists = [pa.array([c], pa.list_(kind)) for c, kind in ((own.astype(np.int32), pa.int32()), (moved[own].reshape(-1), pa.float32()), (grown[own].reshape(-1), pa.float32()))]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([part], pa.int32()), *lists], ["k", "chunk", "part", "at", "moved", "grown"])

    schema = "k int, chunk int, part int, at array<int>, moved array<float>, grown array<float>"

    def mean(changes: pa.Table) -> pa.Table:
        changes = changes.sort_by("part").combine_chunks()
        at = np.concatenate([x.values.to_numpy() for x in changes["at"]])
        ids, inverse, n = np.unique(at, return_inverse=True, return_counts=True)
        lists = [pa.array([ids], pa.list_(pa.int32()))]
        for name in ("moved", "grown"):
            x = np.concatenate([v.values.to_numpy() for v in changes[name]]).reshape(len(at), -1)
            total = np.zeros((len(ids), x.shape[1]))
            np.add.at(total, inverse, x)
            lists.append(pa.array([(total / n[:, None]).astype(np.float32).reshape(-1)], pa.list_(pa.float32())))
        return pa.table([changes["k"].slice(0, 1), changes["chunk"].slice(0, 1), pa.array([0], pa.int32()), *lists], ["k", "chunk", "part", "at", "moved", "grown"])

    for r in learn.mapInArrow(train, schema).groupBy("k", "chunk").applyInArrow(mean, schema).toArrow().to_batches():  # as much as the model
        for k, at, moved, grown in zip(*(r.column(c) for c in ("k", "at", "moved", "grown")), strict=True):
            k, at = k.as_py(), at.values.to_numpy()
            for a, x in ((arrays[k], moved), (sums[k], grown)):
                a[at] += x.values.to_numpy().reshape(len(at), *a.shape[1:])
    sent.destroy()


def _scored(held: DataFrame, net: Filters, languages: Languages | None = None) -> DataFrame:
    """(lang, p, label): the number of the language that a text has by its words, if languages are given, and its probability."""
    sent = held.sparkSession.sparkContext.broadcast((net, languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, languages = sent.value
        for batch in batches:
            if batch.num_rows:
                texts = _texts(batch, bags=languages is not None)
                lang = languages.of(texts) if languages else np.zeros(len(texts), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(net.probability(texts)), batch.column("label")], ["lang", "p", "label"])

    return held.mapInArrow(run, "lang long, p double, label double")


def _loss(held: DataFrame, net: Filters) -> float:
    p = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    return -_scored(held, net).agg(F.avg(F.when(F.col("label") > 0, F.log(p)).otherwise(F.log1p(-p)))).first()[0]


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", most: int | None = None, most_words: int | None = None) -> Model:
    """Train on all labelled rows; labels is (id, label).

    A caller who wants a model of fewer rows gives most, of smallest hash of the id, or
    most_words, which these may have together.
    """
    prepare(docs.sparkSession)
    named = labels.select(F.col(labels.columns[0]).alias("id"), F.col(labels.columns[1]).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    named = named.groupBy("id").agg(F.min("label").alias("label")).withColumn("o", F.xxhash64("id"))
    if most is not None:
        named = named.orderBy("o", "id").limit(most)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")).join(named, "id")
    src = found.groupBy("o", "id").agg(F.min(F.struct("text", "lang")).alias("row"), F.min("label").alias("label")).select("row.text", "row.lang", F.col("label").cast("double").alias("label"), "o", F.col("id").cast("string").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(w) for w in B.words(batch.column(0), B.ALNUM, fold=True)]
            lists = [pa.array([t.rows.reshape(-1) for t in texts], pa.list_(pa.int32())), pa.array([np.flatnonzero(t.bag).astype(np.int32) for t in texts], pa.list_(pa.int32())), pa.array([t.bag[t.bag > 0] for t in texts], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([t.rows.shape[1] for t in texts], pa.int64()), *batch.columns[1:]], ["rows", "bucket", "count", "n", "lang", "label", "o", "id"])

    # By the hash, so that a task's texts are as all are, in an order drawn once.
    table = src.sortWithinPartitions("o", "id").mapInArrow(run, "rows array<int>, bucket array<int>, count array<float>, n long, lang string, label double, o long, id string")
    if most_words is not None:
        table = table.withColumn("n", F.sum("n").over(Window.orderBy("o", "id"))).where(F.col("n") <= most_words)
    table = cut(table.withColumn("apart", F.pmod(F.xxhash64("o", F.lit("apart")), F.lit(CALIBRATE_EVERY)) == 0).drop("id"), "toxicity-rows")
    learn, held = table.where("NOT apart"), table.where("apart")
    size = {r["apart"]: r for r in table.groupBy("apart").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") > 0).alias("hits")).collect()}
    n, hits = (size[False]["n"], size[False]["hits"]) if False in size else (0, 0)
    if True not in size:
        held = learn
    learn = learn.coalesce(min(MOST_SHARDS, max(1, -(-n // SHARD_ROWS))))
    seen, names, counts = _counted(learn)
    languages = Languages.counted(names, counts)
    net = Filters([_odds(x, np.array([n - hits, hits])) for x in seen.transpose(1, 0, 2)], hits / n if n else 0.0)
    if 0 < hits < n:
        arrays = net.copy()
        sums, best = [np.full(a.shape, 1e-3, np.float32) for a in arrays], np.inf
        for _ in range(EPOCHS):
            _epoch(learn, arrays, sums)
            loss = _loss(held, Filters.of(arrays))
            gain, best = best - loss, min(best, loss)
            if gain > 0:
                net.restore([a.copy() for a in arrays])
            if gain < LEAST_GAIN:
                break
    steps = _scored(held, net, languages).groupBy("lang", F.floor(F.col("p") * STEPS).alias("step"))
    steps = steps.agg(F.min("p").alias("low"), F.max("p").alias("high"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") > 0).alias("hits")).toArrow()  # STEPS for each language at most
    by = {c: steps[c].to_numpy() for c in steps.column_names}
    every = np.ones(len(by["n"]), bool)
    over = lambda own: _step_threshold(*(by[c][own] for c in ("low", "high", "n", "hits")))
    thresholds = np.full(len(names), over(every) if by["hits"].sum() else 0.5)
    for k in range(len(names)):
        if by["hits"][by["lang"] == k].sum() >= CALIBRATE:
            thresholds[k] = over(by["lang"] == k)
    return Model.of(languages, net, thresholds, not size)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """A score beside all other columns but the text."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != text_col]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            out, group, size = [], [], 0
            for w in B.words(batch.column(text_col), B.ALNUM, fold=True):
                group.append(text_of(w))
                size += len(w.hashes)
                if size >= PIECE_WORDS or len(group) == 256:
                    out.append(model.scores(group))
                    group, size = [], 0
            if group:
                out.append(model.scores(group))
            values = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(values, pa.float64())], [*rest, "score"])

    return docs.mapInArrow(run, f"{kinds}, score double")
