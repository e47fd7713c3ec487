"""Language identification by prediction by partial matching.

For each language a context tree over bytes holds how often each byte follows the
contexts of ORDER bytes and of all fewer, down to none. A byte costs -log2 of its share
of its longest context in the language (method C: n symbols seen, d distinct ones, a
seen symbol has count / (n + d)); where the context doesn't have it, an escape of
d / (n + d) is paid and the next shorter context asked, in the end a flat 1/256. A
context never seen costs nothing and is skipped. The statistics are frozen: scoring
doesn't update them.

The tree is sparse: of each order the runs (context and byte) that training saw, as
sorted numbers, with their cost in every language, escapes included, worked out once;
and the cost of leaving each context. A place of a text is looked up in the longest
order; only where that doesn't have it, the next one is.

Counting covers all training rows and combines within batches and map-side. Of what it
gives, a model takes whole contexts, the commonest of each order and language, with at
most MODEL_RUNS runs an order in all: that bounds what the driver gathers and the
workers hold at any number of languages and documents, and each language's share falls
with their number only. What is kept has the counts of the whole training data, so its
code lengths are exact; a context that is left out is one never seen, and its language
goes on from the next shorter one. The shortest context always stays. Which contexts
are taken is found from a table of how many runs lie in contexts of about how many
counts.

Languages are scored in groups of GROUP: a run's costs in its group lie side by side,
so that one look-up serves them all, and no row is wider than that.

Cases: a null text, or one without a letter, is 'und' with score 0, as is any text if
nothing was learned; equal code lengths go to the first language by code point;
repeated rows count and are scored as documents of their own; a null id is hashed as
the empty text; further columns are ignored; an empty table gives an empty result; a
very long text is learned and scored whole, a piece at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm import bytetext as B
from evigraph.llm.shared import cut, map_batches, prepare

UNKNOWN = "und"
#: Bytes of the longest context.
ORDER = 4
#: Runs that a model holds of an order, each language's counted on its own.
MODEL_RUNS = 1 << 21
#: Languages whose costs lie side by side: an order takes 64 MB at most.
GROUP = 8
_LETTER = re.compile(r"[^\W\d_]")
#: Every text is scored, and learned, after this context.
_START = 0x20


#: A-Z are lower-cased; ASCII bytes that are no letters are blanks, since they tell
#: how a text is set rather than its language.
_PLAIN = np.where((B.FOLD >= 0x61) & (B.FOLD <= 0x7A) | (B.FOLD >= 0x80), B.FOLD, 0x20).astype(np.uint8)


def _plain(data: np.ndarray, after: int = _START) -> np.ndarray:
    """The bytes that count, of those that come after a byte; of blanks in a row the first."""
    plain = _PLAIN[data]
    blank = plain == 0x20
    keep = ~blank
    keep[:1] |= after != 0x20
    keep[1:] |= ~blank[:-1]
    return plain[keep]


def _runs(plain: np.ndarray, order: int) -> np.ndarray:
    """The runs of order + 1 bytes that end at each place, as numbers."""
    x = np.full(len(plain) + order, _START, np.int64)
    x[order:] = plain
    out = np.zeros(len(plain), np.int64)
    for k in range(order + 1):
        out <<= 8
        out |= x[k : k + len(plain)]
    return out


def _pieces(data: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """The runs of a text, some hundred thousand at a time."""
    before = np.empty(0, np.uint8)
    for at in range(0, len(data), B.PIECE):
        plain = _plain(data[at : at + B.PIECE], int(before[-1]) if len(before) else _START)
        yield _runs(np.concatenate([before, plain]), order)[len(before) :]
        before = np.concatenate([before, plain])[-order - 1 :]


def counts(docs: DataFrame, lang_col: str, text_col: str, order: int = ORDER) -> DataFrame:
    """(lang, size, run, n) over all rows with a language and a text: runs of 1 to order + 1 bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = batch.column(0).to_pylist()
        raw, at = B.buffers(batch.column(1))
        by: dict[str, list] = {}
        for k, lang in enumerate(langs):
            for runs in _pieces(raw[at[k] : at[k + 1]], order):
                held = by.setdefault(lang, [np.empty(0, np.int64), np.empty(0, np.int64), [], 0])
                held[2].append(runs)
                held[3] += len(runs)
                if held[3] > 8 * B.PIECE:
                    _combine(held)
        out = []
        for lang, held in by.items():
            _combine(held)
            out.append((lang, held[0], held[1]))
        names = pa.array([lang for lang, _, _ in out], pa.string())
        of = np.repeat(np.arange(len(out)), [len(keys) for _, keys, _ in out])
        none = np.empty(0, np.int64)
        keys, n = (np.concatenate([x[k] for x in out] or [none]) for k in (1, 2))
        return pa.RecordBatch.from_arrays([names.take(pa.array(of, pa.int64())), pa.array(keys), pa.array(n)], ["lang", "run", "n"])

    src = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    whole = map_batches(src, run, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    # The last bytes of a run are the runs of the lower orders.
    sizes = F.explode(F.array(*[F.struct(F.lit(k).alias("size"), F.col("run").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("run")) for k in range(1, order + 2)])).alias("r")
    return whole.select("lang", "n", sizes).groupBy("lang", "r.size", "r.run").agg(F.sum("n").alias("n"))


def _combine(held: list) -> None:
    if held[2]:
        keys, n = np.unique(np.concatenate(held[2]), return_counts=True)
        keys = np.concatenate([held[0], keys])
        n = np.concatenate([held[1], n])
        held[0], back = np.unique(keys, return_inverse=True)
        held[1] = np.bincount(back, weights=n).astype(np.int64)
        held[2], held[3] = [], 0


class Lookup:
    """Rows of sorted distinct numbers: by a table of hash slots, by search where several share one."""

    NONE, SEVERAL = -1, -2
    _MUL = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(6, int(8 * max(len(keys), 1)).bit_length())
        self.shift = np.uint64(64 - bits)
        slot = self._slot(keys)
        n = np.bincount(slot, minlength=1 << bits)
        self.rows = np.where(n > 1, self.SEVERAL, self.NONE).astype(np.int32)
        alone = n[slot] == 1
        self.rows[slot[alone]] = np.flatnonzero(alone)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self._MUL) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each number, negative for those that aren't there."""
        if not len(self.keys):
            return np.full(len(keys), self.NONE, np.int32)
        rows = self.rows[self._slot(keys)]
        several = np.flatnonzero(rows == self.SEVERAL)
        if len(several):
            rows[several] = np.minimum(np.searchsorted(self.keys, keys[several]), len(self.keys) - 1)
        rows[(rows < 0) | (self.keys[rows] != keys)] = self.NONE
        return rows


class _Tree:
    """Costs in bits of the runs of each size, a column for each language of a group."""

    def __init__(self, width: int, order: int, sizes: np.ndarray, runs: np.ndarray, of: np.ndarray, n: np.ndarray):
        """A row for each (size, run, language) that was seen: its language's column, and its count."""
        self.width = width
        self.runs: list[Lookup] = []
        self.costs: list[np.ndarray] = []
        self.contexts: list[Lookup] = []
        self.escapes: list[np.ndarray] = []
        for size in range(1, order + 2):
            here = np.flatnonzero(sizes == size)
            keys, at = np.unique(runs[here], return_inverse=True)
            context, to = np.unique(keys >> 8, return_inverse=True)
            cell = to[at] * width + of[here]  # a context in a language
            total = np.bincount(cell, weights=n[here], minlength=len(context) * width)
            distinct = np.bincount(cell, minlength=len(context) * width)
            escape = np.zeros(len(total), np.float32)
            seen = np.flatnonzero(distinct)
            escape[seen] = np.log2((total[seen] + distinct[seen]) / distinct[seen])
            self.escapes.append(escape.reshape(-1, width))
            below = self.cost(keys & ((1 << 8 * (size - 1)) - 1), size - 1) if size > 1 else np.full((len(keys), width), 8.0, np.float32)
            below += self.escapes[-1][to]
            below[at, of[here]] = np.log2((total[cell] + distinct[cell]) / n[here])
            self.runs.append(Lookup(keys))
            self.costs.append(below)
            self.contexts.append(Lookup(context))

    def cost(self, runs: np.ndarray, size: int) -> np.ndarray:
        """The cost of each run of some bytes in each language of the group."""
        out = np.zeros((len(runs), self.width), np.float32)
        open_: np.ndarray | slice = slice(None)
        for k in range(size - 1, -1, -1):
            at = self.runs[k].find(runs)
            hit = at >= 0
            places = np.arange(len(out))[open_]
            out[places[hit]] += self.costs[k][at[hit]]
            open_, runs = places[~hit], runs[~hit]
            if not len(open_):
                return out
            at = self.contexts[k].find(runs >> 8)
            hit = at >= 0
            out[open_[hit]] += self.escapes[k][at[hit]]
            runs = runs & ((1 << 8 * k) - 1)
        out[open_] += np.float32(8.0)
        return out


class Model:
    """Code lengths of texts in each language."""

    def __init__(self, langs: list[str], sizes: np.ndarray, runs: np.ndarray, of: np.ndarray, n: np.ndarray):
        """A row for each (size, run, language) that was seen: its language's place in langs, and its count."""
        self.langs, self.order = langs, int(sizes.max(initial=1)) - 1
        self.trees = []
        for first in range(0, len(langs), GROUP):
            here = (of >= first) & (of < first + GROUP)
            width = min(GROUP, len(langs) - first)
            self.trees.append(_Tree(width, self.order, sizes[here], runs[here], of[here] - first, n[here]))

    def bits(self, data: np.ndarray) -> np.ndarray:
        """The code length of a text in each language."""
        out = np.zeros(len(self.langs))
        for runs in _pieces(data, self.order):
            out += np.concatenate([t.cost(runs, self.order + 1).sum(0, dtype=np.float64) for t in self.trees])
        return out

    def bits_of(self, texts: list[np.ndarray]) -> np.ndarray:
        """The code lengths of some texts, short ones at once."""
        out = np.zeros((len(texts), len(self.langs)))
        parts, of = [], []
        for k, data in enumerate(texts):
            if len(data) > B.PIECE:
                out[k] = self.bits(data)
            else:
                parts.append(_runs(_plain(data), self.order) if len(data) else np.empty(0, np.int64))
                of.append(k)
        lengths = np.array([len(p) for p in parts], np.int64)
        filled = np.flatnonzero(lengths)
        if len(filled):
            runs = np.concatenate(parts)
            starts = np.concatenate([[0], np.cumsum(lengths[filled])[:-1]])
            out[np.array(of)[filled]] = np.concatenate([np.add.reduceat(t.cost(runs, self.order + 1), starts, axis=0, dtype=np.float64) for t in self.trees], axis=1)
        return out

    def predict(self, bits: np.ndarray) -> tuple[str, float]:
        """The language of the shortest code, and its posterior under equal priors."""
        best = int(np.argmin(bits))
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER, most: int = MODEL_RUNS) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Languages, and the sizes, runs, languages' places and counts of the runs that a model takes."""
    # A context has 256 runs at most.
    context = Window.partitionBy("lang", "size", F.shiftright("run", 8))
    table = cut(counts(docs, lang_col, text_col, order).withColumn("seen", F.sum("n").over(context)), "runs")
    # How many runs lie in contexts of about how many counts, by steps of a quarter of a power of two.
    level = F.floor(F.log2("seen") * 4).cast("int")
    steps = table.groupBy("lang", "size", level.alias("level")).agg(F.count(F.lit(1)).alias("runs")).collect()
    langs = sorted({r["lang"] for r in steps})
    share, least = most // max(len(langs), 1), {}
    for lang, size in {(r["lang"], r["size"]) for r in steps}:
        held, least[lang, size] = 0, 0
        for r in sorted((r for r in steps if (r["lang"], r["size"]) == (lang, size)), key=lambda r: -r["level"]):
            held += r["runs"]
            if held > share and size > 1:
                least[lang, size] = r["level"] + 1
                break
    spark = docs.sparkSession
    floors = spark.createDataFrame([(*k, v) for k, v in sorted(least.items())], "lang string, size int, least int")
    kept = table.join(F.broadcast(floors), ["lang", "size"]).where(level >= F.col("least")).select("lang", "size", "run", "n").toArrow()
    place = {x: k for k, x in enumerate(langs)}
    of = np.fromiter((place[x] for x in kept.column("lang").to_pylist()), np.int32, kept.num_rows)
    return langs, kept.column("size").to_numpy(), kept.column("run").to_numpy(), of, kept.column("n").to_numpy()


_models: dict[str, Model] = {}


def _model(sent) -> Model:
    name, *learned = sent.value
    if name not in _models:
        _models.clear()
        _models[name] = Model(*learned)
    return _models[name]


def predict(docs: DataFrame, learned: tuple, text_col: str = "text") -> DataFrame:
    """lang_pred and score beside all other columns but the text."""
    import uuid

    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, *learned))
    rest = [c for c in docs.columns if c != text_col]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = _model(sent)
        texts = batch.column(text_col)
        raw, at = B.buffers(texts)
        langs, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
        said = [k for k in range(batch.num_rows) if model.langs and _has_letter(raw[at[k] : at[k + 1]])]
        first = 0
        while first < len(said):  # some texts at a time
            stop, held = first, 0
            while stop < len(said) and (stop == first or held < B.PIECE):
                held += int(at[said[stop] + 1] - at[said[stop]])
                stop += 1
            some = said[first:stop]
            for k, bits in zip(some, model.bits_of([raw[at[k] : at[k + 1]] for k in some]), strict=True):
                langs[k], scores[k] = model.predict(bits)
            first = stop
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*rest, "lang_pred", "score"])

    return map_batches(docs, run, f"{kinds}, lang_pred string, score double")


def _has_letter(data: np.ndarray) -> bool:
    """Whether a text has a letter, looked for a piece at a time."""
    at = 0
    while at < len(data):
        stop = min(at + (64 if not at else B.PIECE), len(data))
        while stop < len(data) and not B.LEAD[data[stop]]:  # no code point is cut
            stop += 1
        if _LETTER.search(data[at:stop].tobytes().decode()):
            return True
        at = stop
    return False


def fold(id_col: Column | str, n: int) -> Column:
    """crc32 of an id as text, modulo n."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learns from those not held out."""
    prepare(docs.sparkSession)
    learned = learn(docs.where(fold(id_col, 3) != 1), lang_col, text_col)
    src = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return predict(src, learned)
