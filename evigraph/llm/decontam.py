"""Benchmark decontamination by a prefix-filtered set join.

A window is ``size`` consecutive words of an item (an item of fewer words is one
window). Its shingles are its runs of up to 3 words. To lie in a text, a window needs
all its shingles there, so under containment 1 its necessary prefix is one shingle:
the one that fewest places of the corpus have. The corpus is read twice: to count the
benchmark's shingles, and to emit the places of prefix shingles with the words around
them. Those are joined with the prefixes; a length bound (the words left in the text)
and a positional bound (the shingle's place in the window) go before the exact
comparison of the window's words.

What is broadcast is a bitmap of ``FILTER_BITS`` bits, whatever the benchmark's size:
it lets through all shingles of the benchmark and some others, which the join drops.

Cases: a null or empty text or item has no words: nothing is hit; windows that several
items share count for each; repeated rows give repeated results; further columns are
ignored; empty tables give an empty result or one without hits; a null item_id names
no item, its words still count as hits. A very long text is scanned whole: its places
leave as rows, some thousand at a time, and their union is summed up in order of their
starts, so no list of them is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm import bytetext as B
from evigraph.llm.shared import cut, map_batches, prepare

SIZE, SHINGLE = 10, 3
FILTER_BITS = 1 << 26
#: Places in a batch of rows.
PLACES = 4096
_SHIFT = B.U64(64 - 26)


def _word_list(w: B.Words, a: int, b: int) -> list[str]:
    """Words a to b of a text, A-Z lower-cased."""
    raw = B.FOLD[w.data[w.starts[a] : w.ends[b - 1]]].tobytes()
    o = w.starts[a]
    return [raw[s - o : e - o].decode() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)]


def windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words, shingles) of every window, the shingles as hashes in order."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts, keys = [], [], []
        for w in B.words(batch.column(1), B.ALNUM, fold=True):
            n = len(w.hashes)
            if not n:
                continue
            item, all_words = batch.column(0)[w.row].as_py(), _word_list(w, 0, n)
            short = min(n, size)
            hashes = B.grams(w.hashes, min(SHINGLE, n))
            per = short - min(SHINGLE, n) + 1
            for k in range(n - short + 1):
                ids.append(item)
                texts.append(all_words[k : k + short])
                keys.append(B.signed(hashes[k : k + per]))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64()))], ["item_id", "words", "shingles"]
        )

    src = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    return map_batches(src, run, "item_id string, words array<string>, shingles array<long>")


def _filter(shingles: DataFrame):
    """A broadcast bitmap with a bit for each value of ``shingle``; its size is fixed."""
    place = F.shiftrightunsigned("shingle", int(_SHIFT))
    cells = shingles.select(F.shiftright(place, 6).alias("cell"), (place % 64).cast("int").alias("bit"))
    table = cells.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    bitmap[table.column("cell").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return shingles.sparkSession.sparkContext.broadcast(bitmap)


def _passing(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Places of the hashes that the bitmap lets through, looked up some at a time."""
    out = [np.empty(0, np.int64)]
    for first in range(0, len(hashes), B.PIECE):
        at = hashes[first : first + B.PIECE] >> _SHIFT
        out.append(first + np.flatnonzero((bitmap[(at >> B.U64(6)).astype(np.int64)] >> (at & B.U64(63))) & B.U64(1)))
    return np.concatenate(out)


def _all_grams(w: B.Words, lengths: list[int]) -> Iterator[np.ndarray]:
    return (B.grams(w.hashes, n) for n in lengths)


def corpus_counts(docs: DataFrame, shingles: DataFrame, lengths: list[int], text_col: str) -> DataFrame:
    """(shingle, n): how often the corpus has each of the given shingles; absent if never."""
    sent = _filter(shingles)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for w in B.words(batch.column(0), B.ALNUM, fold=True):
            for g in _all_grams(w, lengths):
                found.append(g[_passing(g, sent.value)])
        keys, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(B.signed(keys)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    part = map_batches(docs.select(F.col(text_col).alias("text")), run, "shingle long, n long")
    return part.groupBy("shingle").agg(F.sum("n").alias("n")).join(shingles, "shingle", "left_semi")


def scan(docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items of every row, and its binary key_col if given."""
    prepare(docs.sparkSession)
    wins = cut(windows(items, size, item_id_col, item_text_col), "windows")
    shingles = wins.select(F.explode("shingles").alias("shingle")).distinct()
    # Shingles are SHINGLE words long but for items of fewer words.
    lengths = sorted({min(SHINGLE, r["n"]) for r in wins.groupBy(F.least(F.size("words"), F.lit(SHINGLE)).alias("n")).count().collect()})
    counts = corpus_counts(docs, shingles, lengths, text_col)

    # The rarest shingle of each window; a window with one that the corpus lacks is nowhere.
    named = wins.withColumn("window", F.sha2(F.array_join("words", " "), 256))
    texts = named.groupBy("window").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles"))
    at = texts.select("window", "words", F.size("shingles").alias("needed"), F.posexplode("shingles").alias("offset", "shingle")).join(counts, "shingle")
    rarest = F.min(F.struct("n", "offset", "shingle")).alias("rarest")
    prefix = at.groupBy("window", "needed").agg(rarest, F.count(F.lit(1)).alias("there"), F.first("words").alias("words")).where("there = needed")
    prefix = cut(prefix.select("window", "words", F.size("words").alias("length"), F.col("rarest.offset").alias("offset"), F.col("rarest.shingle").alias("shingle")), "prefixes", wins.count())
    sent = _filter(prefix.select("shingle"))

    # A row for each text, with its number of words, and one for each of its places.
    place = pa.struct([("shingle", pa.int64()), ("place", pa.int64()), ("first", pa.int64()), ("around", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [*batch.schema.names[:1], *batch.schema.names[2:], "n_words", "p"]
            at, n_words, places = [], [], []

            def rows(batch=batch, names=names, at=at, n_words=n_words, places=places) -> pa.RecordBatch:
                own = [batch.column(k).take(pa.array(at, pa.int64())) for k in (0, *range(2, batch.num_columns))]
                return pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), pa.array(places, place)], names)

            for w in B.words(batch.column(1), B.ALNUM, fold=True):
                n = len(w.hashes)
                at.append(w.row)
                n_words.append(n)
                places.append(None)
                for g in _all_grams(w, lengths):
                    for p in _passing(g, sent.value):
                        a, b = max(0, int(p) - size + 1), min(n, int(p) + size)
                        at.append(w.row)
                        n_words.append(n)
                        places.append({"shingle": int(g[p].astype(np.int64)), "place": int(p), "first": a, "around": _word_list(w, a, b)})
                        if len(at) >= PLACES:
                            yield rows()
                            for held in (at, n_words, places):
                                held.clear()
            yield rows()

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"), *([F.col(key_col).alias("key")] if key_col else []))
    kind = src.schema["doc_id"].dataType.simpleString()
    seen = src.mapInArrow(run, f"doc_id {kind}, row long, {'key binary, ' if key_col else ''}n_words long, p struct<shingle: long, place: long, first: long, around: array<string>>")
    seen = cut(seen, "places")

    found = seen.where("p IS NOT NULL")
    cand = found.select("row", "n_words", "p.*").join(prefix, "shingle")
    start = F.col("place") - F.col("offset")
    fits = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    same = F.slice("around", (start - F.col("first") + 1).cast("int"), F.col("length")) == F.col("words")
    hits = cut(cand.where(fits).where(F.when(fits, same)).select("row", "window", start.alias("start"), "length"), "hits", found.count())

    # Words covered by the union of the occurrences: of each, those after all that begin before it.
    spans = hits.select("row", "start", (F.col("start") + F.col("length")).alias("stop")).distinct()
    earlier = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(earlier), F.lit(0)))
    n_hit = spans.select("row", F.greatest(fresh, F.lit(0)).alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    holders = named.where("item_id IS NOT NULL").select("window", "item_id").distinct()
    found = hits.select("row", "window").distinct().join(holders, "window").select("row", "item_id").distinct()
    found = found.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    out = seen.where("p IS NULL").drop("p").join(n_hit, "row", "left").join(found, "row", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), listed.alias("items"), *([F.col("key").alias(key_col)] if key_col else []))


def keep(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with all columns; each row's own text decides."""
    key = "_text_key"
    while key in docs.columns:
        key += "_"
    named = docs.withColumn(key, F.unhex(F.md5("text")))
    bad = scan(named, items, size, key_col=key).where("contaminated").select(key).distinct()
    return named.join(bad, key, "left_anti").select(docs.columns)


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM iw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
dg AS (
  SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {'p': i, 'g': array_to_string(w[i:i + k - 1], ' ')})) AS x
  FROM dw, sizes WHERE len(w) >= k),
hit AS (SELECT dg.doc_id, dg.x.p AS p, dg.k, win.item_id FROM dg JOIN win ON dg.k = win.k AND dg.x.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
itm AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN itm USING (doc_id)
"""
