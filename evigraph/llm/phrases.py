"""Collocations: the phrases of two to five words that hold together best, per language.

Texts are cut into pieces at stops and line ends and pieces into words. Two scans of the
texts and two joins of what is frequent:

1. Words are counted exactly, pairs of neighbours by hash in 2**FILTER_BITS counters.
   A pair whose counter stays below the least count is rare for certain, and so is every
   phrase with it; the others form a bitmap of fixed size that is broadcast. The bitmap
   saves work only: no frequent phrase can fall through it.
2. Each shard of texts grows count tries of at most DEPTH words over the runs of words
   whose pairs passed. A trie is laid out in sorted order, first by the hash of its
   two-word prefix, and goes out as one serialised run for each range of prefixes. The
   runs of a range meet in one task and are merged there; frequent nodes come out with
   the counts of the nodes above them, which are their left parts.
3. The right parts are the nodes that suffix links lead to, by one join of suffixes
   with nodes. A phrase inside a longer one of equal count shows up there too: as the
   parent of a child, or as a link's end, with the same count.

Words go by 64-bit hashes with their language; that no two words share one is checked
over all of them, and a second hash is taken if they do.

Cases: a null or empty text has no words; a null language is ``und``, together with
texts that say so; rows count as often as they occur, whatever their ids; further columns
are ignored; an empty table gives an empty result; equal scores go by count, then by the
bytes of the phrase; a very long text is counted whole, its tries in parts of SHARD_WORDS
words, with some 40 bytes held a word.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm import bytetext as B
from evigraph.llm.shared import cut, prepare

#: Words in the longest phrase, the least count of a candidate, rows returned a language.
DEPTH, LEAST, TOP = 5, 100, 2000
#: Counters of pairs of words: 2**27 take 16 MB as a bitmap.
FILTER_BITS = 27
#: Words in a trie, and words of the corpus for each range of prefixes.
SHARD_WORDS, RANGE_WORDS = 1 << 20, 1 << 20
#: Nodes that a merge holds beside the merged ones.
PENDING_NODES = 1 << 20
#: Groups in which a language is ranked before the last ranking.
RANK_GROUPS = 256

_BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_WORD = ~(_BREAK | np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8)))

#: Rows, and serialised runs, that are handed over at once.
HAND_ROWS, HAND_RUNS = 1 << 15, 8


def _by(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(batch), rows):
        yield batch.slice(a, rows)


Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def _apart(w: B.Words) -> np.ndarray:
    """Which words are followed by a word of the same piece."""
    out = np.zeros(len(w.starts), bool)
    if len(out) > 1:
        breaks = np.concatenate([np.flatnonzero(_BREAK[w.data[a : a + B.PIECE]]) + a for a in range(0, len(w.data), B.PIECE)])
        piece = np.searchsorted(breaks, w.starts)
        np.equal(piece[1:], piece[:-1], out=out[:-1])
    return out


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return B.mix(first * B.U64(0x9E3779B97F4A7C15) + second)


class _Tokens:
    """Keys of the words of text after text, taken out some at a time."""

    def __init__(self, which: int):
        self.which, self.languages = which, {}

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[str, B.Words, np.ndarray, np.ndarray]]:
        """(language, words, keys, whether the next word is of the same piece) of each text."""
        langs = batch.column(1).to_pylist()
        for w in self._words(batch.column(0)):
            lang = langs[w.row] if langs[w.row] is not None else "und"
            if lang not in self.languages:
                self.languages[lang] = B.U64(xxhash.xxh64_intdigest(lang.encode()))
            if len(w.starts):
                yield lang, w, B.mix(w.hashes ^ self.languages[lang]), _apart(w)

    def _words(self, column: pa.Array) -> Iterator[B.Words]:
        for w in B.words(column, _WORD, fold=True):
            yield w if self.which == 0 else w._replace(hashes=B.span_hashes(w.data, w.starts, w.ends, True, self.which))


def _counts(src: DataFrame, which: int, bits: int) -> DataFrame:
    """(pair, key, lang, word, n) of every shard: words by key, pairs by counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, pairs, held, size = _Tokens(which), [], [], [], 0

        def out() -> pa.RecordBatch:
            key, first, n = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
            begins = np.cumsum([0, *(len(k) for k in keys)])
            text = np.searchsorted(begins, first, "right") - 1
            langs, words = [], []
            for t, k in zip(text.tolist(), (first - begins[text]).tolist(), strict=True):
                lang, data, starts, ends = held[t]
                langs.append(lang)
                words.append(data[starts[k] : ends[k]].tobytes().lower())
            slot, m = np.unique(np.concatenate(pairs), return_counts=True)
            both = lambda a, b: np.concatenate([a.astype(np.int64), b.astype(np.int64)])
            none = pa.nulls(len(slot), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(key) + len(slot)) >= len(key)), pa.array(both(B.signed(key), slot)), pa.concat_arrays([pa.array(langs, pa.string()), none]), pa.concat_arrays([pa.array(words, pa.binary()).cast(pa.string()), none]), pa.array(both(n, m))],
                ["pair", "key", "lang", "word", "n"],
            )

        for batch in batches:
            for lang, w, key, near in tokens.of(batch):
                at = np.flatnonzero(near)
                keys.append(key)
                pairs.append(pair_hash(key[at], key[at + 1]) >> B.U64(64 - bits))
                held.append((lang, w.data, w.starts, w.ends))
                size += len(key)
                if size >= SHARD_WORDS:
                    yield from _by(out(), HAND_ROWS)
                    keys, pairs, held, size = [], [], [], 0
        if keys:
            yield from _by(out(), HAND_ROWS)

    return src.mapInArrow(run, "pair boolean, key long, lang string, word string, n long")


def _bitmap(counts: DataFrame, least: int, bits: int) -> np.ndarray:
    """One bit for each counter of pairs that reaches the least count."""
    # Shards have added up what they hold; hardly any pair is left to combine before the shuffle.
    full = counts.where("pair").select("key", "n").repartition("key").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    place = F.col("key") + 1
    rows = full.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(max(1, (1 << bits) >> 3), np.uint8)
    for r in rows:
        a = (r["b"] - 1) * len(r["bits"])
        out[a : a + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)[: len(out) - a]
    return out


def _same(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def trie(key: np.ndarray, ok: np.ndarray, upto: int, depth: int) -> list[Level]:
    """The count trie of all runs that begin before ``upto``.

    key: words; ok: whether a word and the next may stand in a phrase. Level 2 is (first
    words, second words, counts) in order of their pair's hash; each further level is
    (parents, words, counts) in order of parents and words.
    """
    vocab, w = np.unique(key, return_inverse=True)
    at = np.flatnonzero(ok[:upto])
    a, b = key[at], key[np.minimum(at + 1, len(key) - 1)]
    p = pair_hash(a, b)
    order = np.lexsort((b, a, p))
    new = _same(p[order], a[order], b[order])
    node = np.empty(len(at), np.int64)
    node[order] = np.cumsum(new) - 1
    first = order[new]
    levels = [(a[first], b[first], np.bincount(node, minlength=len(first)))]
    for d in range(3, depth + 1):
        more = at + d - 2 < len(ok)
        more[more] = ok[at[more] + d - 2]
        at, node = at[more], node[more]
        code, node, n = np.unique(node * len(vocab) + w[at + d - 1], return_inverse=True, return_counts=True)
        levels.append((code // max(len(vocab), 1), vocab[code % max(len(vocab), 1)], n))
    return levels


def _ranges(levels: list[Level], n: int) -> Iterator[tuple[int, bytes]]:
    """The serialised part of a trie in each of n ranges of the hash of two-word prefixes."""
    a, b, _ = levels[0]
    home = (pair_hash(a, b) >> B.U64(32)) * B.U64(n) >> B.U64(32)
    cuts = [np.searchsorted(home, np.arange(n + 1, dtype=np.uint64))]
    for parent, _, _ in levels[1:]:
        cuts.append(np.searchsorted(parent, cuts[-1]))
    for r in np.flatnonzero(np.diff(cuts[0])):
        parts, sizes = [], []
        for d, (x, y, m) in enumerate(levels):
            s = slice(cuts[d][r], cuts[d][r + 1])
            x = x[s].astype("<u8") if d == 0 else (x[s] - cuts[d - 1][r]).astype("<u4")
            parts += [x.tobytes(), y[s].astype("<u8").tobytes(), m[s].astype("<u4").tobytes()]
            sizes.append(s.stop - s.start)
        yield int(r), struct.pack(f"<{len(sizes)}I", *sizes) + b"".join(parts)


def _read(run: bytes, depth: int) -> list[Level]:
    at, out = 4 * (depth - 1), []
    for d, n in enumerate(struct.unpack_from(f"<{depth - 1}I", run)):
        level = []
        for kind in ("<u8" if d == 0 else "<u4", "<u8", "<u4"):
            level.append(np.frombuffer(run, kind, n, at))
            at += n * int(kind[2])
        x, y, m = level
        out.append((x if d == 0 else x.astype(np.int64), y, m.astype(np.int64)))
    return out


def merged(tries: list[list[Level]]) -> list[Level]:
    """One trie with the sums of several; their rows are sorted runs, which a stable sort merges."""
    out: list[Level] = []
    node = np.empty(0, np.int64)
    for d in range(len(tries[0])):
        x, y, n = (np.concatenate([t[d][k] for t in tries]) for k in range(3))
        if d:
            begins = np.cumsum([0, *(len(t[d - 1][2]) for t in tries[:-1])])
            x = node[x + np.repeat(begins, [len(t[d][2]) for t in tries])]
            order = np.lexsort((y, x))
            new = _same(x[order], y[order])
        else:
            p = pair_hash(x, y)
            order = np.lexsort((y, x, p))
            new = _same(p[order], x[order], y[order])
        node = np.empty(len(x), np.int64)
        node[order] = np.cumsum(new) - 1
        first = order[new]
        out.append((x[first], y[first], np.add.reduceat(n[order], np.flatnonzero(new)) if len(n) else n))
    return out


def _frequent(levels: list[Level], least: int) -> Iterator[pa.RecordBatch]:
    """(path, a, left, grown) of the nodes that reach the least count, by walks down the trie.

    left: the counts of the nodes above, from two words; grown: a child has the same count.
    """
    x, y, n = levels[0]
    path, left = np.stack([x, y], axis=1), np.empty((len(n), 0), np.int64)
    for d in range(len(levels)):
        best = np.zeros(len(n), np.int64)
        if d + 1 < len(levels):
            np.maximum.at(best, levels[d + 1][0], levels[d + 1][2])
        at = np.flatnonzero(n >= least)
        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m[at]).reshape(-1).view(np.int64)))
        if len(at):
            yield pa.RecordBatch.from_arrays([lists(path), pa.array(n[at]), lists(left), pa.array(best[at] == n[at])], ["path", "a", "left", "grown"])
        if d + 1 < len(levels):
            parent, word, m = levels[d + 1]
            path, left, n = np.column_stack([path[parent], word]), np.column_stack([left[parent], n[parent]]), m


def _nodes(src: DataFrame, which: int, passed: np.ndarray, bits: int, ranges: int, least: int, depth: int) -> DataFrame:
    """All phrases of two words or more with at least the least count: path, a, left, grown."""
    sent = src.sparkSession.sparkContext.broadcast(passed)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, near, size = _Tokens(which), [], [], 0

        def out(rest: int) -> tuple[pa.RecordBatch, list, list]:
            """The runs of all but the last ``rest`` words, which wait for what follows them."""
            key, ok = np.concatenate(keys), np.concatenate(near)
            upto = len(key) - rest
            at = np.flatnonzero(ok)
            slot = (pair_hash(key[at], key[np.minimum(at + 1, len(key) - 1)]) >> B.U64(64 - bits)).astype(np.int64)
            good = ok.copy()
            good[at] = sent.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1
            good[-1] = False
            found = list(_ranges(trie(key, good, upto, depth), ranges))
            batch = pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], ["range", "run"])
            return batch, [key[upto:].copy()], [ok[upto:].copy()]

        for batch in batches:
            for _, _, key, ok in tokens.of(batch):
                for a in range(0, len(key), SHARD_WORDS):
                    keys.append(key[a : a + SHARD_WORDS])
                    near.append(ok[a : a + SHARD_WORDS])
                    size += len(keys[-1])
                    if size >= SHARD_WORDS:
                        done, keys, near = out(depth - 1)
                        size = len(keys[0])
                        yield from _by(done, HAND_RUNS)
        if size:
            yield from _by(out(0)[0], HAND_RUNS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tries, pending, done = None, [], 0, 0
        for batch in batches:
            for r, run in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != now and tries:
                    yield from _frequent(merged(tries), least)
                    tries, pending, done = [], 0, 0
                now = r
                tries.append(_read(run.as_py(), depth))
                pending += sum(len(n) for _, _, n in tries[-1])
                if pending > max(PENDING_NODES, done):
                    tries = [merged(tries)]
                    done, pending = sum(len(n) for _, _, n in tries[0]), 0
        if tries:
            yield from _frequent(merged(tries), least)

    runs = src.mapInArrow(grow, "range int, run binary")
    return runs.repartition("range").sortWithinPartitions("range").mapInArrow(merge, "path array<long>, a long, left array<long>, grown boolean")


def _cuts(depth: int) -> Column:
    """The lowest-scoring cut of a candidate, the first of equal ones: score, k, l, r."""
    long = lambda c: c.cast("decimal(19,0)")
    cuts = []
    for k in range(1, depth):
        left = F.col("l1") if k == 1 else F.try_element_at("left", F.lit(k - 1))
        right = F.col(f"r{k}")
        score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (long(F.col("a")) * long(F.col("n"))), long(left) * long(right))
        cuts.append(F.when(F.size("path") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))))
    return F.array_min(F.array_compact(F.array(*cuts)))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, depth: int = DEPTH, top: int = TOP, bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    spark = prepare(docs.sparkSession)
    src = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    for which in (0, 1):
        counts = cut(_counts(src, which, bits), "phrase-counts")
        words = cut(counts.where("NOT pair").repartition("key").groupBy("key", "lang", "word").agg(F.sum("n").alias("n")), "phrase-words")
        if words.groupBy("key").count().where("count > 1").isEmpty():
            break
    else:
        raise ValueError("two words share both hashes")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    size = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.where(F.col("n") >= least)
    nodes = cut(_nodes(src, which, _bitmap(counts, least, bits), bits, -(-size // RANGE_WORDS) or 1, least, depth), "phrase-nodes")

    d = F.size("path")
    ends = F.concat(F.array(F.struct(F.lit(0).alias("k"), F.slice("path", 1, 1).alias("end"))), F.transform(F.sequence(F.lit(1), d - 1), lambda k: F.struct(k.alias("k"), F.slice("path", k + 1, d - k).alias("end"))))
    links = nodes.select("path", "a", F.explode(ends).alias("link")).select("path", "a", "link.k", "link.end")
    counted = nodes.select(F.col("path").alias("end"), F.col("a").alias("f")).unionByName(frequent.select(F.array("key").alias("end"), F.col("n").alias("f")))
    met = cut(links.join(counted, "end"), "phrase-links")
    parts = met.groupBy("path").agg(F.max(F.when(F.col("k") == 0, F.col("f"))).alias("l1"), *(F.max(F.when(F.col("k") == k, F.col("f"))).alias(f"r{k}") for k in range(1, depth)))
    inside = met.where("k = 1 AND a = f AND size(end) > 1").select(F.col("end").alias("path")).distinct()
    kept = nodes.where("NOT grown").join(inside, "path", "left_anti").join(parts, "path")
    kept = kept.join(frequent.select(F.col("key").alias("first"), "lang"), F.col("path")[0] == F.col("first")).join(totals, "lang")
    scored = kept.select("lang", "path", "a", "n", _cuts(depth).alias("cut")).select("lang", "path", "a", "n", "cut.score", "cut.l", "cut.r")

    best = (F.desc("score"), F.desc("a"))
    group = F.pmod(F.xxhash64("path"), F.lit(RANK_GROUPS))
    some = scored.withColumn("at", F.rank().over(Window.partitionBy("lang", group).orderBy(*best))).where(F.col("at") <= top).drop("at")
    spelt = some.select("*", F.posexplode("path").alias("pos", "key")).join(frequent.select("key", "word"), "key")
    spelt = spelt.groupBy("lang", "path", "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("ws"))
    named = spelt.withColumn("phrase", F.array_join(F.transform("ws", lambda x: x["word"]), " "))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, F.asc("phrase"))).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in SQL, with the standard parameters.
SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM runs),
grams AS (SELECT lang, ws[i : i + d - 1] AS path FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS d) WHERE i + d - 1 <= len(ws)),
f AS (SELECT lang, path, len(path) AS d, count(*) AS f FROM grams GROUP BY lang, path HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM runs GROUP BY lang),
inside AS (
    SELECT lang, path[1 : d - 1] AS path, f FROM f WHERE d > 2
    UNION SELECT lang, path[2 : d] AS path, f FROM f WHERE d > 2),
candidates AS (SELECT f.* FROM f ANTI JOIN inside USING (lang, path, f) WHERE d > 1),
cuts AS (SELECT lang, path, f, d, unnest(range(1, d)) AS k FROM candidates),
scores AS (
    SELECT c.lang, c.path, c.f AS a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN totals USING (lang)
    JOIN f x ON x.lang = c.lang AND x.path = c.path[1 : k] JOIN f y ON y.lang = c.lang AND y.path = c.path[k + 1 : c.d]),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, path ORDER BY score, k) = 1),
ranked AS (
    SELECT *, array_to_string(path, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(path, ' ')) AS rank
    FROM lowest)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
