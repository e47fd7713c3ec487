"""Line dedup by a sharded minimal perfect hash.

Distinct line keys that enough documents hold are dealt to shards by hash. A shard is
one minimal perfect hash (levels of bitmaps: a key rests at the first level where no
other key meets it, and its slot is the number of set bits before it) with arrays of
64-bit fingerprints, document counts and the largest doc_id holding the line. Each
text's lines probe the arrays: no join on lines. A fingerprint comes from a second,
independent hash, so another line is taken for a key with probability 2**-64.

Shards of ``group_bytes`` together at most go to all executors, and a text's lines are
probed where it is read. More than that stay where they are, whatever their number:
the lines go to them as rows of fixed width, in one shuffle, and the places of those to
drop come back to their texts. A shard that many lines probe is copied to several tasks.

Counting combines equal lines within each batch and again map-side, so a line that
all documents hold moves a few rows per task only.

Cases: a null or empty text is one empty line; white space and A-Z case at a line's
ends and in it fold as the contract says; rows of one doc_id count as one document, and
of several rows with the largest doc_id none loses the line; a row whose doc_id is null,
or no whole number, counts as a document of its own, holds no line as the largest, and so
loses it; further columns are ignored; an empty table gives an empty result. Very
long texts and lines are read whole, a piece at a time: beside its bytes some 50 bytes
are held for each line that is long enough, so at most about the text's size again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import bytetext as B
from evigraph.llm.shared import cut, map_batches, prepare

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys in a shard, about, and the most bytes of shards that are broadcast.
SHARD_KEYS, GROUP_BYTES = 1 << 18, 64 << 20
#: Lines that probe a copy of a shard in one task, about.
PROBES = 1 << 20
#: Bits of a level's bitmap per key, and levels before the few that are left get a sorted list.
_GAMMA, _LEVELS = 2.0, 24
_NEVER = -(1 << 63)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        left, base = keys, 0
        for level in range(_LEVELS):
            if not len(left):
                break
            size = max(64, int(len(left) * _GAMMA + 63) // 64 * 64)
            at = self._place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            base = self._add(np.packbits(alone, bitorder="little").view(np.uint64), base)
            left = left[~alone[at]]
        self.rest, self.rest_base = np.sort(left), base

    def _add(self, words: np.ndarray, base: int) -> int:
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        self.levels.append((64 * len(words), words, ranks, base))
        return base + int(ranks[-1])

    @classmethod
    def of_bitmaps(cls, bitmaps: list[np.ndarray], rest: np.ndarray) -> PerfectHash:
        out, base = cls(np.empty(0, np.uint64)), 0
        for words in bitmaps:
            base = out._add(words, base)
        out.rest, out.rest_base = rest, base
        return out

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (B.mix(keys + B.U64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % B.U64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of others some slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, words, ranks, base) in enumerate(self.levels):
            if not len(open_):
                return out
            at = self._place(keys[open_], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & B.U64(1) == 1
            below = word[hit] & ((B.U64(1) << bit[hit]) - B.U64(1))
            out[open_[hit]] = base + ranks[at[hit] >> 6] + np.bitwise_count(below)
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.rest_base + at[hit]
        return out


class Shard:
    """Fingerprints, counts and last holders at the slots of a perfect hash."""

    def __init__(self, index: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.index, self.prints, self.counts, self.last = index, prints, counts, last

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> Shard:
        index = PerfectHash(keys)
        order = np.empty(len(keys), np.int64)
        order[index.slots(keys)] = np.arange(len(keys))
        return cls(index, prints[order], counts[order].astype(np.uint32), last[order])

    def to_bytes(self) -> bytes:
        bitmaps = [words for _, words, _, _ in self.index.levels]
        head = np.array([len(self.prints), len(self.index.rest), len(bitmaps), *map(len, bitmaps)], np.int64)
        return b"".join(x.tobytes() for x in (head, *bitmaps, self.index.rest, self.prints, self.last, self.counts))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        n, rest, levels = np.frombuffer(raw, np.int64, 3)
        sizes = np.frombuffer(raw, np.int64, levels, 24)
        at = 24 + 8 * levels
        parts = []
        for kind, size in [*((np.uint64, k) for k in sizes), (np.uint64, rest), (np.uint64, n), (np.int64, n), (np.uint32, n)]:
            parts.append(np.frombuffer(raw, kind, size, at))
            at += size * np.dtype(kind).itemsize
        *bitmaps, left, prints, last, counts = parts
        return cls(PerfectHash.of_bitmaps(bitmaps, left), prints, counts, last)

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys the shard has, and for each its last holder."""
        at = self.index.slots(keys)
        if not len(self.prints):
            return at >= 0, at
        found = (at >= 0) & (self.prints[at] == prints)
        return found, self.last[at]


def _runs(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places of runs of whole lines: of about a piece, or of one longer line."""
    at, n = 0, len(data)
    while at <= n:
        stop = min(at + B.PIECE, n)
        if stop < n:
            breaks = np.flatnonzero(data[at : stop + 1] == 0x0A)
            if len(breaks):
                stop = at + int(breaks[-1])
            while not len(breaks) and stop < n:
                breaks = np.flatnonzero(data[stop : stop + B.PIECE] == 0x0A)
                stop = stop + int(breaks[0]) if len(breaks) else min(stop + B.PIECE, n)
        yield at, stop
        at = stop + 1


def _one_line(data: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """As _many_lines, for one long line."""
    n = s = e = 0
    for at in range(0, len(data), B.PIECE):
        solid = np.flatnonzero(B.SOLID[data[at : at + B.PIECE]])
        if len(solid):
            s, e, n = (s if n else at + int(solid[0])), at + int(solid[-1]) + 1, n + 1
    s, e = np.array([s]), np.array([e])
    enough = B.span_counts(data, s, e, B.LEAD) >= min_chars
    return np.zeros(1, np.int64)[enough], np.array([len(data)])[enough], s[enough], e[enough]


def _many_lines(data: np.ndarray, min_chars: int) -> tuple[int, tuple[np.ndarray, ...]]:
    """(number of lines, begin and end of those long enough, and of what is left of them without white space)."""
    breaks = np.flatnonzero(data == 0x0A)
    begin, end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])
    n = len(begin)
    may = end - begin >= min_chars
    begin, end = begin[may], end[may]
    solid = np.flatnonzero(B.SOLID[data]) if len(begin) else breaks
    if not len(solid):
        return n, (begin[:0],) * 4
    a, b = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    full = b > a
    s = np.where(full, solid[np.minimum(a, len(solid) - 1)], 0)
    e = np.where(full, solid[np.maximum(b - 1, 0)] + 1, 0)
    lead = np.zeros(len(data) + 1, np.int32)
    np.cumsum(B.LEAD[data], out=lead[1:])
    enough = full & (lead[e] - lead[s] >= min_chars)
    return n, (begin[enough], end[enough], s[enough], e[enough])


class Lines:
    """The lines of one text: how many, where those are that are long enough, and their two hashes."""

    def __init__(self, data: np.ndarray, min_chars: int, hashed: bool = True):
        self.n, found, keys, prints = 0, [], [], []
        for at, stop in _runs(data):
            part = data[at:stop]
            n, (begin, end, s, e) = _many_lines(part, min_chars) if len(part) <= 2 * B.PIECE else (1, _one_line(part, min_chars))
            self.n += n
            if len(begin):
                found.append((begin + at, end + at))
                if hashed:
                    keys.append(B.span_hashes(part, s, e, True, 0))
                    prints.append(B.span_hashes(part, s, e, True, 1))
        none, none64 = np.empty(0, np.int64), np.empty(0, np.uint64)
        self.begin, self.end = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)
        self.keys, self.prints = (np.concatenate(x) if x else none64 for x in (keys, prints))


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    raw, at = B.buffers(column)
    for k in range(len(at) - 1):
        yield raw[at[k] : at[k + 1]]


def shared_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(key, print, n_docs, last) of every line key that enough documents hold.

    Where ids repeat, a row for each key and id is counted; else rows are added up at once.
    """
    src = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    unique = src.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, prints, ids = [], [], []
        doc_ids = batch.column(0).fill_null(_NEVER).to_numpy(zero_copy_only=False)
        for doc_id, data in zip(doc_ids, _texts(batch.column(1)), strict=True):
            lines = Lines(data, min_chars)
            _, first = np.unique(lines.keys, return_index=True)
            keys.append(lines.keys[first])
            prints.append(lines.prints[first])
            ids.append(np.full(len(first), doc_id, np.int64))
        key, ids = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, ids))
        fp = np.concatenate(prints) if prints else np.empty(0, np.uint64)
        if len(key):
            order = np.lexsort((ids, fp, key))
            key, fp, ids = key[order], fp[order], ids[order]
            other = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
            last = np.append(other if unique else other | (ids[1:] != ids[:-1]), True)
            at = np.flatnonzero(last)
            n = np.diff(np.concatenate([[-1], at]))
            key, fp, ids = key[at], fp[at], ids[at]
        else:
            n = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(B.signed(key.astype(np.uint64))), pa.array(B.signed(fp)), pa.array(n.astype(np.int64)), pa.array(ids)],
            ["key", "print", "n", "last"],
        )

    part = map_batches(src, run, "key long, print long, n long, last long")
    if not unique:
        held = F.when(F.col("last") == _NEVER, F.sum("n")).otherwise(F.lit(1).cast("long"))
        part = part.groupBy("key", "print", "last").agg(held.alias("n"))
    return part.groupBy("key", "print").agg(F.sum("n").alias("n_docs"), F.max("last").alias("last")).where(F.col("n_docs") >= min_docs)


def build_shards(lines: DataFrame, n_shards: int) -> DataFrame:
    """One row (shard, n_keys, arrays) a shard; each is built by one task from distinct keys."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, prints, counts, last = (table.column(c).to_numpy() for c in ("key", "print", "n_docs", "last"))
        # Two lines of one key and different prints, 2**-64 a pair, would keep the first only.
        keys, first = np.unique(keys.view(np.uint64), return_index=True)
        shard = Shard.build(keys, prints[first].view(np.uint64), counts[first], last[first])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "arrays": pa.array([shard.to_bytes()], pa.binary())})

    shard = F.pmod(F.shiftrightunsigned("key", 40), F.lit(n_shards)).cast("int").alias("shard")
    return lines.select(shard, "*").groupBy("shard").applyInArrow(run, "shard int, arrays binary")


_loaded: dict[str, dict[int, Shard]] = {}


def _load(name: str, arrays: dict[int, bytes]) -> dict[int, Shard]:
    """The shards of a broadcast, unpacked once in a worker."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = {s: Shard.from_bytes(a) for s, a in arrays.items()}
    return _loaded[name]


def _home(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each key, as build_shards deals them."""
    return ((keys >> B.U64(40)) % B.U64(n_shards)).astype(np.int32)


def _dropped(lines: Lines, doc_id: int | None, shards: dict[int, Shard], n_shards: int) -> np.ndarray:
    """Which of a text's long lines the shards drop."""
    drop = np.zeros(len(lines.keys), bool)
    home = _home(lines.keys, n_shards)
    for s in np.unique(home):
        if s in shards:
            here = home == s
            found, last = shards[s].probe(lines.keys[here], lines.prints[here])
            drop[here] = found & (last != doc_id)
    return np.flatnonzero(drop)


def _stay(data: np.ndarray, lines: Lines, drop: np.ndarray) -> Iterator[np.ndarray]:
    """The runs of lines between the dropped ones; line breaks belong between them."""
    at = 0
    for begin, end in zip(lines.begin[drop].tolist(), lines.end[drop].tolist(), strict=True):
        if begin - 1 >= at:
            yield data[at : begin - 1]
        at = end + 1
    if at <= len(data):
        yield data[at:]


def _result(ids: pa.Array, drops: Iterator[tuple[np.ndarray, Lines, np.ndarray]], with_text: bool) -> pa.RecordBatch:
    n, gone, sha, text = [], [], [], []
    for data, lines, drop in drops:
        digest, body = hashlib.sha256(), []
        for k, run in enumerate(_stay(data, lines, drop)):
            if k:
                digest.update(b"\n")
            digest.update(np.ascontiguousarray(run))
            if with_text:
                body.append(run.tobytes())
        n.append(lines.n)
        gone.append(len(drop))
        sha.append(digest.hexdigest())
        text.append(b"\n".join(body).decode() if with_text else None)
    cols = [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    return pa.RecordBatch.from_arrays(cols + [pa.array(text, pa.string())] * with_text, names + ["kept_text"] * with_text)


def _found_in_shards(src: DataFrame, shards: DataFrame, n_shards: int, min_chars: int, per_task: int) -> DataFrame:
    """(holder, text_key, drop): the places among its long lines of what a text loses, from the tasks that hold the shards."""
    names = ["holder", "text_key", "nth", "shard", "key", "print"]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [Lines(d, min_chars) for d in _texts(batch.column(2))]
        n = [len(x.keys) for x in parts]
        of = pa.array(np.repeat(np.arange(len(parts)), n))
        keys, prints = (np.concatenate([getattr(x, c) for x in parts] or [np.empty(0, np.uint64)]) for c in ("keys", "prints"))
        nth = np.concatenate([np.arange(k, dtype=np.int32) for k in n] or [np.empty(0, np.int32)])
        cols = [batch.column(0).take(of), batch.column(1).take(of), pa.array(nth), pa.array(_home(keys, n_shards)), pa.array(B.signed(keys)), pa.array(B.signed(prints))]
        return pa.RecordBatch.from_arrays(cols, names)

    probes = cut(map_batches(src.select("holder", "text_key", "text"), rows, "holder long, text_key binary, nth int, shard int, key long, print long"), "probes")
    copies = probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_task)).cast("int").alias("copies"))
    dealt = probes.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("text_key", "nth"), F.col("copies")).cast("int")).drop("copies")
    arrays = shards.join(copies, "shard").select("shard", "arrays", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(names[:3]).slice(0, 0)
        shard = Shard.from_bytes(right.column("arrays")[0].as_buffer())
        keys, prints = (left.column(c).to_numpy().view(np.uint64) for c in ("key", "print"))
        found, last = shard.probe(keys, prints)
        held = left.column("holder").fill_null(_NEVER).to_numpy()
        return left.select(names[:3]).filter(pa.array(found & ((last != held) | (held == _NEVER))))

    hits = dealt.groupBy("shard", "copy").cogroup(arrays.groupBy("shard", "copy")).applyInArrow(probe, "holder long, text_key binary, nth int")
    return hits.groupBy("holder", "text_key").agg(F.array_sort(F.collect_set("nth")).alias("drop"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, group_bytes: int = GROUP_BYTES, probes: int = PROBES, with_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row; kept_text too if asked for."""
    spark = prepare(docs.sparkSession)
    lines = cut(shared_lines(docs, id_col, text_col, min_chars, min_docs), "lines")
    n_shards = max(1, -(-lines.count() // SHARD_KEYS))
    shards = cut(build_shards(lines, n_shards), "shards")
    size = shards.agg(F.coalesce(F.sum(F.length("arrays").cast("long")), F.lit(0)).alias("n")).first()["n"]

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).try_cast("long").alias("holder"), F.col(text_col).alias("text"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text

    if size <= group_bytes:
        name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast({r["shard"]: bytes(r["arrays"]) for r in shards.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _load(name, sent.value)
            for batch in batches:
                each = ((d, i, Lines(d, min_chars)) for i, d in zip(batch.column(1).to_pylist(), _texts(batch.column(2)), strict=True))
                yield _result(batch.column(0), ((d, x, _dropped(x, i, own, n_shards)) for d, i, x in each), with_text)

        return src.mapInArrow(run, schema)

    # A row is named by its id and text: rows that are alike in both lose the same lines.
    src = src.withColumn("text_key", F.unhex(F.md5("text")))
    notes = _found_in_shards(src, shards, n_shards, min_chars, probes)
    notes = notes.select(F.col("holder").alias("by"), F.col("text_key").alias("of"), "drop")
    both = src.join(notes, F.col("holder").eqNullSafe(F.col("by")) & F.col("text_key").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "drop")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        drops = batch.column(2).to_pylist()
        each = ((d, Lines(d, min_chars, False), np.array(x or [], np.int64)) for d, x in zip(_texts(batch.column(1)), drops, strict=True))
        return _result(batch.column(0), each, with_text)

    return map_batches(both, finish, schema)


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
h AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.line, k.pos, h.key IS NOT NULL AND k.doc_id <> h.last AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
