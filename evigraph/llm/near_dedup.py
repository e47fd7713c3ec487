"""MinHash near-duplicate groups, with odd sketches to check banded candidates.

1. Each text becomes its set of word shingles (64-bit hashes), a 128-bit key of the
   set, MinHash bands, and an odd sketch: every MinHash sample flips one bit of a
   parity bitmap, so the bits in which two bitmaps differ estimate how many samples
   differ, most precisely where similarity is high. A sample is the smallest hash in
   one of SAMPLES equal parts of the hash range, or, where a set has none there, the
   smallest value of a hash function of that part's own: either way two sets agree
   with probability equal to their similarity.
2. Equal sets collapse to one representative by a map-side combined aggregation.
3. In the band buckets a member is paired with the bucket's smallest member only, and of
   these pairs a node keeps the few that meet in most bands. Sketches rule pairs out,
   full sets confirm the others. Connected components follow by contracting random stars.
4. Buckets that still hold several components get the exact way for the rest. A bucket of
   up to CELL members is one cell, a larger one is dealt to several. In a cell, what one
   task compares at a time, members of other components than the cell's largest meet all
   its members, by sizes and by odd sketches of the full sets. Only those that come near
   another bring their full sets to a second pass over the cells, which confirms links and
   gives a spanning forest of the cell's components: fewer links than the cell has
   components, however many pairs are similar.
5. In buckets of several cells that hold several components even so, members outside the
   main component are dealt to rows and all members to columns of a grid, whose cells are
   compared in the same way. No pair of a bucket is left open, and none is a row.

Labels of components are looked up by join; those of more than a 65,536th of all rows go
to all tasks instead (65,536 at most), so no task gathers a large component.

A true pair of similarity 0.8 shares no band with probability (1 - 0.8**8)**64 = 8e-6.

Cases: a null or empty text, or one without words, has an empty set and is linked
with nothing; fewer words than a shingle make one shingle of them all; texts of equal
sets have similarity 1; each distinct set is one vertex, whatever doc_ids hold it, so
rows that repeat a doc_id with other texts are linked, kept and dropped by their own
texts; each gives a result row, with the smallest doc_id of its vertex's component.
Of the rows that a component marks as kept, keep() takes one: that of the smallest set
key and text hash; so of rows that repeat a doc_id without words. Of rows that are alike in
id and text it takes that whose other columns are smallest, null first, so a rerun keeps
the same. A row whose doc_id is null is linked with nothing, its component is null and it
is kept, as has an id that is no whole number; groups() ignores further columns; an
empty table gives an empty result. Of a very long text some 30 bytes are held a word, and
its full set, 8 bytes a shingle, moves as one value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from evigraph.llm import bytetext as B
from evigraph.llm.shared import cut, forget, map_batches, prepare

ROWS, BANDS = 8, 64
SAMPLES = ROWS * BANDS
#: Bits of the sketch of the samples, and of that of a full set.
SKETCH_BITS, SET_BITS = 1024, 2048
#: How far a sketch's estimate of similarity may lie below the threshold, more than five
#: standard deviations of the samples; and the deviations allowed to that of a full set.
SLACK, DEVIATIONS = 0.10, 6.0
#: Smallest bucket members that a node is checked against first.
FIRST_HEADS = 2
#: Pairs with their full sets in a task and file, about.
PAIRS_PER_FILE = 20_000
#: Rows with sketches in a file, about.
WIDE_ROWS = 50_000
#: Members of a bucket on each side of a cell, and shingles in their sets, about.
CELL, CELL_SHINGLES = 1024, 4_000_000
#: Fewest rows with which a label counts as that of a large component.
LARGE = 1024

_PART = B.U64(64 - (SAMPLES - 1).bit_length())
_PARTS = np.arange(SAMPLES, dtype=np.uint64) << _PART
_draw = np.random.Generator(np.random.PCG64(77))
_MUL = (_draw.integers(0, 1 << 31, SAMPLES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _draw.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_ORDER = np.arange(1, SAMPLES + 1, dtype=np.uint64) * B.U64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted set of k-word shingles; fewer words make one shingle."""
    out = B.grams(hashes, min(len(hashes), k)) if len(hashes) else hashes
    out.sort()
    again = out[1:] == out[:-1]
    return out[np.concatenate([[True], ~again])] if again.any() else out


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set of 64-bit values from others."""
    a = b = B.U64(0)
    with np.errstate(over="ignore"):
        for at in range(0, len(values), B.PIECE):
            some = values[at : at + B.PIECE]
            a += B.mix(some ^ B.U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
            b += B.mix(some + B.U64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return a, b


def samples(values: np.ndarray) -> np.ndarray:
    """MinHash samples of a sorted set that isn't empty."""
    out = np.zeros(SAMPLES, np.uint64)
    first = np.searchsorted(values, _PARTS)
    least = values[np.minimum(first, len(values) - 1)]
    filled = (first < len(values)) & (least >> _PART == _PARTS >> _PART)
    out[filled] = least[filled]
    rest = np.flatnonzero(~filled)
    if len(rest):
        low = (values >> B.U64(16)).astype(np.uint32)
        mul, add = _MUL[rest][:, None], _ADD[rest][:, None]
        least = np.full(len(rest), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 512):
            np.minimum(least, (low[None, at : at + 512] * mul + add).min(axis=1), out=least)
        out[rest] = least
    return out


def parity(places: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of which bits were flipped an odd number of times, as 64-bit words."""
    odd = (np.bincount((places & B.U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def bands_and_sketch(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and the odd sketch of the samples."""
    wide = B.mix(sample + _ORDER)
    # The samples of a band are spread over the hash range.
    key = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        key = B.mix(key * B.U64(0xD6E8FEB86659FD93) + wide[r * BANDS : (r + 1) * BANDS])
    return key, parity(wide, SKETCH_BITS)


def most_flips(threshold: float) -> int:
    """The most differing sketch bits that leave the threshold possible, slack included."""
    differ = 2 * SAMPLES * (1 - (threshold - SLACK))
    return int(np.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differ)))


def _flips(a: str, b: str, bits: int) -> Column:
    parts = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(bits // 64)]
    return sum(parts[1:], parts[0])


def _most_odd(added: np.ndarray, percent: int) -> np.ndarray:
    """The most differing bits of full-set sketches that leave the threshold possible, by the added sizes of two sets.

    Similar sets differ in at most d = (100 - percent) / (100 + percent) of their added
    sizes; d flips of n bits leave n/2 (1 - (1 - 2/n)**d) odd ones on average.
    """
    n, d = float(SET_BITS), added * ((100 - percent) / (100 + percent))
    one, two = (1 - 2 / n) ** d, (1 - 4 / n) ** d
    spread = np.sqrt(np.maximum(0.0, n / 4 * (1 - two) + n * n / 4 * (two - one * one)))
    return n / 2 * (1 - one) + DEVIATIONS * spread + 1


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str, key_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, the set's key, band keys and sketch of every row, and its binary key_col if given."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, a, b, bands, sketch = [], [], [], [], []
        for w in B.words(batch.column(1), fold=True):
            s = shingles(w.hashes, k)
            n.append(len(s))
            x, y = set_key(s)
            a.append(x)
            b.append(y)
            if len(s):
                key, odd = bands_and_sketch(samples(s))
                bands.append(B.signed(key))
                sketch.append(B.signed(odd))
            else:
                bands.append(None)
                sketch.append(None)
        longs = pa.list_(pa.int64())
        named = [batch.column(k) for k in range(2, batch.num_columns)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *named, pa.array(n, pa.int64()), pa.array(B.signed(np.array(a, np.uint64))), pa.array(B.signed(np.array(b, np.uint64))), pa.array(bands, longs), pa.array(sketch, longs)],
            ["doc_id", *["text_key"] * len(named), "n_shingles", "key_a", "key_b", "bands", "sketch"],
        )

    src = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(key_col).alias("text_key")] if key_col else []))
    return map_batches(src, run, f"doc_id long, {'text_key binary, ' if key_col else ''}n_shingles long, key_a long, key_b long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(node, size, parity, shingles) of the wanted (node, doc_id, key_a, key_b): the set as its sorted 64-bit values."""
    src = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    src = src.join(wanted.select("doc_id"), "doc_id", "left_semi")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(w.hashes, k) for w in B.words(batch.column(1), fold=True)]
        keys = [set_key(s) for s in sets]
        odd = [B.signed(parity(B.mix(s ^ B.U64(0x6A09E667F3BCC909)), SET_BITS)) for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(B.signed(np.array([a for a, _ in keys], np.uint64))), pa.array(B.signed(np.array([b for _, b in keys], np.uint64))),
             pa.array([len(s) for s in sets], pa.int64()), pa.array(odd, pa.list_(pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary())],
            ["doc_id", "key_a", "key_b", "size", "parity", "shingles"],
        )

    sets = map_batches(src, run, "doc_id long, key_a long, key_b long, size long, parity array<long>, shingles binary")
    return sets.join(wanted, ["doc_id", "key_a", "key_b"]).select("node", "size", "parity", "shingles").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            good.append(100 * common >= percent * (len(x) + len(y) - common))
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return map_batches(pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b"), run, "a long, b long")


def looked_up(rows: DataFrame, key: str, table: DataFrame, own: str, n_rows: int) -> DataFrame:
    """``rows`` with ``value`` of ``table`` (key, value), null where it has none; own tells rows apart.

    Keys of many rows are at most 65,536, whose values all tasks get; their rows are then
    dealt by hash and not by key.
    """
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(LARGE, n_rows >> 16)).select(key)
    sent = many.join(table, key, "left").select(key, F.col("value").alias("_sent"), F.lit(True).alias("_many"))
    out = rows.join(F.broadcast(sent), key, "left")
    by = F.when(F.col("_many").isNull(), F.col(key)).otherwise(F.xxhash64(F.lit("many"), own)).alias("_by")
    out = out.select("*", by).join(table.select(F.col(key).alias("_by"), F.col("value").alias("_found")), "_by", "left")
    # A hash may happen to be another's key.
    return out.withColumn("value", F.when(F.col("_many"), F.col("_sent")).otherwise(F.col("_found"))).drop("_by", "_many", "_sent", "_found")


def relabelled(label: DataFrame, to: DataFrame, n_rows: int) -> DataFrame:
    """(node, label) with labels replaced by those that ``to`` (node, label) gives them."""
    up = to.select(F.col("node").alias("label"), F.col("label").alias("value"))
    return looked_up(label, "label", up, "node", n_rows).select("node", F.coalesce("value", "label").alias("label"))


def placed(held: DataFrame, label: DataFrame, *more: str) -> DataFrame:
    """(node, label, bucket) of ``held`` (node, places) and its further columns; the label joins a node's row, not each of its places."""
    rows = held.join(label, "node").select("node", "label", *more, F.explode("places").alias("p"))
    return rows.select("node", "label", *more, "p.bucket")


def still_open(held: DataFrame, label: DataFrame, n: int) -> DataFrame:
    """``held`` (node, places) with the places in buckets of several components; as components only grow, other buckets stay closed."""
    rows = placed(held, label)
    several = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    left = rows.join(cut(several, "several", BANDS * n), "bucket", "left_semi")
    return cut(left.groupBy("node").agg(F.collect_list(F.struct("bucket")).alias("places")), "held", n, WIDE_ROWS)


class Cell:
    """The members of a cell, as arrays.

    side: 0 stands in a row of a grid, 1 in a column, -1 in both; main: the label whose
    members aren't compared with each other's rows, that of most members if side is -1.
    """

    def __init__(self, cell: pa.RecordBatch, percent: int) -> None:
        side, main, self.node, self.label, self.size = (cell.column(c).to_numpy(zero_copy_only=False) for c in ("side", "main", "node", "label", "size"))
        self.percent = percent
        # Bits of signed numbers would be counted in their absolute values.
        self.odd = cell.column("parity").flatten().to_numpy().view(np.uint64).reshape(len(side), -1)
        names, counts = np.unique(self.label, return_counts=True)
        main = names[counts.argmax()] if side[0] < 0 else main[0]
        self.inner = self.label == main
        self.rows, self.cols = np.flatnonzero((side != 1) & ~self.inner), np.flatnonzero(side != 0)

    def near(self, r: int) -> np.ndarray:
        """The members that row r has to meet and whose full sets may be similar enough; of two rows the smaller node meets the other."""
        c = self.cols[(self.label[self.cols] != self.label[r]) & (self.inner[self.cols] | (self.node[self.cols] > self.node[r]))]
        a, b = self.size[r], self.size[c]
        c = c[100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)]
        flips = np.bitwise_count(self.odd[c] ^ self.odd[r]).sum(axis=1, dtype=np.int64)
        return c[flips <= _most_odd((self.size[c] + a).astype(np.float64), self.percent)]


def met_members(cell: pa.RecordBatch, percent: int) -> pa.RecordBatch | None:
    """The places of a cell's members that come near one of another component."""
    c = Cell(cell, percent)
    met = np.zeros(cell.num_rows, bool)
    for r in c.rows:
        near = c.near(r)
        met[near] = True
        met[r] |= len(near) > 0
    return cell.select(PLACE).filter(pa.array(met)) if met.any() else None


def forest(cell: pa.RecordBatch, percent: int) -> pa.RecordBatch | None:
    """Links (a, b), confirmed on full sets, that join all components of a cell that are linked: one less than it joins."""
    c = Cell(cell, percent)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in cell.column("shingles")]
    ends = np.cumsum([len(x) for x in sets])
    known, at = np.unique(np.concatenate(sets), return_inverse=True)
    sets = np.split(at, ends[:-1])
    marks = np.zeros(len(known), np.int32)
    root = c.label.copy()
    a, b = [], []
    for r in c.rows:
        near = c.near(r)
        near = near[root[near] != root[r]]
        if not len(near):
            continue
        marks[sets[r]] = 1
        starts = np.cumsum([0, *c.size[near][:-1]])
        common = np.add.reduceat(marks[np.concatenate([sets[x] for x in near])], starts)
        marks[sets[r]] = 0
        for x in near[100 * common >= percent * (c.size[near] + c.size[r] - common)]:
            if root[x] != root[r]:
                root[root == root[x]] = root[r]
                a.append(c.node[r])
                b.append(c.node[x])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None


#: What tells a cell, and a member's place in it.
CELL_KEY = ["bucket", "row", "col"]
PLACE = [*CELL_KEY, "side", "main", "node", "label"]


def by_cell(rows: DataFrame, fn: Callable[[pa.RecordBatch, int], pa.RecordBatch | None], percent: int, schema: str) -> DataFrame:
    """``fn`` over the rows of each cell, which lie together and may reach over batches."""

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in CELL_KEY], axis=1)
            new = np.concatenate([[last is not None and (key[0] != last).any()], (key[1:] != key[:-1]).any(axis=1)])
            out, at = [], 0
            for end in np.flatnonzero(new):
                if end > at:
                    held.append(batch.slice(at, end - at))
                out.append(fn(joined(held), percent))
                held, at = [], end
            held.append(batch.slice(at))
            last = key[-1]
            out = [x for x in out if x is not None]
            if out:
                yield joined(out)
        if held and (x := fn(joined(held), percent)) is not None:
            yield x

    return rows.repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY, "node").mapInArrow(run, schema)


def links_in_cells(cells: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """Links (a, b) that join what is linked in each of the ``cells`` (PLACE, size, parity): a forest of each cell's components."""
    schema = "bucket long, row int, col int, side int, main long, node long, label long"
    met = cut(by_cell(cells, met_members, percent, schema), "met", BANDS * n, WIDE_ROWS)
    # Full sets join a node's row, not each of its places.
    at = met.groupBy("node").agg(F.collect_list(F.struct(*(c for c in PLACE if c != "node"))).alias("at"))
    whole = at.join(sets, "node").select("node", "size", "parity", "shingles", F.explode("at").alias("p"))
    return by_cell(whole.select("p.*", "node", "size", "parity", "shingles"), forest, percent, "a long, b long").distinct()


def crowded(rows: DataFrame, most_rows: int) -> DataFrame:
    """(bucket, cells) of the buckets of ``rows`` that take several cells; some 65,536 at most, by wider cells beyond."""
    wider = max(1, -(-(most_rows >> 16) // CELL))
    n, size = F.count(F.lit(1)) / F.lit(CELL * wider), F.sum("size") / F.lit(CELL_SHINGLES * wider)
    return rows.groupBy("bucket").agg(F.ceil(F.greatest(n, size)).cast("int").alias("cells")).where("cells > 1")


def _dealt(n: str | Column, turn: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(turn)), n).cast("int")


def own_cells(rows: DataFrame, crowd: DataFrame) -> DataFrame:
    """``rows`` in cells: that of their bucket, or one of those to which a crowded bucket is dealt."""
    cells = rows.join(F.broadcast(crowd), "bucket", "left")
    col = F.coalesce(_dealt(F.col("cells"), 0), F.lit(0)).alias("col")
    return cells.select("bucket", F.lit(0).alias("row"), col, F.lit(-1).alias("side"), F.lit(0).cast("long").alias("main"), "node", "label", "size", "parity")


def grid_cells(rows: DataFrame, crowd: DataFrame) -> DataFrame:
    """The crowded buckets' ``rows`` as grids: members outside the main component in rows, all members in columns."""
    rows = rows.join(F.broadcast(crowd), "bucket")
    part = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    main = part.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    main = main.select("bucket", F.col("top.label").alias("main"), ((F.col("all") - F.col("top.n")) / F.col("all")).alias("share"))
    rows = rows.join(F.broadcast(main), "bucket").withColumn("rows", F.ceil(F.col("cells") * F.col("share")).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = rows.where("label <> main").select("bucket", _dealt(F.col("rows"), 1).alias("row"), every("cells").alias("col"), F.lit(0).alias("side"), "main", "node", "label", "size", "parity")
    whole = rows.select("bucket", every("rows").alias("row"), _dealt(F.col("cells"), 2).alias("col"), F.lit(1).alias("side"), "main", "node", "label", "size", "parity")
    return rest.unionByName(whole)


def components(edges: DataFrame, most_rows: int) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b); equal labels mean one component.

    most_rows: a bound of their number, by which files are laid out.

    Each round, every node points to the neighbour or itself that comes first in a
    random order of that round, edges are contracted along the pointers, and the
    pointers are kept; the number of nodes shrinks by a constant factor a round. Hubs
    are aggregated map-side, never gathered.
    """
    pointers: list[DataFrame] = []
    edges = cut(edges.where("a <> b").distinct(), "edges", most_rows)
    while not edges.isEmpty():
        turn = len(pointers)
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        first = F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("o"), F.col("b").alias("v"))).alias("first")
        best = both.groupBy("a").agg(first)
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("o"), F.col("a").alias("v"))
        to = cut(best.select(F.col("a").alias("node"), F.least(own, F.col("first"))["v"].alias("label")), "pointers", 2 * most_rows)
        pointers.append(to)
        ends = edges.join(to.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(
            to.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b"
        )
        edges = cut(ends.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges", most_rows)
    if not pointers:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # The last round's labels are roots; a label that is not a node of the next round is one already.
    out = pointers[-1]
    for to in reversed(pointers[:-1]):
        up = out.select(F.col("node").alias("label"), F.col("label").alias("root"))
        out = to.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return out


def _marked(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, key_col: str | None = None) -> DataFrame:
    """The columns of groups(), key_a, key_b, the label of the row's component (null without one) and text_key if key_col is given."""
    prepare(docs.sparkSession)
    sig = cut(signatures(docs, k, id_col, text_col, key_col), "signatures")
    filled = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("doc_id"))
    n = sig.count()
    # A number for each set: a doc_id may have several.
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes", n)
    n_sets = n
    nodes = filled.select("doc_id", "key_a", "key_b", "bands", "sketch").join(classes, ["doc_id", "key_a", "key_b"])

    rows = nodes.select("node", F.posexplode("bands").alias("band", "band_key")).select("node", F.xxhash64("band", "band_key").alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("bucket", "head")
    # A row for each node, with its buckets: what later joins and writes is nodes, not 64 places of each.
    places = F.collect_list(F.struct("bucket", "head")).alias("places")
    held = cut(rows.join(heads, "bucket").groupBy("node").agg(places), "held", n, WIDE_ROWS)
    wanted = nodes.join(held.select("node"), "node", "left_semi").select("node", "doc_id", "key_a", "key_b", "sketch").dropDuplicates(["node"])
    wanted = cut(wanted, "sketches", n, WIDE_ROWS)
    sets = cut(full_sets(docs, wanted.select("node", "doc_id", "key_a", "key_b"), k, id_col, text_col), "sets")
    n = sets.count()

    # A node has at most a pair for each band: the heads met in most bands, and the least of all.
    met = held.select("node", F.explode("places.head").alias("head")).where("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("n").desc(), "head"))
    least = F.min("head").over(Window.partitionBy("node"))
    met = met.select("node", "head", rank.alias("rank"), least.alias("least")).where((F.col("rank") <= FIRST_HEADS) | (F.col("head") == F.col("least")))
    sk = wanted.select("node", "sketch")
    pairs = met.select(F.col("head").alias("a"), F.col("node").alias("b"))
    pairs = pairs.join(sk.toDF("b", "sb"), "b").join(sk.toDF("a", "sa"), "a").where(_flips("sa", "sb", SKETCH_BITS) <= most_flips(percent / 100)).select("a", "b")
    links = cut(confirmed(pairs, sets, percent), "links", (FIRST_HEADS + 1) * n, PAIRS_PER_FILE)
    roots = components(links, links.count()).withColumnRenamed("label", "root")
    label = cut(sets.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label")), "labels", n)

    def merged(links: DataFrame) -> DataFrame:
        ends = links.join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        return cut(relabelled(label, components(ends, links.count()), n), "labels", n)

    # The exact way for the rest: buckets of several components.
    rest = still_open(held, label, n)
    forget(held)
    odd = rest.join(sets.select("node", "size", "parity"), "node")
    rows = placed(odd, label, "size", "parity")
    crowd = cut(crowded(rows, BANDS * n), "crowded", n)
    more = cut(links_in_cells(own_cells(rows, crowd), sets, percent, n), "links", BANDS * n)
    if not more.isEmpty():
        label = merged(more)
    if not crowd.isEmpty():
        rows = placed(odd, label, "size", "parity")
        more = cut(links_in_cells(grid_cells(rows, crowd), sets, percent, n), "links", BANDS * n)
        if not more.isEmpty():
            label = merged(more)

    for used in (rest, wanted, sets):
        forget(used)
    # Sets that met no other are components of their own.
    named = cut(classes.join(label, "node", "left").select("node", "key_a", "key_b", "doc_id", F.coalesce("label", "node").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("doc_id").alias("value"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    named = looked_up(named, "label", least, "node", n_sets).select("key_a", "key_b", "label", F.coalesce("value", "doc_id").alias("component"))
    out = sig.drop("bands", "sketch").join(named, ["key_a", "key_b"], "left")
    own = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(own, F.col("doc_id")).otherwise(F.col("component"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept, "key_a", "key_b", F.when(~own, F.col("label")).alias("label"), *(["text_key"] if key_col else []))


def groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; see the module's text."""
    return _marked(docs, k, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def keep(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that their groups keep, one for each component, with all columns."""
    key, own = "_text_key", "_own_id"
    while key in docs.columns or own in docs.columns:
        key, own = key + "_", own + "_"
    named = docs.withColumns({key: F.unhex(F.md5(F.coalesce("text", F.lit("")))), own: F.col("doc_id").try_cast("long")})
    marked = _marked(named, k, percent, own, "text", key).where("kept AND doc_id IS NOT NULL")
    # Rows without words are named by their doc_id, the others by their component.
    alone = F.when(F.col("label").isNull(), F.col("doc_id")).alias("alone")
    one = marked.groupBy("label", alone).agg(F.min(F.struct("doc_id", "key_a", "key_b", "text_key")).alias("first"))
    rows = one.select(F.col("first.doc_id").alias(own), F.col("first.text_key").alias(key))
    held = named.where(F.col(own).isNotNull()).join(rows, [own, key], "left_semi")
    # Rows of one id and text: that whose other columns are smallest, null first.
    order = [F.col("text").isNotNull(), *(F.struct(f"`{c}`") if _ordered(docs.schema[c].dataType) else F.struct(F.col(f"`{c}`").isNotNull(), F.to_json(F.struct(f"`{c}`"))) for c in docs.columns if c != "text")]
    held = held.groupBy(own, key).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(*order)).alias("row")).select("row.*")
    return held.unionByName(named.where(F.col(own).isNull()).select(docs.columns))


def _ordered(kind: DataType) -> bool:
    """Whether values of a type have an order in Spark; maps have none."""
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM t),
n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles, md5(array_to_string(list_sort(g), chr(10))) AS set_key, g FROM s),
reps AS (SELECT set_key, min(doc_id) AS node, any_value(n_shingles) AS size, any_value(g) AS g FROM n WHERE n_shingles > 0 GROUP BY set_key),
x AS (SELECT node, size, unnest(g) AS sh FROM reps),
f AS (SELECT sh, count(*) AS df FROM x GROUP BY sh),
o AS (SELECT node, size, sh, row_number() OVER (PARTITION BY node ORDER BY df, sh) AS pos FROM x JOIN f USING (sh)),
p AS (SELECT node, size, sh FROM o WHERE pos <= size - ceil(0.8 * size) + 1),
c AS (SELECT DISTINCT a.node AS a, b.node AS b FROM p a JOIN p b ON a.sh = b.sh AND a.node < b.node AND 100 * a.size >= 80 * b.size AND 100 * b.size >= 80 * a.size),
i AS (SELECT c.a, c.b, ra.size AS na, rb.size AS nb, len(list_intersect(ra.g, rb.g)) AS common FROM c JOIN reps ra ON ra.node = c.a JOIN reps rb ON rb.node = c.b),
e AS (SELECT a, b FROM i WHERE 100 * common >= 80 * (na + nb - common)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS node, a AS seen FROM e2 UNION SELECT r.node, e2.b FROM r JOIN e2 ON e2.a = r.seen),
m AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT n.doc_id, n.n_shingles, CASE WHEN n_shingles = 0 THEN n.doc_id ELSE coalesce(m.component, reps.node) END AS component_id,
       n_shingles = 0 OR n.doc_id = coalesce(m.component, reps.node) AS kept
FROM n LEFT JOIN reps ON n.set_key = reps.set_key AND n.n_shingles > 0 LEFT JOIN m ON m.node = reps.node
"""
