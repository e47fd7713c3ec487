"""Mixing sources to target weights by weighted fair queueing.

Each source shuffles its documents by a hash of their ids and repeats that order up to
``max_repeats`` times. A copy's virtual finish time is the number of its source's
tokens up to and including it, divided by the source's weight; copies are taken in
the order of finish times until the budget is spent. Sources that run out leave their
share to the others, so what is taken follows the targets, which are the same shares
worked out from the sources' sizes.

Running sums have three levels: within bins of a source's hash order, over the bins of
a group, and over the groups; likewise over slots of finish time. No task holds a source
or the whole order: a bin has ``BIN_ROWS`` rows on average at any number of rows, a group
``GROUP`` bins, and what is left for one task is a row for each eight million documents.
Sources themselves are put in order by ranges and numbered in the same way, so there may
be as many of them as there are hosts.

Cases: a null text has size 0; a null source is a source of its own, the last; a
table without words, or an empty one, takes nothing; ties in finish time go by source
order, then hash, then doc_id; repeated rows are taken as documents of their own;
further columns are ignored; rows without doc_id, and rows of one doc_id, are shuffled by
their number too, so that however many there are they spread over all bins; a very long
text is counted as it stands, and only its number of words moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.shared import cut

MAX_REPEATS = 3
#: Rows in a bin, on average.
BIN_ROWS = 2_048
#: Bins in a group.
GROUP = 4_096
_HASH_RANGE = float(1 << 32)


def n_words(text: Column | str) -> Column:
    """Number of words, runs without white space 0x20 and 0x09 to 0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sums_before(rows: DataFrame, place: str, values: Sequence[str], by: Sequence[str] = (), group: int = GROUP) -> DataFrame:
    """``rows`` with ``{value}_before``: the sum of each value over all smaller places (whole numbers, one row each)."""
    rows = rows.withColumn("_group", F.floor(F.col(place) / F.lit(group)))
    totals = rows.groupBy(*by, "_group").agg(*[F.sum(v).alias(v) for v in values])
    upto = Window.partitionBy(*by).orderBy("_group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.select(*by, "_group", *[(F.sum(v).over(upto) - F.col(v)).alias(f"_{v}") for v in values])
    within = Window.partitionBy(*by, "_group").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", *[(F.sum(v).over(within) - F.col(v)).alias(f"{v}_before") for v in values])
    rows = rows.join(totals, [*by, "_group"])
    return rows.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"_{v}") for v in values}).drop("_group", *[f"_{v}" for v in values])


def numbered(rows: DataFrame, order: Sequence[Column], name: str, n_rows: int) -> DataFrame:
    """``rows`` with their places, from 1, in a total order, written to the shared folder."""
    ranges = max(1, -(-n_rows // (GROUP * 16)))
    # The order's column is dealt by range, each range is numbered by itself.
    dealt = rows.repartitionByRange(ranges, *order) if ranges > 1 else rows.coalesce(1)
    dealt = cut(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = dealt.withColumn("_own", own).join(sums_before(sizes, "_range", ["n"]).select("_range", "n_before"), "_range")
    return cut(out.withColumn(name, F.col("_own") + F.col("n_before")).drop("_range", "_own", "n_before"), "numbered", n_rows)


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """source, source_size, n_docs, rank, weight, target and share of the budget by source.

    ``sizes`` has a row for each source. Sources are filled in the order of
    max_repeats * size / weight: those below the common level stop at their cap, and
    the level of the others is the rest of the budget over the rest of the weights.
    """
    sizes = cut(sizes, "sources")
    whole = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget")).first()
    s = numbered(sizes, [F.col("source").asc_nulls_last()], "rank", whole["n"])
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("weight", F.element_at(pattern, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", (F.lit(max_repeats) * F.col("source_size")).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    s = numbered(s, [F.col("full_at"), F.col("rank")], "filled", whole["n"])
    weighed = s.agg(F.sum("weight")).first()[0]
    s = sums_before(s, "filled", ["cap", "weight"])
    # The level if all sources before this one are full and no other is.
    s = s.withColumn("level_here", (F.lit(whole["budget"]) - F.col("cap_before")) / (F.lit(weighed) - F.col("weight_before")))
    # The first source that doesn't get full at it sets the level.
    first = s.where("level_here <= full_at").agg(F.min_by("level_here", "filled")).first()[0]
    target = F.least(F.col("cap"), F.col("weight") * F.lit(first).cast("double")) if first is not None else F.lit(0.0)
    return s.select("source", "source_size", "n_docs", "rank", "weight", F.lit(whole["budget"]).cast("long").alias("budget"), F.lit(first).cast("double").alias("level"), target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, bin_rows: int = BIN_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and row of every row.

    row_col: a column of distinct numbers that name the rows; else rows are numbered here.
    """
    spark = docs.sparkSession
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), key.alias("key"), row.alias("row"))
    src = cut(src, "sizes")
    n_rows = src.count()
    again = src.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("again"), F.lit(True).alias("many"))
    if not again.isEmpty():
        spread = F.when(F.col("many"), F.md5(F.concat("key", F.lit("-"), F.col("row").cast("string")))).otherwise(F.col("key"))
        both = src.join(again, F.col("doc_id").eqNullSafe(F.col("again")), "left")
        src = cut(both.select("doc_id", "source", "size", spread.alias("key"), "row"), "sizes", n_rows)
    sources = cut(source_targets(src.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, max_repeats), "sources")

    # Position of each document's last token in its source's order.
    named = src.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    s = sources.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    d = named.join(s, "name")
    bins = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(bin_rows)))
    d = d.withColumn("bin", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(_HASH_RANGE) * bins))
    d = cut(d.select("row", "doc_id", "size", "source_size", "rank", "weight", "target", "key", "bin"), "placed", n_rows)
    total = d.groupBy("rank", "bin").agg(F.sum("size").alias("in_bin"))
    before = sums_before(total, "bin", ["in_bin"], ["rank"]).select("rank", "bin", F.col("in_bin_before").alias("before"))
    within = Window.partitionBy("rank", "bin").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.sum("size").over(within)).join(before, ["rank", "bin"]).withColumn("upto", F.col("upto") + F.col("before"))

    # All copies by finish time, and the global order cut off where the budget ends. Up
    # to the level of the targets, a slot of finish times has bin_rows copies on average.
    whole = sources.agg(F.max("budget").alias("budget"), F.max("level").alias("level"), F.sum("n_docs").alias("n")).first()
    copies = d.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(max_repeats))))
    copies = copies.withColumn("finish", ((F.col("copy") - 1) * F.col("source_size") + F.col("upto")) / F.col("weight"))
    if whole["budget"]:
        budget, n_slots = F.lit(whole["budget"]), max(1, -(-max_repeats * whole["n"] // bin_rows))
        slot = F.floor(F.col("finish") / F.lit(whole["level"]) * F.lit(n_slots)).alias("slot")
        copies = cut(copies.select("row", "rank", "size", "key", "doc_id", "copy", "finish", slot), "copies", max_repeats * n_rows)
        slots = sums_before(copies.groupBy("slot").agg(F.sum("size").alias("in_slot")), "slot", ["in_slot"])
        slots = slots.select("slot", F.col("in_slot_before").alias("before"), (F.col("in_slot_before") + F.col("in_slot")).alias("through"))
        edge = slots.where(F.col("through") > budget).orderBy("slot").first()
        edge_slot, before = (edge["slot"], edge["before"]) if edge else (None, 0)
        full = copies.where(F.col("slot") < F.lit(edge_slot)) if edge else copies
        took = full.select("row", "size")
        if edge:
            order = Window.partitionBy("slot").orderBy("finish", "rank", "key", "doc_id", "row", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            last = copies.where(F.col("slot") == F.lit(edge_slot)).withColumn("through", F.sum("size").over(order) + F.lit(before))
            took = took.union(last.where(F.col("through") <= budget).select("row", "size"))
        took = took.groupBy("row").agg(F.sum("size").alias("taken"), F.count(F.lit(1)).cast("int").alias("copies"))
    else:
        took = spark.createDataFrame([], "row long, taken long, copies int")
    out = d.select("row", "doc_id", "size", "source_size", "target").join(took, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies"), "row")


def repeat(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with all columns."""
    row = "_mix_row"
    while row in docs.columns:
        row += "_"
    held = cut(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    took = mix(held, weights, max_repeats, row_col=row).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(row + "n"))
    each = F.explode(F.sequence(F.lit(1), F.col(row + "n"))).alias(row + "c")
    return held.join(took, row).select(*docs.columns, each).select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, cap / weight AS full_at FROM s2),
s4 AS (
  SELECT *, sum(cap) OVER w - cap AS cap_before, sum(weight) OVER () - sum(weight) OVER w + weight AS weight_left, sum(source_size) OVER ()::BIGINT AS budget
  FROM s3 WINDOW w AS (ORDER BY full_at, rank ROWS UNBOUNDED PRECEDING)),
s5 AS (SELECT *, (budget - cap_before) / weight_left AS level_here FROM s4),
s6 AS (SELECT *, (SELECT level_here FROM s5 WHERE level_here <= full_at ORDER BY full_at, rank LIMIT 1) AS level FROM s5),
s AS (SELECT source, source_size, rank, weight, budget, coalesce(least(cap, weight * level), 0.0) AS target FROM s6),
p AS (
  SELECT d.doc_id, d.size, d.key, s.source_size, s.rank, s.weight, s.budget, s.target,
         sum(d.size) OVER (PARTITION BY s.rank ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (SELECT *, ((copy - 1) * source_size + upto) / weight AS finish FROM p, (SELECT unnest([1, 2, 3]) AS copy) WHERE size > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, key, doc_id, copy ROWS UNBOUNDED PRECEDING) AS through FROM c),
t AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM g WHERE through <= budget GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken FROM p LEFT JOIN t USING (doc_id)
"""
