"""Entities by the names asked for: equal names, equal aliases, and names that contain one another.

A name index holds every distinct lower-case name and its grams: the three characters at
each of its places, filled up at the end, with the place. A text lies in a name if its
rarest gram does, at a place that puts the whole text there; so each text is looked up by
one gram, and what comes back is checked by its place alone. For names inside texts the
same is done with the two exchanged. Nothing passes the driver, and names are scanned once
whatever the number of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators.graph import Graph
from evigraph.session import fresh_path, materialise

#: Characters of a gram, and what fills up the last ones of a name; it stands in no name that is read from a text.
GRAM, FILL = 3, "\x00"


def _best() -> Column:
    """The shortest name, of equally long ones the first."""
    return F.min(F.struct("n", "name")).alias("best")


def grams(rows: DataFrame, text: str) -> DataFrame:
    """(text, gram, pos): a gram for each place of each text."""
    padded = F.concat(F.col(text), F.lit(FILL * (GRAM - 1)))
    place = F.explode(F.sequence(F.lit(1), F.length(text))).alias("pos")
    placed = rows.where(F.length(text) > 0).select(text, padded.alias("padded"), place)
    return placed.select(text, F.substring("padded", F.col("pos"), F.lit(GRAM)).alias("gram"), "pos")


def _rarest(texts: DataFrame, text: str, counts: DataFrame) -> DataFrame:
    """(text, gram, pos) of the rarest whole gram of each text; texts with a gram that is not counted can't be found."""
    whole = grams(texts, text).where(F.col("pos") <= F.length(text) - (GRAM - 1)).join(counts, "gram")
    found = whole.groupBy(text).agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "pos", "gram")).alias("least"))
    return found.where(F.col("known") == F.length(text) - (GRAM - 1)).select(text, "least.gram", F.col("least.pos").alias("off"))


def _inside(part: DataFrame, small: str, postings: DataFrame, large: str, counts: DataFrame) -> DataFrame:
    """(small, large): the texts of ``part`` that lie in those of ``postings`` (large, gram, pos)."""
    keyed = _rarest(part.where(F.length(small) >= GRAM), small, counts)
    begin = F.col("pos") - F.col("off") + 1
    there = (begin >= 1) & (F.substring(large, begin, F.length(small)) == F.col(small))
    hits = postings.join(keyed, "gram").where(there).select(small, large)
    for n in range(1, GRAM):  # too short for a gram: the beginning of one
        short = part.where(F.length(small) == n).select(small, F.col(small).alias("_start"))
        hits = hits.unionByName(postings.withColumn("_start", F.substring("gram", 1, n)).join(short, "_start").select(small, large))
    return hits.distinct()


class NameIndex:
    """A stored index of the names of a graph: names (low, n, name) and grams (low, gram, pos)."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.names = spark.read.schema("low string, n int, name string").parquet(f"{path}/names")
        self.grams = spark.read.schema("low string, gram string, pos int").parquet(f"{path}/grams")
        self.counts = spark.read.schema("gram string, n long").parquet(f"{path}/counts")

    @classmethod
    def build(cls, g: Graph, path: str | None = None) -> NameIndex:
        """Write the index of a graph's names; of names that are alike but for case the shortest, then the first."""
        spark = g.nodes.sparkSession
        path = path or fresh_path(spark, "names")
        low = g.entities().select(F.lower("name").alias("low"), F.length("name").alias("n"), "name")
        low.groupBy("low").agg(_best()).select("low", "best.n", "best.name").write.parquet(f"{path}/names")
        names = spark.read.schema("low string, n int, name string").parquet(f"{path}/names")
        grams(names, "low").write.parquet(f"{path}/grams")
        placed = spark.read.schema("low string, gram string, pos int").parquet(f"{path}/grams")
        placed.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")
        return cls(spark, path)

    def containing(self, want: DataFrame) -> DataFrame:
        """(want, n, name): for each lower-case text the best of the names that contain it or lie in it."""
        texts = materialise(grams(want, "want"), "text-grams")
        there = _inside(want, "want", self.grams, "low", self.counts)
        held = texts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        # Names without any gram of the texts are left out before their grams are counted.
        likely = self.names.select("low").join(self.grams.join(held, "gram", "left_semi").select("low").distinct(), "low", "left_semi")
        short = self.names.where(F.length("low") < GRAM).select("low")
        here = _inside(likely.unionByName(short).distinct(), "low", texts, "want", held)
        found = there.unionByName(here).join(self.names, "low").groupBy("want").agg(_best())
        # The empty text lies in every name, and the empty name in every text: one row each.
        any_name = want.where("want = ''").crossJoin(self.names.agg(_best()))
        blank = want.crossJoin(self.names.where("low = ''").agg(_best())).where("best.name IS NOT NULL")
        both = found.unionByName(any_name).unionByName(blank)
        return both.groupBy("want").agg(F.min("best").alias("best")).where("best.name IS NOT NULL").select("want", "best.n", "best.name")


def _first(by: Column) -> Column:
    return F.min(F.struct(F.length(by).alias("n"), by.alias("name")))["name"].alias("name")


def resolve_entities(g: Graph, surfaces: DataFrame, index: NameIndex | None = None) -> DataFrame:
    """(surface, name, score) of the best entity for each surface name; none if nothing matches.

    ``surfaces`` is one column of names asked for. An equal name scores 3, an equal alias
    2, one that contains the other 1, all in lower case; of equal scores the shortest
    name, then the first, is taken. Equal names and aliases are found by equi-joins, what
    they leave by the name index, which is built if none is given.
    """
    want = surfaces.select(F.col(surfaces.columns[0]).alias("surface")).where("surface IS NOT NULL").distinct().withColumn("want", F.lower("surface"))
    want = materialise(want, "surfaces")
    names = g.entities().select("name", "aliases", F.lower("name").alias("low"))
    sought = want.select("want").distinct()
    same = names.select("name", F.col("low").alias("want")).join(sought, "want").groupBy("want").agg(_first(F.col("name"))).withColumn("score", F.lit(3))
    alias = names.select("name", F.explode("aliases").alias("alias")).select("name", F.lower("alias").alias("want"))
    alias = alias.join(sought, "want").groupBy("want").agg(_first(F.col("name"))).withColumn("score", F.lit(2))
    sure = same.unionByName(alias).groupBy("want").agg(F.max_by("name", "score").alias("name"), F.max("score").alias("score"))
    sure = materialise(sure, "sure")
    rest = materialise(sought.join(sure, "want", "left_anti"), "rest")
    found = sure
    if not rest.isEmpty():
        index = index or NameIndex.build(g)
        found = sure.unionByName(index.containing(rest).select("want", "name", F.lit(1).alias("score")))
    return want.join(found, "want").select("surface", "name", "score")
