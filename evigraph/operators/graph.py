"""The property graph as DataFrames, and its query templates.

A template is a function from bound parameters to a DataFrame; parameters are
literals in the plan, never text of a query.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.session import materialise

#: Rows of any template's answer.
MOST_ROWS = 50
CHUNK = "Chunk"


@dataclass(frozen=True)
class Graph:
    """nodes (eid, label, name, aliases) and edges (src, rel, dst, triplet_source_id)."""

    nodes: DataFrame
    edges: DataFrame
    mentions: DataFrame | None = None
    chunks: DataFrame | None = None

    def entities(self) -> DataFrame:
        """Named nodes that are no chunks."""
        return self.nodes.where((F.col("label") != CHUNK) & F.col("name").isNotNull())

    def anchors(self, names: Sequence[str], label: str | None = None) -> DataFrame:
        """Nodes of given names; a name may be that of several."""
        found = self.nodes.where(F.col("name").isin(list(names)))
        return found.where(F.col("label") == label) if label else found

    def undirected(self) -> DataFrame:
        """(here, rel, there, triplet_source_id) in both directions; a self-loop once."""
        e = self.edges
        there = e.where("src <> dst").select(F.col("dst").alias("here"), "rel", F.col("src").alias("there"), "triplet_source_id")
        return e.select(F.col("src").alias("here"), "rel", F.col("dst").alias("there"), "triplet_source_id").unionByName(there)


def attached(edges: DataFrame, nodes: DataFrame, end: str, column: str, value: str = "name") -> DataFrame:
    """Edges with ``value`` of the node at ``end`` as ``column``.

    For edges that are many more than the nodes: ids of nodes are distinct, so each task
    hashes its share of the nodes, and the edges, of a hub too, pass by unsorted.
    """
    return edges.join(nodes.select(F.col("eid").alias(end), F.col(value).alias(column)).hint("shuffle_hash"), end)


def _ids(df: DataFrame, column: str) -> DataFrame:
    """The distinct ids of ``df`` as ``column``, stored, so that Spark knows whether they are few enough to be sent to the edges."""
    return materialise(df.select(F.col("eid").alias(column)).distinct(), "ids")


def _names(df: DataFrame, eid: str, name: str) -> DataFrame:
    return df.select(F.col("eid").alias(eid), F.col("name").alias(name))


def out_hop(g: Graph, names: Sequence[str], rel: str, column: str, label: str | None = None) -> DataFrame:
    """(column, _src) of the targets of ``rel`` from the named nodes, one row an edge."""
    hits = g.edges.where(F.col("rel") == rel).join(_ids(g.anchors(names, label), "src"), "src", "left_semi")
    return hits.join(_names(g.nodes, "dst", column), "dst").select(column, F.col("triplet_source_id").alias("_src"))


def count_hop(g: Graph, name: str, rel: str, label: str | None = None) -> DataFrame:
    """One row: the number of edges, 0 without any."""
    hits = g.edges.where(F.col("rel") == rel).join(_ids(g.anchors([name], label), "src"), "src", "left_semi")
    return hits.agg(F.count(F.lit(1)).alias("count"))


def undirected_hop(g: Graph, name: str, rel: str, column: str) -> DataFrame:
    """Distinct names on the other end of ``rel`` edges."""
    hits = g.undirected().where(F.col("rel") == rel).join(_ids(g.anchors([name]), "here"), "here", "left_semi")
    return hits.join(_names(g.nodes, "there", column), "there").select(column).distinct()


def neighbours(g: Graph, name: str, limit: int = MOST_ROWS) -> DataFrame:
    """(relation, connected_to) over all relations, chunks left out, in a total order."""
    hits = g.undirected().join(_ids(g.anchors([name]), "here"), "here", "left_semi")
    far = g.nodes.where(F.col("label") != CHUNK).select(F.col("eid").alias("there"), F.col("name").alias("connected_to"))
    return hits.join(far, "there").select(F.col("rel").alias("relation"), "connected_to").orderBy("relation", "connected_to").limit(limit)


def compare_counts(g: Graph, names: Sequence[str], rel: str, label: str | None = None) -> DataFrame:
    """(company, count), most first; names without edges are absent."""
    who = g.anchors(names, label).select(F.col("eid").alias("src"), F.col("name").alias("company"))
    hits = g.edges.where(F.col("rel") == rel).join(who, "src")
    return hits.groupBy("company").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "company")


def facing(g: Graph, keyword: str, rel: str, column: str = "company") -> DataFrame:
    """Distinct subjects of ``rel`` edges whose object's name contains the keyword, case aside."""
    what = g.nodes.where(F.lower("name").contains((keyword or "").lower())).select(F.col("eid").alias("dst"))
    hits = g.edges.where(F.col("rel") == rel).join(what, "dst", "left_semi")
    return hits.join(_names(g.nodes, "src", column), "src").select(column).distinct()


def expand(g: Graph, start: DataFrame, rel: str, out: bool = True) -> DataFrame:
    """Nodes one ``rel`` hop from those of ``start`` (eid); chains make longer patterns."""
    here, there = ("src", "dst") if out else ("dst", "src")
    hits = g.edges.where(F.col("rel") == rel).join(_ids(start, here), here, "left_semi")
    return hits.select(F.col(there).alias("eid")).distinct()


#: What a question fills a slot with: the next entity it names, all of them, or its value.
ENTITY, ENTITIES, VALUE = "entity", "entities", "value"


@dataclass(frozen=True)
class Reading:
    """How a template's rows read as facts: where subject, relation and object come from.

    A name that begins with $ is a parameter, one that begins with = is meant as it
    stands, others are columns. amount is a column that counts, path and hops are those
    of a chain of names and the relations between them. together: all rows are one
    statement. sentence words a statement, by default as each fact's subject, relation
    and object.
    """

    subject: str = "$name"
    relation: str | None = None
    object: str | None = None
    amount: str | None = None
    path: str | None = None
    hops: str | None = None
    together: bool = False
    sentence: str | None = None


@dataclass(frozen=True)
class Template:
    """A query type: its rows, the slots that a question fills, how rows are ordered (-: most first) and read."""

    run: Callable[..., DataFrame]
    desc: str
    pattern: str
    slots: tuple[tuple[str, str], ...]
    reading: Reading
    order: tuple[str, ...] = ()


def templates() -> dict[str, Template]:
    """The registry of query types."""
    from evigraph.operators.paths import path_between

    name, both = (("name", ENTITY),), (("a", ENTITY), ("b", ENTITY))
    # Names of the query types and the wording of their statements.
    return {
        "subsidiaries_of": Template(
            lambda g, name: out_hop(g, [name], "HAS_SUBSIDIARY", "subsidiary", "COMPANY"), "list the subsidiaries of a company", "(COMPANY $name)-[HAS_SUBSIDIARY]->(subsidiary)", name,
            Reading(relation="=HAS_SUBSIDIARY", object="subsidiary", together=True, sentence="{subject}'s subsidiaries include: {objects}."),
        ),
        "count_subsidiaries": Template(
            lambda g, name: count_hop(g, name, "HAS_SUBSIDIARY", "COMPANY"), "how many subsidiaries a company has", "count (COMPANY $name)-[HAS_SUBSIDIARY]->()", name,
            Reading(amount="count", sentence="{subject} has {amount} subsidiaries recorded in the graph."),
        ),
        "risks_of": Template(
            lambda g, name: out_hop(g, [name], "FACES_RISK", "risk"), "the risks a company faces", "($name)-[FACES_RISK]->(risk)", name,
            Reading(relation="=FACES_RISK", object="risk", together=True, sentence="{subject} discloses these risks: {objects}."),
        ),
        "executives_of": Template(
            lambda g, name: out_hop(g, [name], "HAS_EXECUTIVE", "executive"), "the executives of a company", "($name)-[HAS_EXECUTIVE]->(executive)", name,
            Reading(relation="=HAS_EXECUTIVE", object="executive", together=True, sentence="{subject}'s executives include: {objects}."),
        ),
        "competitors_of": Template(
            lambda g, name: undirected_hop(g, name, "COMPETES_WITH", "competitor"), "the competitors of a company", "($name)-[COMPETES_WITH]-(competitor)", name,
            Reading(relation="=COMPETES_WITH", object="competitor", together=True, sentence="{subject}'s competitors include: {objects}."),
        ),
        "regulators_of": Template(
            lambda g, name: out_hop(g, [name], "REGULATED_BY", "regulator"), "the regulators of a company", "($name)-[REGULATED_BY]->(regulator)", name,
            Reading(relation="=REGULATED_BY", object="regulator", together=True, sentence="{subject} is regulated by: {objects}."),
        ),
        "neighbors": Template(
            lambda g, name: neighbours(g, name, MOST_ROWS + 1), "what an entity is connected to", "($name)-[relation]-(connected_to)", name,
            Reading(relation="relation", object="connected_to"), ("relation", "connected_to"),
        ),
        "path_between": Template(
            lambda g, a, b: path_between(g, a, b), "how two entities are connected", "shortest ($a)-[*..5]-($b)", both,
            Reading(path="path", hops="relations"), ("relations", "path"),
        ),
        "compare_subsidiary_counts": Template(
            lambda g, names: compare_counts(g, names, "HAS_SUBSIDIARY", "COMPANY"), "compare subsidiary counts of two or more companies", "count (COMPANY in $names)-[HAS_SUBSIDIARY]->()", (("names", ENTITIES),),
            Reading(subject="company", amount="count", sentence="{subject} has {amount} subsidiaries."), ("-count", "company"),
        ),
        "companies_facing_risk": Template(
            lambda g, risk: facing(g, risk, "FACES_RISK"), "which companies face a given risk", "(company)-[FACES_RISK]->(name contains $risk)", (("risk", VALUE),),
            Reading(subject="company", relation="=FACES_RISK", object="$risk", together=True, sentence="Companies that face '{object}' risk: {subjects}."),
        ),
    }
    # End of fixed values.


@dataclass
class QueryResult:
    """Rows of a template, or the error that left it without rows."""

    query_type: str | None
    rows: list[dict] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    resolved: list[str] = field(default_factory=list)
    display: str | None = None
    error: str | None = None
    #: Whether the template has more rows than these.
    more: bool = False


def chunk_entities(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Chunks with the sorted ids of the entities they mention, empty if none."""
    ids = chunks.join(mentions, "chunk_id", "left").groupBy("chunk_id").agg(F.array_sort(F.collect_list("eid")).alias("entity_ids"))
    return ids


def vector_to_graph(hits: DataFrame, g: Graph) -> DataFrame:
    """From vector hits (chunk_id, entity_ids) over their entities to those entities' edges."""
    seeds = hits.select("chunk_id", F.explode("entity_ids").alias("src"))
    return g.edges.join(seeds, "src").select("chunk_id", "src", "rel", "dst")


def edge_to_text(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges with the text of the chunk they come from."""
    return edges.join(chunks.select(F.col("chunk_id").alias("triplet_source_id"), "text"), "triplet_source_id")


def node_counts(g: Graph) -> DataFrame:
    """(label, n) of all nodes."""
    return g.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def edge_counts(g: Graph) -> DataFrame:
    """(rel, n) of all edges."""
    return g.edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def totals(g: Graph) -> DataFrame:
    """(nodes, entities, edges): one row."""
    n = g.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if((F.col("label") != CHUNK) & F.col("name").isNotNull()).alias("entities"))
    return n.crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edges")))  # one row with one row


def sample_edges(g: Graph, rel: str, n: int = 15) -> DataFrame:
    """The first n edges of a relation by their names."""
    e = g.edges.where(F.col("rel") == rel).join(_names(g.nodes, "src", "source"), "src").join(_names(g.nodes, "dst", "target"), "dst")
    return e.select("source", "rel", "target").orderBy("source", "target").limit(n)


def rank_by(df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each partition, with their rank."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)
