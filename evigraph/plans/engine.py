"""The engine: ingest documents, index chunks, answer questions.

For one question, plans are built and only their few rows come to the driver. For
tables of questions, ``route_many`` and the operators of ``answers`` stay distributed.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph import schemas as S
from evigraph.functions import text as X
from evigraph.operators import answers, routing
from evigraph.operators.graph import Graph, QueryResult
from evigraph.operators.maintain import cleanup, merge_edges, merge_nodes, valid_triples
from evigraph.operators.names import NameIndex
from evigraph.operators.vectors import IvfIndex
from evigraph.plans import providers as P
from evigraph.plans.asking import answered
from evigraph.session import materialise
from evigraph.sources import stores


def plain(value):
    """A value as JSON has it: dates and the like as text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


@dataclass
class Engine:
    """Tables below ``path`` and the providers that stand in for models."""

    spark: SparkSession
    path: str
    embedder: P.Embedder = field(default_factory=P.HashEmbedder)
    classifier: P.Classifier = field(default_factory=P.RuleClassifier)
    planner: P.Planner = field(default_factory=P.PatternPlanner)
    generator: P.Generator = field(default_factory=P.ExtractiveGenerator)
    extractor: P.Extractor | None = None
    threshold: float = routing.THRESHOLD
    retries: int = 2
    _vectors: IvfIndex | None = field(default=None, init=False, repr=False)
    _version: int = field(default=0, init=False, repr=False)

    # Documents to graph and vectors.

    def ingest(self, docs: DataFrame, size: int = 512, overlap: int = 64) -> int:
        """New documents (doc_id, text, ticker, company) to chunks and graph; how many were new."""
        docs = docs.where("text IS NOT NULL").withColumn("content_hash", X.fingerprint("text"))
        done = stores.manifest(self.spark, f"{self.path}/manifest")
        # Written once, so that all tables name the same.
        new = materialise(stores.firsts(stores.not_ingested(docs, done.read()), ["doc_id", "text", "ticker", "company"]), "new")
        cut = new.select("doc_id", F.explode(X.windows("text", size, overlap)).alias("w"))
        chunks = cut.select(X.chunk_id("doc_id", F.col("w.pos")).alias("chunk_id"), "doc_id", F.col("w.pos").alias("pos"), F.col("w.text").alias("text"))
        nodes, edges, mentions = self.extract(chunks)
        stores.write_graph(self.spark, f"{self.path}/graph", Graph(nodes, edges, mentions, chunks))
        recorded = new.select(F.col("content_hash").alias("hash"), "ticker", "company", F.current_timestamp().alias("ingested_at"))
        n = recorded.count()
        done.upsert(recorded)
        return n

    def extract(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, edges and mentions from the extractor's triples of allowed shapes."""
        extractor = self.extractor or P.PatternExtractor(S.ALLOWED_SHAPES, S.RELATION_PHRASES)
        names = ["chunk_id", "s_type", "s", "rel", "o_type", "o"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(cid, *t) for cid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in extractor.triples(text)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names)

        found = chunks.select("chunk_id", "text").mapInArrow(run, ", ".join(f"{n} string" for n in names))
        found = valid_triples(found, S.allowed(self.spark))
        eid = lambda label, name: F.concat_ws(":", label, name)
        found = found.withColumns({"src": eid("s_type", "s"), "dst": eid("o_type", "o")})
        none = F.lit(None).cast("array<string>").alias("aliases")
        nodes = found.select(F.col("src").alias("eid"), F.col("s_type").alias("label"), F.col("s").alias("name"), none).unionByName(
            found.select(F.col("dst").alias("eid"), F.col("o_type").alias("label"), F.col("o").alias("name"), none)
        )
        mentions = found.select("chunk_id", F.explode(F.array("src", "dst")).alias("eid")).distinct()
        edges = merge_edges(found.select("src", "rel", "dst", F.col("chunk_id").alias("triplet_source_id")))
        return merge_nodes(nodes), edges.select(S.EDGES.names), mentions

    def graph(self) -> Graph:
        return stores.read_graph(self.spark, f"{self.path}/graph")

    def clean(self) -> None:
        """Junk, duplicates and self-loops go from the stored graph."""
        g, tables = cleanup(self.graph()), stores.graph_tables(self.spark, f"{self.path}/graph")
        for name in ("nodes", "edges", "mentions"):
            tables[name].replace(getattr(g, name))

    def index(self, sections: DataFrame | None = None, dates: DataFrame | None = None) -> int:
        """Embed all chunks and put them into the vector table, whose other rows go; index that version of it."""
        g = self.graph()
        rows = g.chunks.join(g.mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set("eid")).alias("entity_ids")), "chunk_id", "left")
        rows = rows.withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))
        rows = rows.join(sections, "chunk_id", "left") if sections is not None else rows.withColumn("item", F.lit("other"))
        rows = rows.join(dates, "doc_id", "left") if dates is not None else rows.withColumn("filing_date", F.lit(None).cast("date"))
        rows = rows.select("chunk_id", "doc_id", F.coalesce("item", F.lit("other")).alias("section_path"), "filing_date", "entity_ids", "text")
        embedder = self.embedder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = embedder.embed(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(vectors), pa.list_(pa.float32()))], [*batch.schema.names, "embedding"])

        table = stores.chunk_vectors(self.spark, f"{self.path}/vectors")
        table.upsert(rows.mapInArrow(run, S.CHUNK_VECTORS), table.read().join(g.chunks, "chunk_id", "left_anti"))
        self._index(table)
        return table.count()

    def _index(self, table: stores.KeyedTable) -> IvfIndex | None:
        """The index of the newest version of the vector table, built if it isn't there."""
        version = table.version()
        if version and version != self._version:
            build = lambda path: IvfIndex(table.read(version), id_col="chunk_id", path=path)
            self._vectors = IvfIndex.open(self.spark, stores.built_once(self.spark, f"{self.path}/vector_index/{version}", build))
            self._version = version
        return self._vectors

    def name_index(self) -> NameIndex:
        """The index of the names in the newest version of the graph, built if it isn't there."""
        version = stores.graph_tables(self.spark, f"{self.path}/graph")["nodes"].version()
        build = lambda path: NameIndex.build(self.graph(), path)
        return NameIndex(self.spark, stores.built_once(self.spark, f"{self.path}/name_index/{version}", build))

    # Questions.

    def retrieve(self, question: str, k: int = 5) -> list[dict]:
        """The k chunks most similar to a question, by the index of the newest vectors; none before there are any."""
        query = [float(x) for x in self.embedder.embed([question])[0]]
        table = stores.chunk_vectors(self.spark, f"{self.path}/vectors")
        index = self._index(table)
        best = {r["chunk_id"]: r["similarity"] for r in index.topk(query, k).collect()} if index else {}
        full = table.read(self._version).drop("embedding").where(F.col("chunk_id").isin(list(best))).collect() if best else []
        found = [r.asDict(recursive=True) | {"similarity": best[r["chunk_id"]]} for r in full]
        return sorted(found, key=lambda r: (-r["similarity"], r["chunk_id"]))

    def query_graph(self, question: str) -> QueryResult:
        """A template chosen by the planner, with resolved names; any failure is an error without rows."""
        return answered(self.spark, self.graph(), self.planner, question, self.name_index)

    def route(self, question: str, log: bool = True) -> dict:
        """Classify, run the path or both, and note the decision."""
        began = time.perf_counter()
        said = self.classifier.classify(question)
        asked = self.spark.createDataFrame([(question, *(said or (None, None)))], "question string, path string, conf double")
        d = routing.decisions(asked, "question", "path", "conf", self.threshold).first()
        hits = self.retrieve(question) if d["used"] != routing.GRAPH else None
        graph = self.query_graph(question) if d["used"] != routing.VECTOR else None
        ms = round((time.perf_counter() - began) * 1000, 1)
        record = {k: d[k] for k in ("question", "classified", "confidence", "low_confidence", "path_used")}
        record |= {"router_model": type(self.classifier).__name__, "latency_ms": ms, "outcome": routing.outcome(hits, graph)}
        if log:
            row = {"ts": datetime.now(timezone.utc), **record}
            stores.append_log(self.spark.createDataFrame([row], S.DECISION_LOG), f"{self.path}/log")
        return record | {"vector": hits, "graph": graph}

    def route_many(self, questions: DataFrame) -> DataFrame:
        """Decisions for a table of questions, by the rules."""
        return routing.decisions(questions)

    def ask(self, question: str, log: bool = True) -> dict:
        """A grounded, cited answer, of plain values that JSON can hold."""
        r = self.route(question, log)
        graph = r["graph"]
        sources = {row.get("_src") for row in (graph.rows if graph else [])} - {None}
        hits = list({h["chunk_id"]: plain(h) for h in reversed(r["vector"] or []) if h["chunk_id"] not in sources}.values())[::-1]
        shown = [{"tag": tag, "kind": "graph-derived fact", "text": said} for tag, said in answers.labelled(graph)]
        for i, h in enumerate(hits[: answers.MOST_PASSAGES], 1):
            cite = f"{h['doc_id']} · {h['section_path']} · {h['filing_date']} (chunk {h['chunk_id'][:8]})"
            shown.append({"tag": f"P{i}", "kind": "retrieved passage", "cite": cite, "text": " ".join(h["text"].split())[:400]})
        out = {k: r[k] for k in ("question", "classified", "confidence", "path_used", "latency_ms")}
        out |= {"graph_statements": answers.statements(graph), "sources": shown, "graph_result": plain(graph and asdict(graph)), "vector_hits": hits, "graph": answers.evidence_graph(graph)}
        if not shown:
            return out | {"answer": answers.ABSTAIN, "attempts": 0, "citations_valid": True, "uncited_claims": []}
        return out | answers.grounded(question, shown, self.generator, self.retries)

    def respond(self, question: str, log: bool = True) -> dict:
        """An answer in the shape that a web client takes."""
        began = time.perf_counter()
        return answers.response(self.ask(question, log), time.perf_counter() - began)

    def baseline(self, question: str, k: int = 5) -> str:
        """Answer from passages alone, for comparison."""
        hits = self.retrieve(question, k)
        if not hits:
            return answers.ABSTAIN
        return self.generator(question, [{"tag": f"P{i}", "kind": "retrieved passage", "text": " ".join(h["text"].split())[:400]} for i, h in enumerate(hits, 1)], None)
