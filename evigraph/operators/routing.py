"""Routing questions to the graph path, the vector path or both."""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import ColumnLike, col

VECTOR, GRAPH, HYBRID = "VECTOR", "GRAPH", "HYBRID"
THRESHOLD = 0.6

# The phrases by which the rules know a question.
GRAPH_PHRASES = (
    "how many", "number of", "count", "total", "most", "fewest", "list all", "which companies", "who are",
    "regulated by", "connected to", "related to", "linked to", "relationship between", "path from",
    "compare", "versus", r"vs\.?", "difference between", "more .* than",
    "suppliers? of", "competitors? of", "subsidiaries? of", "executives? of",
)
GRAPH_POSSESSIVE = r"\b\w+'s (suppliers?|competitors?|subsidiaries?|executives?)\b"
VECTOR_PHRASES = (
    "what is", "what are", "define", "definition of", "meaning of", "policy on", "policy for",
    "policy regarding", "approach to", "who is", "when did", "where is",
)
# End of fixed values.

GRAPH_RULE = rf"(?i)\b({'|'.join(GRAPH_PHRASES)})\b|{GRAPH_POSSESSIVE}"
VECTOR_RULE = rf"(?i)\b({'|'.join(VECTOR_PHRASES)})\b"


def rule(question: ColumnLike) -> Column:
    """GRAPH if a graph phrase is there, else VECTOR if one of its is, else null."""
    q = col(question)
    return F.when(q.rlike(GRAPH_RULE), GRAPH).when(q.rlike(VECTOR_RULE), VECTOR)


def cross_checked(model_path: ColumnLike, model_conf: ColumnLike, question: ColumnLike, threshold: float = THRESHOLD) -> tuple[Column, Column]:
    """(path, confidence) after the rules had their say.

    A model that failed (null path) leaves the rule at the threshold, or HYBRID at 0; a
    rule that disagrees takes the confidence below the threshold.
    """
    said, conf, own = col(model_path), F.coalesce(col(model_conf), F.lit(0.5)), rule(question)
    failed = said.isNull()
    path = F.when(failed, F.coalesce(own, F.lit(HYBRID))).otherwise(said)
    lowered = F.when(own.isNotNull() & (own != said), F.least(conf, F.lit(threshold - 0.01))).otherwise(conf)
    return path, F.when(failed, F.when(own.isNotNull(), F.lit(threshold)).otherwise(F.lit(0.0))).otherwise(lowered)


def used_path(path: ColumnLike, confidence: ColumnLike, threshold: float = THRESHOLD) -> Column:
    """HYBRID if so classified or not sure, else as classified."""
    return F.when((col(path) == HYBRID) | (col(confidence) < threshold), HYBRID).otherwise(col(path))


def path_label(path: ColumnLike, confidence: ColumnLike, threshold: float = THRESHOLD) -> Column:
    """The path used, as the decision log words it."""
    low = col(confidence) < threshold
    both = F.concat(F.lit("HYBRID (both + merge)"), F.when(low, " [low-confidence fallback]").otherwise(""))
    return F.when(used_path(path, confidence, threshold) == HYBRID, both).otherwise(col(path))


def decisions(questions: DataFrame, question: str = "question", model_path: str | None = None, model_conf: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """classified, confidence, low_confidence, used and path_used beside the questions."""
    none = F.lit(None).cast("string")
    path, conf = cross_checked(F.col(model_path) if model_path else none, F.col(model_conf) if model_conf else F.lit(None).cast("double"), question, threshold)
    out = questions.withColumns({"classified": path, "confidence": F.bround(conf, 2)}).withColumn("_conf", conf)
    out = out.withColumns({"low_confidence": F.col("_conf") < threshold, "used": used_path("classified", "_conf", threshold), "path_used": path_label("classified", "_conf", threshold)})
    return out.drop("_conf")


def hybrid_merge(graph_evidence: DataFrame, passages: DataFrame) -> DataFrame:
    """Both kinds of evidence, one after the other, not ranked anew."""
    return graph_evidence.withColumn("kind", F.lit("graph-derived fact")).unionByName(passages.withColumn("kind", F.lit("retrieved passage")), allowMissingColumns=True)


def snap(key: str, known: Iterable[str], cutoff: float = 0.7) -> str | None:
    """A known key, or the one nearest to a misspelt one, or None."""
    known = list(known)
    if key in known:
        return key
    close = difflib.get_close_matches(key, known, n=1, cutoff=cutoff)
    return close[0] if close else None


def display(pattern: str, params: Mapping[str, object]) -> str:
    """A pattern with its parameters as JSON, for reading only."""
    for name, value in params.items():
        pattern = pattern.replace(f"${name}", json.dumps(value))
    return pattern


def outcome(vector_hits: list[dict] | None, graph: object | None) -> dict:
    """What each path returned, in a few numbers."""
    out: dict = {}
    if vector_hits is not None:
        top = vector_hits[0] if vector_hits else None
        shown = top and {"chunk_id": top["chunk_id"], "doc_id": top["doc_id"], "section": top["section_path"], "similarity": round(top["similarity"], 3)}
        out["vector"] = {"count": len(vector_hits), "top": shown}
    if graph is not None:
        out["graph"] = {"query_type": graph.query_type, "resolved": graph.resolved, "rows": len(graph.rows), "error": graph.error}
    return out
