"""From a question to a template's rows, in steps that may each say why it can't go on."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import routing
from evigraph.operators.graph import ENTITIES, MOST_ROWS, VALUE, Graph, QueryResult, Template, templates
from evigraph.operators.names import NameIndex, resolve_entities


class NoAnswer(Exception):
    """Why a question has no rows, in words for the reader."""


def chosen(asked: str, result: QueryResult) -> Template:
    """The template of a query type, a misspelt one included."""
    known = templates()
    result.query_type = routing.snap(asked, known) or asked or None
    if result.query_type not in known:
        raise NoAnswer(f"no such query type: {asked or 'none was named'}")
    return known[result.query_type]


def resolved(spark: SparkSession, g: Graph, surfaces: Sequence[str], index: Callable[[], NameIndex] | None = None) -> list[str]:
    """The names of the entities that the surfaces mean, in their order; unknown ones are left out."""
    if not surfaces:
        return []
    rows = resolve_entities(g, spark.createDataFrame([(s,) for s in surfaces], "surface string"), index() if index else None).collect()
    means = {r["surface"]: r["name"] for r in rows}
    return [means[s] for s in surfaces if s in means]


def bound(t: Template, names: Sequence[str], value: str) -> dict:
    """The template's slots filled in their order: an entity takes the next name, a list all that are left."""
    left, out = list(names), {}
    for slot, kind in t.slots:
        if kind == VALUE:
            out[slot] = value
            continue
        take = len(left) if kind == ENTITIES else 1
        if len(left) < (2 if kind == ENTITIES else 1):
            raise NoAnswer(f"too few known entities for {slot}: {', '.join(names) or 'none'}")
        out[slot] = left[:take] if kind == ENTITIES else left[0]
        left = left[take:]
    return out


def first_rows(df: DataFrame, order: Sequence[str], result: QueryResult) -> None:
    """The first rows in the template's order, by default that of all columns, and whether there are more."""
    order = order or [c for c in df.columns if c != "_src"] + [c for c in df.columns if c == "_src"]
    rows = df.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.col(c) for c in order]).limit(MOST_ROWS + 1).collect()
    result.rows, result.more = [r.asDict(recursive=True) for r in rows[:MOST_ROWS]], len(rows) > MOST_ROWS


def answered(spark: SparkSession, g: Graph, planner, question: str, index: Callable[[], NameIndex] | None = None) -> QueryResult:
    """All steps for one question; whatever fails leaves its reason and no rows."""
    result, step = QueryResult(None), "planning"
    try:
        said = planner.plan(question)
        template = chosen(str(said.get("query_type") or "").strip(), result)
        step = "naming"
        result.resolved = resolved(spark, g, [s for s in said.get("entities") or [] if s], index)
        result.params = bound(template, result.resolved, said.get("value") or "")
        step = "asking the graph"
        result.display = routing.display(template.pattern, result.params)
        first_rows(template.run(g, **result.params), template.order, result)
    except NoAnswer as e:
        result.error = str(e)
    except Exception as e:  # a planner or the graph may raise anything
        result.rows, result.error = [], f"{step} failed: {e}".splitlines()[0][:200]
    return result
