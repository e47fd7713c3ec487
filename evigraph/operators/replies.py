"""Replies of models as tables: the JSON in them, whatever stands around it.

A reply without a JSON object, or without a known path or query type, is a failed one;
the rules then decide (``routing.cross_checked`` takes a null path for that).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.functions.text import ColumnLike, col
from evigraph.operators.routing import GRAPH, HYBRID, VECTOR

PATHS = (VECTOR, GRAPH, HYBRID)
#: The confidence of a reply that gives none.
UNSURE = 0.5
#: How like a known query type, in letters that need no change, a misspelt one must be.
LIKE = 0.7

_OBJECT = r"(?s)\{.*\}"


def json_part(reply: ColumnLike) -> Column:
    """From the first brace of a reply to its last, null without them (N)."""
    return F.nullif(F.regexp_extract(F.coalesce(col(reply), F.lit("")), _OBJECT, 0), F.lit(""))


def classification(reply: ColumnLike) -> tuple[Column, Column]:
    """(path, confidence) of a classifier's reply, null path if it failed."""
    said = F.from_json(json_part(reply), "path string, confidence string")
    path = F.upper(F.trim(said["path"]))
    conf = F.coalesce(said["confidence"].try_cast("double"), F.lit(UNSURE))
    known = path.isin(*PATHS)
    return F.when(known, path), F.when(known, conf)


def plan(reply: ColumnLike, known: Iterable[str]) -> Column:
    """Struct (query_type, entities, value) of a planner's reply.

    A misspelt query type becomes the nearest known one, if at most 3 letters in 10
    differ; another, or a reply without JSON, gives a null type.
    """
    said = F.from_json(json_part(reply), "query_type string, entities array<string>, value string")
    asked = F.trim(said["query_type"])
    names = F.array(*[F.lit(k) for k in sorted(known)])
    ranked = F.transform(names, lambda k: F.struct((F.levenshtein(asked, k) / F.greatest(F.length(asked), F.length(k))).alias("far"), k.alias("name")))
    near = F.array_min(ranked)
    kind = F.when(asked.isNotNull() & (asked != "") & (near["far"] <= 1 - LIKE), near["name"])
    entities = F.filter(F.coalesce(said["entities"], F.array().cast("array<string>")), lambda e: F.coalesce(F.trim(e), F.lit("")) != "")
    return F.struct(kind.alias("query_type"), entities.alias("entities"), F.coalesce(said["value"], F.lit("")).alias("value"))


def object_in(reply: str) -> dict:
    """The JSON object in one reply; ValueError if there is none."""
    found = re.search(_OBJECT, reply or "")
    said = json.loads(found[0]) if found else None
    if not isinstance(said, dict):
        raise ValueError("the reply has no JSON object")
    return said
