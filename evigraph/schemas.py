"""The data model: entity and relation types, allowed shapes, and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The ontology. A relation's first shape gives its usual end types.
ENTITY_TYPES = ("COMPANY", "PERSON", "PRODUCT", "SEGMENT", "RISK", "AUDITOR", "LOCATION", "GOVERNMENT_AGENCY", "STOCK_EXCHANGE")
ALLOWED_SHAPES = (
    ("COMPANY", "HAS_SUBSIDIARY", "COMPANY"),
    ("COMPANY", "COMPETES_WITH", "COMPANY"),
    ("COMPANY", "PARTNERS_WITH", "COMPANY"),
    ("COMPANY", "ACQUIRED", "COMPANY"),
    ("COMPANY", "SUPPLIES_TO", "COMPANY"),
    ("COMPANY", "HAS_EXECUTIVE", "PERSON"),
    ("COMPANY", "HAS_DIRECTOR", "PERSON"),
    ("COMPANY", "OFFERS_PRODUCT", "PRODUCT"),
    ("COMPANY", "OPERATES_SEGMENT", "SEGMENT"),
    ("COMPANY", "FACES_RISK", "RISK"),
    ("COMPANY", "AUDITED_BY", "AUDITOR"),
    ("COMPANY", "HEADQUARTERED_IN", "LOCATION"),
    ("COMPANY", "OPERATES_IN", "LOCATION"),
    ("COMPANY", "REGULATED_BY", "GOVERNMENT_AGENCY"),
    ("COMPANY", "LISTED_ON", "STOCK_EXCHANGE"),
    ("SEGMENT", "OFFERS_PRODUCT", "PRODUCT"),
)
RELATION_PHRASES = {
    "HAS_SUBSIDIARY": "has subsidiary",
    "COMPETES_WITH": "competes with",
    "PARTNERS_WITH": "partners with",
    "ACQUIRED": "acquired",
    "SUPPLIES_TO": "supplies to",
    "HAS_EXECUTIVE": "has executive",
    "HAS_DIRECTOR": "has director",
    "OFFERS_PRODUCT": "offers",
    "OPERATES_SEGMENT": "operates segment",
    "FACES_RISK": "faces the risk",
    "AUDITED_BY": "is audited by",
    "HEADQUARTERED_IN": "is headquartered in",
    "OPERATES_IN": "operates in",
    "REGULATED_BY": "is regulated by",
    "LISTED_ON": "is listed on",
}
# End of fixed values.

RELATION_TYPES = tuple(RELATION_PHRASES)
_TEXT, _TEXTS, _LONG, _DOUBLE = T.StringType(), T.ArrayType(T.StringType()), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


NODES = _struct(eid=_TEXT, label=_TEXT, name=_TEXT, aliases=_TEXTS)
EDGES = _struct(src=_TEXT, rel=_TEXT, dst=_TEXT, triplet_source_id=_TEXT)
MENTIONS = _struct(chunk_id=_TEXT, eid=_TEXT)
CHUNKS = _struct(chunk_id=_TEXT, doc_id=_TEXT, pos=T.IntegerType(), text=_TEXT)
CHUNK_VECTORS = _struct(chunk_id=_TEXT, doc_id=_TEXT, section_path=_TEXT, filing_date=T.DateType(), entity_ids=_TEXTS, text=_TEXT, embedding=T.ArrayType(T.FloatType()))
_TOP = _struct(chunk_id=_TEXT, doc_id=_TEXT, section=_TEXT, similarity=_DOUBLE)
_OUTCOME = _struct(vector=_struct(count=_LONG, top=_TOP), graph=_struct(query_type=_TEXT, resolved=_TEXTS, rows=_LONG, error=_TEXT))
DECISION_LOG = _struct(
    ts=T.TimestampType(), question=_TEXT, classified=_TEXT, confidence=_DOUBLE, low_confidence=T.BooleanType(), path_used=_TEXT, router_model=_TEXT, latency_ms=_DOUBLE, outcome=_OUTCOME
)
MANIFEST = _struct(hash=_TEXT, ticker=_TEXT, company=_TEXT, ingested_at=T.TimestampType())
ACCOUNTS = _struct(
    email=_TEXT, name=_TEXT, status=_TEXT, role=_TEXT, created_at=T.TimestampType(), decided_at=T.TimestampType(), decided_by=_TEXT, updates_opt_in=T.BooleanType(), consent_at=T.TimestampType()
)


def _field(name: str, kind: T.DataType, source: str | None = None, how: str | None = None) -> T.StructField:
    """A field of a response: the key that it comes from, if another, and how."""
    return T.StructField(name, kind, True, ({"from": source} if source else {}) | ({"as": how} if how else {}))


# The keys of a response are those that a web client reads.
_SOURCE = T.StructType([_field("tag", _TEXT), _field("kind", _TEXT, "tag", "kind"), _field("text", _TEXT), _field("cite", _TEXT)])
_PASSAGE = T.StructType([
    _field("tag", _TEXT, "label"), _field("chunk_id", _TEXT), _field("doc_id", _TEXT), _field("section", _TEXT, "section_path"),
    _field("filing_date", _TEXT, None, "text or nothing"), _field("similarity", _DOUBLE), _field("text", _TEXT, None, "900 characters"),
])
RESPONSE = T.StructType([
    _field("question", _TEXT), _field("path", _TEXT, "path_used", "first word"), _field("path_label", _TEXT, "path_used"), _field("classified", _TEXT),
    _field("confidence", _DOUBLE), _field("answer", _TEXT), _field("cited", _TEXTS, "answer", "labels"), _field("citations_valid", T.BooleanType()),
    _field("attempts", _LONG), _field("uncited_claims", _TEXTS), _field("sources", T.ArrayType(_SOURCE)), _field("graph", T.MapType(_TEXT, _TEXT)),
    _field("passages", T.ArrayType(_PASSAGE), "vector_hits"), _field("latency_s", _DOUBLE, "seconds", "hundredths"), _field("demo", T.BooleanType()),
])
# End of fixed values.

PLAN = _struct(query_type=_TEXT, entities=_TEXTS, value=_TEXT)


def allowed(spark: SparkSession) -> DataFrame:
    """The allowed shapes as a table of fixed size, fit for broadcasting."""
    return spark.createDataFrame([(*s, i) for i, s in enumerate(ALLOWED_SHAPES)], "s_type string, rel string, o_type string, ord int")


def end_types(spark: SparkSession) -> DataFrame:
    """(rel, s_type, o_type): each relation's first shape."""
    first: dict[str, tuple[str, str]] = {}
    for s, r, o in ALLOWED_SHAPES:
        first.setdefault(r, (s, o))
    return spark.createDataFrame([(r, s, o) for r, (s, o) in first.items()], "rel string, s_type string, o_type string")
