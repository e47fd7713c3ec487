"""Model-dependent steps as interfaces, with deterministic defaults.

Each provider is a plain object whose method works on lists, so the engine calls it on
the driver for one question and inside Arrow batches for tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np

from evigraph.operators import replies
from evigraph.operators.routing import GRAPH, GRAPH_RULE, HYBRID, VECTOR, VECTOR_RULE


class Extractor(Protocol):
    def triples(self, text: str) -> list[tuple[str, str, str, str, str]]:
        """(subject type, subject, relation, object type, object) stated in a text."""


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class Classifier(Protocol):
    def classify(self, question: str) -> tuple[str, float] | None:
        """(path, confidence), or None if the model failed."""


class Planner(Protocol):
    def plan(self, question: str) -> dict:
        """{query_type, entities, value}."""


class Generator(Protocol):
    def __call__(self, question: str, sources: list[dict], fault: str | None) -> str: ...


class HashEmbedder:
    """Signed hashed words and character trigrams, of length 1."""

    def __init__(self, dimensions: int = 256):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            low = (text or "").lower()
            for term in re.findall(r"\w+", low) + [low[i : i + 3] for i in range(len(low) - 2)]:
                h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
                row[h % self.dimensions] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)


class RuleClassifier:
    """The rules alone, sure where they apply."""

    def classify(self, question: str) -> tuple[str, float]:
        if re.search(GRAPH_RULE, question):
            return GRAPH, 0.9
        return (VECTOR, 0.9) if re.search(VECTOR_RULE, question) else (HYBRID, 0.0)


class ReplyClassifier:
    """A model's classification, read from its JSON reply; None if the model or its reply fails."""

    def __init__(self, complete: Callable[[str], str]):
        self.complete = complete

    def classify(self, question: str) -> tuple[str, float] | None:
        try:
            said = replies.object_in(self.complete(question))
            path, conf = str(said["path"]).strip().upper(), float(said.get("confidence", replies.UNSURE))
        except Exception:  # whatever a model raises: the rules decide
            return None
        return (path, conf) if path in replies.PATHS else None


class ReplyPlanner:
    """A model's plan, read from its JSON reply; ValueError if it has none."""

    def __init__(self, complete: Callable[[str], str]):
        self.complete = complete

    def plan(self, question: str) -> dict:
        said = replies.object_in(self.complete(question))
        entities = said.get("entities")
        entities = entities if isinstance(entities, list) else [entities]
        return {"query_type": str(said.get("query_type") or ""), "entities": [str(e) for e in entities if e], "value": str(said.get("value") or "")}


class PatternExtractor:
    """Statements of the form 'X <phrase> Y', by a phrase for each relation.

    A subject ending in the word Segment is one where a shape has segments as subjects.
    """

    def __init__(self, shapes: Sequence[tuple[str, str, str]], phrases: dict[str, str]):
        name = r"[A-Z][\w&-]*(?: [A-Z][\w&-]*)*"
        self.kinds = {(s, rel, o) for s, rel, o in shapes}
        pairs = {(rel, o) for _, rel, o in shapes}
        self.rules = [(rel, o, re.compile(rf"({name}) {re.escape(phrases[rel])} ({name})")) for rel, o in sorted(pairs)]

    def triples(self, text: str) -> list[tuple[str, str, str, str, str]]:
        out = []
        for rel, o, rule in self.rules:
            for m in rule.finditer(text or ""):
                segment = m[1].endswith("Segment") and ("SEGMENT", rel, o) in self.kinds
                out.append(("SEGMENT" if segment else "COMPANY", m[1], rel, o, m[2]))
        return out


class PatternPlanner:
    """A query type by its words, entities by capitalised names and the names given."""

    RULES = (
        ("compare_subsidiary_counts", r"(?i)\bcompare\b|\bmore subsidiaries\b|\bfewer subsidiaries\b"),
        ("count_subsidiaries", r"(?i)how many subsidiaries"),
        ("path_between", r"(?i)how is .+ connected to|path from|relationship between"),
        ("companies_facing_risk", r"(?i)(?:which|how many) companies face"),
        ("subsidiaries_of", r"(?i)subsidiar"),
        ("executives_of", r"(?i)executive"),
        ("competitors_of", r"(?i)compet"),
        ("regulators_of", r"(?i)regulat"),
        ("risks_of", r"(?i)\brisks?\b"),
        ("neighbors", r"(?i)connected|related|linked"),
    )
    _NAME = re.compile(r"\b[A-Z][\w&#.-]*(?: [A-Z][\w&#.-]*)*")
    _NOISE = {"how", "what", "which", "who", "compare", "where", "is", "are", "does", "do", "list", "the"}

    def plan(self, question: str) -> dict:
        kind = next((k for k, rule in self.RULES if re.search(rule, question)), "")
        named = []
        for run in self._NAME.findall(question):
            words = [w for w in re.sub(r"'s$", "", run).rstrip(".?").split(" ") if w.lower() not in self._NOISE]
            if words:
                named.append(" ".join(words))
        value = ""
        if kind == "companies_facing_risk":
            m = re.search(r"(?i)face (?:the )?(.*?)(?: risks?)?[?.]?$", question)
            value = m[1].strip() if m else ""
        return {"query_type": kind, "entities": named, "value": value}


class ExtractiveGenerator:
    """Every statement, and the first sentence of every passage, each with its label."""

    def __call__(self, question: str, sources: list[dict], fault: str | None = None) -> str:
        out = []
        for s in sources:
            text = s["text"] if s["tag"].startswith("G") else re.split(r"(?<=[.!?])\s", s["text"])[0]
            out.append(f"{text.rstrip('.!?').replace('. ', ', ')} [{s['tag']}].")
        return "\n".join(out)
