"""Estimates of tokens, chunks, cost and time, and model prices."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.functions.text import ColumnLike, col

# Characters a token, tokens a chunk after overlap, prompt and reply tokens a chunk, seconds a chunk.
CHARS_PER_TOKEN, CHUNK_STRIDE, PROMPT_TOKENS, REPLY_TOKENS, SECONDS_PER_CHUNK = 4, 448, 600, 300, 20.0
# End of fixed values.


def estimate(text: ColumnLike, price_in: float = 0.0, price_out: float = 0.0, seconds: float = SECONDS_PER_CHUNK) -> dict[str, Column]:
    """Columns tokens, chunks, in_tokens, out_tokens, cost and seconds."""
    tokens = F.ceil(F.length(F.coalesce(col(text), F.lit(""))) / F.lit(CHARS_PER_TOKEN)).cast("long")
    chunks = F.greatest(F.lit(1), F.ceil(tokens / F.lit(CHUNK_STRIDE))).cast("long")
    tokens_in, tokens_out = tokens + PROMPT_TOKENS * chunks, REPLY_TOKENS * chunks
    cost = tokens_in / F.lit(1e6) * F.lit(price_in) + tokens_out / F.lit(1e6) * F.lit(price_out)
    return {"tokens": tokens, "chunks": chunks, "in_tokens": tokens_in, "out_tokens": tokens_out, "cost": cost, "seconds": chunks * F.lit(seconds)}


def load_prices(path: str) -> dict[str, tuple[float, float]]:
    """Price presets of a JSON file {model key: [input, output]}, in the file's order."""
    with open(path, encoding="utf-8") as f:
        return {k: (float(a), float(b)) for k, (a, b) in json.load(f).items()}


def resolve_prices(model: str | None, presets: Mapping[str, tuple[float, float]], override: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float]:
    """USD a million tokens: the override, else the first preset whose key is in the model's name, else free."""
    if any(override):
        return override
    name = (model or "").lower()
    return next((p for key, p in presets.items() if key in name), (0.0, 0.0))


def is_free(model: str | None, presets: Mapping[str, tuple[float, float]], override: tuple[float, float] = (0.0, 0.0)) -> bool:
    return resolve_prices(model, presets, override) == (0.0, 0.0)


def prices(model: ColumnLike, presets: Mapping[str, tuple[float, float]]) -> Column:
    """Struct (price_in, price_out) of each model name, as resolve_prices has it."""
    name, out = F.lower(F.coalesce(col(model), F.lit(""))), None
    pair = lambda p: F.struct(F.lit(float(p[0])).alias("price_in"), F.lit(float(p[1])).alias("price_out"))
    for key, p in presets.items():
        out = F.when(name.contains(key), pair(p)) if out is None else out.when(name.contains(key), pair(p))
    return pair((0, 0)) if out is None else out.otherwise(pair((0, 0)))
