"""Quality rules by repetition coverage.

Words are hashed once; runs of 5 to 10 words are hashed by rolling one word at a
time, and the characters of words inside runs that occur twice or more are measured
by coverage (no character counts twice), as are those in repeated lines. Of the runs
that are equal, the first is the original and isn't counted. A run of n + 1 words can
only be repeated where its first n words are, so longer lengths look only at the
places that the length before has left.

Cases: a null or empty text has no words and fails the base rule; ties do not
arise; repeated rows give repeated results; any further columns are ignored by
``score`` and kept by ``keep``; an empty table gives an empty result; a very long text
is measured whole, with some 50 bytes held a word and a line. Lines are looked for by
64-bit hashes, and those that seem to be repeated compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import bytetext as B
from evigraph.llm.shared import map_batches, prepare

#: Most per cent of word characters inside repeats of runs of so many words.
MOST_IN_RUNS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Most per cent of word characters in lines equal to an earlier one.
MOST_IN_LINES = 20
#: The base rule: fewest words, and most per cent of words in repeated 3-word windows.
FEWEST_WORDS, MOST_REPEATED = 50, 50

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_IN_LINE = np.arange(256) != 0x0A
#: Bytes that begin a code point of a word.
_WORD_LEAD = B.LEAD & B.SOLID

COLUMNS = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("base_failed", "boolean"), ("kept", "boolean"), ("dup_line_chars", "long"), *((f"dup_chars_{n}", "long") for n in MOST_IN_RUNS),
]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of entries that occur twice or more, which of them equal an earlier one)."""
    ranked = np.sort(keys)
    again = ranked[1:][ranked[1:] == ranked[:-1]]
    del ranked
    if not len(again):
        return np.empty(0, np.int64), np.empty(0, bool)
    again = again[np.concatenate([[True], again[1:] != again[:-1]])]
    hit = np.empty(len(keys), bool)
    for at in range(0, len(keys), B.PIECE):
        some = keys[at : at + B.PIECE]
        hit[at : at + B.PIECE] = again[np.minimum(np.searchsorted(again, some), len(again) - 1)] == some
    places = np.flatnonzero(hit)
    order = np.argsort(keys[places], kind="stable")
    ranked = keys[places][order]
    later = np.zeros(len(places), bool)
    later[order[1:][ranked[1:] == ranked[:-1]]] = True
    return places, later


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a run of n words beginning at one of starts."""
    steps = np.zeros(total + 1, np.int32)
    steps[starts] += 1  # starts are distinct
    steps[starts + n] -= 1
    return np.cumsum(steps[:-1], dtype=np.int32) > 0


def _repeated_lines(data: np.ndarray) -> tuple[int, int]:
    """(lines with a word that equal an earlier one, characters of their words)."""
    starts, ends = B.spans(data, _IN_LINE)
    chars = B.span_counts(data, starts, ends, _WORD_LEAD)
    starts, ends, chars = starts[chars > 0], ends[chars > 0], chars[chars > 0]
    seen: set[bytes] = set()
    n = n_chars = 0
    for k in _repeated(B.span_hashes(data, starts, ends, False))[0].tolist():
        line = data[starts[k] : ends[k]].tobytes()
        if line in seen:
            n += 1
            n_chars += int(chars[k])
        else:
            seen.add(line)
    return n, n_chars


def measure(doc: B.Words) -> tuple:
    """The values of COLUMNS for one text."""
    n = len(doc.hashes)
    chars = B.span_counts(doc.data, doc.starts, doc.ends, B.LEAD)
    word_chars = int(chars.sum(dtype=np.int64))
    symbols = B.marked(doc.data, _SYMBOLS)
    dup_lines, dup_line_chars = _repeated_lines(doc.data)

    threes = B.grams(doc.hashes, 3)
    places = _repeated(threes)[0]
    repeat_words = int(np.count_nonzero(_covered(places, 3, n))) if len(places) else 0

    run_chars, length, keys, later = [], 3, threes[places], places
    del threes
    for size in MOST_IN_RUNS:
        while length < size and len(places):  # roll on by one word
            fits = places + length < n
            places, keys = places[fits], keys[fits]
            keys = B.mix(keys * B.U64(0x9E3779B97F4A7C15) + doc.hashes[places + length])
            length += 1
            again, copies = _repeated(keys)
            places, keys = places[again], keys[again]
            later = places[copies]
        run_chars.append(int(chars[_covered(later, size, n)].sum(dtype=np.int64)) if len(places) else 0)

    base_failed = n < FEWEST_WORDS or 100 * repeat_words > MOST_REPEATED * n
    kept = not (
        base_failed
        or 100 * dup_line_chars > MOST_IN_LINES * word_chars
        or any(100 * c > most * word_chars for c, most in zip(run_chars, MOST_IN_RUNS.values(), strict=True))
    )
    return (n, word_chars, symbols, dup_lines, repeat_words, base_failed, kept, dup_line_chars, *run_chars)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the columns of COLUMNS for every row."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = {"long": pa.int64(), "boolean": pa.bool_()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(w) for w in B.words(batch.column(1))]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(COLUMNS)
        arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(cols, COLUMNS, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *(c for c, _ in COLUMNS)])

    kind = src.schema["doc_id"].dataType.simpleString()
    return map_batches(src, run, f"doc_id {kind}, " + ", ".join(f"{c} {k}" for c, k in COLUMNS))


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns; no shuffle."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([bool(measure(w)[6]) for w in B.words(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(lambda it: (run(b) for b in it), docs.schema)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM d),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
l2 AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lines AS (
  SELECT doc_id, count(*)::BIGINT AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS dup_line_chars
  FROM l2 WHERE nth > 1 GROUP BY doc_id),
ld AS (SELECT doc_id, pos, word, lead(word, 1) OVER d AS l1, lead(word, 2) OVER d AS l2, lead(word, 3) OVER d AS l3, lead(word, 4) OVER d AS l4, lead(word, 5) OVER d AS l5, lead(word, 6) OVER d AS l6, lead(word, 7) OVER d AS l7, lead(word, 8) OVER d AS l8, lead(word, 9) OVER d AS l9 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
g AS (
  SELECT doc_id, 3 AS n, pos AS p, word || ' ' || l1 || ' ' || l2 AS k FROM ld WHERE l2 IS NOT NULL UNION ALL
  SELECT doc_id, 5 AS n, pos AS p, word || ' ' || l1 || ' ' || l2 || ' ' || l3 || ' ' || l4 AS k FROM ld WHERE l4 IS NOT NULL UNION ALL
  SELECT doc_id, 6 AS n, pos AS p, word || ' ' || l1 || ' ' || l2 || ' ' || l3 || ' ' || l4 || ' ' || l5 AS k FROM ld WHERE l5 IS NOT NULL UNION ALL
  SELECT doc_id, 7 AS n, pos AS p, word || ' ' || l1 || ' ' || l2 || ' ' || l3 || ' ' || l4 || ' ' || l5 || ' ' || l6 AS k FROM ld WHERE l6 IS NOT NULL UNION ALL
  SELECT doc_id, 8 AS n, pos AS p, word || ' ' || l1 || ' ' || l2 || ' ' || l3 || ' ' || l4 || ' ' || l5 || ' ' || l6 || ' ' || l7 AS k FROM ld WHERE l7 IS NOT NULL UNION ALL
  SELECT doc_id, 9 AS n, pos AS p, word || ' ' || l1 || ' ' || l2 || ' ' || l3 || ' ' || l4 || ' ' || l5 || ' ' || l6 || ' ' || l7 || ' ' || l8 AS k FROM ld WHERE l8 IS NOT NULL UNION ALL
  SELECT doc_id, 10 AS n, pos AS p, word || ' ' || l1 || ' ' || l2 || ' ' || l3 || ' ' || l4 || ' ' || l5 || ' ' || l6 || ' ' || l7 || ' ' || l8 || ' ' || l9 AS k FROM ld WHERE l9 IS NOT NULL),
r AS (
  SELECT doc_id, n, p FROM g
  QUALIFY count(*) OVER (PARTITION BY doc_id, n, k) > 1 AND (n = 3 OR row_number() OVER (PARTITION BY doc_id, n, k ORDER BY p) > 1)),
c AS (SELECT DISTINCT doc_id, n, unnest(range(p, p + n)) AS pos FROM r),
cover AS (
  SELECT c.doc_id, n, count(*) AS words, sum(length(word)) AS chars FROM c JOIN w ON c.doc_id = w.doc_id AND c.pos = w.pos GROUP BY ALL),
wide AS (
  SELECT doc_id, coalesce(max(words) FILTER (n = 3), 0)::BIGINT AS n_repeat_words,
         coalesce(max(chars) FILTER (n = 5), 0)::BIGINT AS dup_chars_5, coalesce(max(chars) FILTER (n = 6), 0)::BIGINT AS dup_chars_6,
         coalesce(max(chars) FILTER (n = 7), 0)::BIGINT AS dup_chars_7, coalesce(max(chars) FILTER (n = 8), 0)::BIGINT AS dup_chars_8,
         coalesce(max(chars) FILTER (n = 9), 0)::BIGINT AS dup_chars_9, coalesce(max(chars) FILTER (n = 10), 0)::BIGINT AS dup_chars_10
  FROM cover GROUP BY doc_id),
j AS (
  SELECT base.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
         coalesce(dup_chars_5, 0) AS dup_chars_5, coalesce(dup_chars_6, 0) AS dup_chars_6, coalesce(dup_chars_7, 0) AS dup_chars_7,
         coalesce(dup_chars_8, 0) AS dup_chars_8, coalesce(dup_chars_9, 0) AS dup_chars_9, coalesce(dup_chars_10, 0) AS dup_chars_10
  FROM base LEFT JOIN lines USING (doc_id) LEFT JOIN wide USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * dup_line_chars > 20 * word_chars OR 100 * dup_chars_5 > 15 * word_chars OR 100 * dup_chars_6 > 14 * word_chars
            OR 100 * dup_chars_7 > 13 * word_chars OR 100 * dup_chars_8 > 12 * word_chars OR 100 * dup_chars_9 > 11 * word_chars
            OR 100 * dup_chars_10 > 10 * word_chars) AS kept,
       dup_line_chars, dup_chars_5, dup_chars_6, dup_chars_7, dup_chars_8, dup_chars_9, dup_chars_10
FROM b
"""
