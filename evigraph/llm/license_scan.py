"""License scans by conditional compression.

Candidate blocks are runs of sentences that name a licence or consist of words of the
templates, with at least one naming word and few other words between them. A block is compressed alone and with each
template as a raw zstandard dictionary; templates are ranked by how much of the
block's size each saves. All are then held against the exact wording: the words of
block and template are aligned, the part of the alignment is taken that explains most
with fewest differences, and a template counts if at most MOST_MISSING of its words (one
at least) are missing there, none of them one that names the licence, and it fits better
than any other at that place. Left out are only templates of whose words, counted without
order, too few stand in the block for any alignment to confirm them. What is missing and
added is reported word for word.

Cases: a null or empty text has no block; equal savings go by template name; repeated
rows give repeated results; further columns are ignored; an empty table gives an
empty result; a block that no template explains is reported without one, with the
differences from the template that saves most; begin and end are the block's place then,
near_begin and near_end that of the words which that template fits best, whatever the
block's size. An identifier tag may hold an expression of several licences, and a sentence
may name several ("under the MIT License or the Apache License"): each is reported in a
row of its own. A very long text is scanned whole, sentence by sentence; of a block its words are held, and
blocks of any length are aligned alike, in steps.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.license_templates import TEMPLATES
from evigraph.llm.shared import prepare

#: The share of a template's words that may be missing, and the share of a block's words
#: that makes it a candidate.
MOST_MISSING, KNOWN_SHARE = 0.10, 0.75
#: Other words that a block may have between two parts of it.
MOST_APART = 8
#: A block is kept to so many words for each alignment; longer ones go in overlapping steps.
STEP = 2048
LEVEL = 3

_NAMING = re.compile(
    r"(?i)\b(?:licen[cs]e[ds]?|licen[cs]ing|copyright(?:ed)?|copyleft|warranty|warranties|redistribut\w+|permission|public domain|spdx|all rights"
    r"|cc[ -]by\b|cc0\b|creative commons|general public|public license|unencumbered software|boost software|waived all|free software|mpl|rights reserved)\b"
)
_WORD = re.compile(r"[a-z0-9]+(?:[.\-+][a-z0-9]+)*")
#: A tag that names a file's licences, and what an expression of them is made of.
_TAG_WORD = "SPDX-License-Identifier:"
_TAG = re.compile(re.escape(_TAG_WORD) + r"[ \t]*([^\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
#: Words in which a licence line's lead ends, at most.
_LEAD = 6
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?;:](?=\s)|$|(?=\n))", re.M)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words that name a licence, at their first place in a template; numbers do after these or the next words.
_NAMES = frozenset("mit isc bsd apache gnu general lesser affero mozilla boost eclipse cc creative commons unencumbered waived".split())
_BEFORE = frozenset("version v cc license".split())
#: Templates of fewer words are single lines, in which the word license counts too.
_LINE = 20


def words_of(text: str) -> list[str]:
    """Words with A-Z lower-cased; of a long text equal ones are one object."""
    if len(text) < 1 << 20:
        return _WORD.findall(text.translate(_LOWER))
    held: dict[str, str] = {}
    return [held.setdefault(m.group(), m.group()) for m in _WORD.finditer(text.translate(_LOWER))]


def decisive(words: list[str]) -> frozenset[int]:
    """Places of the words without which a template isn't confirmed."""
    if len(words) <= 3:
        return frozenset(range(len(words)))
    out, seen = set(), set()
    for k, w in enumerate(words):
        before = words[k - 1] if k else ""
        named = w in _NAMES or w.startswith(("by-", "attribution")) or (len(words) < _LINE and w == "license")
        numbered = (w[0].isdigit() or w[0] == "v" and w[1:2].isdigit()) and len(words) < _LINE and before == "license" or (w[0].isdigit() or w == "by") and (before in _BEFORE or before.startswith(("by", "attribution")))
        if (named and w not in seen) or numbered:
            out.add(k)
        seen.add(w)
    return frozenset(out)


def most_missing(template: list[str]) -> int:
    return max(len(template) > 3, int(MOST_MISSING * len(template)))


@cache
def _prepared() -> tuple[list[tuple[str, str, list[str], zstandard.ZstdCompressor]], zstandard.ZstdCompressor, frozenset[str]]:
    ready = []
    for name, licence, text in TEMPLATES:
        body = " ".join(words_of(text))
        raw = zstandard.ZstdCompressionDict(body.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        ready.append((name, licence, body.split(" "), zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)))
    plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    return ready, plain, frozenset(w for _, _, ws, _ in ready for w in ws)


@cache
def _decisive() -> list[frozenset[int]]:
    return [decisive(template) for _, _, template, _ in _prepared()[0]]


@cache
def _counted() -> list[list[tuple[str, int]]]:
    """Each template's words with their counts."""
    return [list(Counter(template).items()) for _, _, template, _ in _prepared()[0]]


def candidate_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Places of the candidate blocks of a text."""
    if not _NAMING.search(text):
        return
    _, _, known = _prepared()
    start = end = None
    named, apart = False, 0
    for m in _SENTENCE.finditer(text):
        part = m.group()
        ws = words_of(part)
        if not ws:
            continue
        naming = bool(_NAMING.search(part))
        # A few words begin no block, but go on with one: "met:" or "1.".
        if naming or ((len(ws) >= 3 or start is not None) and sum(w in known for w in ws) >= KNOWN_SHARE * len(ws)):
            start = m.start() if start is None else start
            end, named, apart = m.end(), named or naming, 0
        elif start is not None:
            apart += len(ws)
            if apart > MOST_APART:
                if named:
                    yield start, end
                start, named, apart = None, False, 0
    if named:
        yield start, end


def savings(words: list[str]) -> list[tuple[float, int]]:
    """(share of the compressed size saved, template), best first."""
    ready, plain, _ = _prepared()
    body = " ".join(words).encode()
    alone = len(plain.compress(body))
    out = [(1 - len(c.compress(body)) / alone, k) for k, (_, _, _, c) in enumerate(ready)]
    return sorted(out, key=lambda x: (-x[0], ready[x[1]][0]))


def _align(block: list[str], template: list[str]) -> tuple[int, int, list[int], list[str]]:
    """The template's place in the block (words), places of its missing words, and the words added there.

    Of all places that of least _differences, the first; words before and after it cost
    nothing.
    """
    # A missing word counts twice: as one that differs, and as one not explained.
    n, across = len(template), 2 * np.arange(len(template) + 1, dtype=np.int32)
    places: dict[str, list[int]] = {}
    for k, w in enumerate(template):
        places.setdefault(w, []).append(k)
    ends = {w: (np.array(at), np.array(at) + 1) for w, at in places.items()}
    # cost[i, j]: fewest differences between the first j words and any that end before word i.
    cost = np.empty((len(block) + 1, n + 1), np.int32)
    cost[0] = across
    for i, w in enumerate(block):
        row = cost[i] + 1
        row[0] = 0
        if w in ends:
            before, after = ends[w]
            row[after] = np.minimum(row[after], cost[i, before])
        cost[i + 1] = np.minimum.accumulate(row - across) + across
    i, j = int(np.argmin(cost[:, n])), n
    stop, missing, added = i, [], []
    while j:
        if cost[i, j] == cost[i, j - 1] + 2:  # of equal ways that with the last words missing
            j -= 1
            missing.append(j)
        elif i and block[i - 1] == template[j - 1] and cost[i, j] == cost[i - 1, j - 1]:
            i, j = i - 1, j - 1
        else:
            i -= 1
            added.append(block[i])
    return i, stop, missing[::-1], added[::-1]


def _steps(words: list[str]) -> range:
    """Where the overlapping steps of a block begin."""
    return range(0, max(1, len(words) - STEP // 2), STEP // 2)


def _differences(template: list[str], missing: list[int], added: list[str]) -> int:
    """Less is better: fewer differences for the words explained."""
    return len(missing) + len(added) - (len(template) - len(missing))


def nearest(words: list[str], template: list[str]) -> tuple[int, int, list[str], list[str]]:
    """As _align, for the step of a block that the template fits best; of equal ones the first."""
    steps = [(at, _align(words[at : at + STEP], template)) for at in _steps(words)]
    at, (a, b, missing, added) = min(steps, key=lambda s: _differences(template, *s[1][2:]))
    return at + a, at + b, [template[k] for k in missing], added


def _fits(words: list[str], ranked: list[tuple[float, int]]) -> list[dict]:
    """Confirmed templates that do not overlap, best first."""
    ready, _, _ = _prepared()
    tries = []
    steps = [(at, words[at : at + STEP]) for at in _steps(words)]
    held = [Counter(step) for _, step in steps]
    for gain, k in ranked:
        name, licence, template, _ = ready[k]
        for (at, step), has in zip(steps, held, strict=True):
            # No alignment finds more of the template's words than the step has of them.
            if sum(max(0, n - has[w]) for w, n in _counted()[k]) > most_missing(template):
                continue
            a, b, missing, added = _align(step, template)
            if len(missing) <= most_missing(template) and len(added) <= max(1, MOST_MISSING * len(template)) and not _decisive()[k].intersection(missing):
                lost = [template[m] for m in missing]
                tries.append((_differences(template, missing, added), name, {"template": name, "license": licence, "saved": gain, "from": at + a, "to": at + b, "missing": lost, "added": added}))
    found: list[dict] = []
    for _, _, f in sorted(tries, key=lambda t: t[:2]):
        if all(f["to"] <= g["from"] or f["from"] >= g["to"] for g in found):
            found.append(f)
    return found


def _lead(words: list[str]) -> list[str]:
    """The first words up to "under", which the further licences of an enumeration share."""
    return words[: words.index("under", 0, _LEAD) + 1] if "under" in words[:_LEAD] else []


def confirm(words: list[str], ranked: list[tuple[float, int]]) -> list[dict]:
    """All confirmed templates; what they leave of a block is ranked and aligned anew.

    What follows a licence with "or" or "and" is read as if the licence's lead stood there.
    """
    out, todo = [], [(0, 0, words, ranked)]
    while todo:
        base, first, part, order = todo.pop()
        found = _fits(part, order)
        out += [f | {"from": max(first, f["from"] + base), "to": f["to"] + base} for f in found]
        at = sorted(found, key=lambda f: f["from"])
        edges = [0, *(x for f in at for x in (f["from"], f["to"])), len(part)]
        for n, (a, b) in enumerate(zip(edges[::2], edges[1::2], strict=True)):
            if not found or b - a < 2:
                continue
            lead = _lead(part[at[n - 1]["from"] : at[n - 1]["to"]]) if n and part[a] in ("or", "and") else []
            rest = lead + part[a + 1 : b] if lead else part[a:b]
            todo.append((base + b - len(rest), base + a + bool(lead), rest, savings(rest)))
    return out


def identifiers(tag: str) -> list[tuple[str, int, int]]:
    """(identifier, begin, end) of the licences in what follows an identifier tag: names joined by AND, OR and WITH, in brackets."""
    out, wanted, last = [], True, 0
    for m in _TOKEN.finditer(tag):
        if tag[last : m.start()].strip():
            break  # a mark that is part of no expression ends it
        token, last = m.group(), m.end()
        if token in "()":
            continue
        if token.upper() in ("AND", "OR", "WITH") and not wanted:
            wanted = token.upper()
        elif wanted:
            if wanted != "WITH":  # an exception is no licence
                out.append((token.rstrip("+"), m.start(), m.end()))
            wanted = False
        else:
            break
    return out


def _spans(text: str, start: int, end: int, wanted: set[int]) -> dict[int, tuple[int, int]]:
    """Places in the text of some words of a block, by their number."""
    last, out = max(wanted, default=-1), {}
    for k, m in enumerate(_WORD.finditer(text[start:end].translate(_LOWER))):
        if k > last:
            break
        if k in wanted:
            out[k] = m.start() + start, m.end() + start
    return out


def scan_text(text: str) -> list[tuple]:
    """(begin, end, license, template, saved, confirmed, missing, added, near_begin, near_end) of a text's blocks."""
    ready, _, _ = _prepared()
    out = []
    for start, end in candidate_blocks(text):
        ws = words_of(text[start:end])
        ranked = savings(ws)
        found = confirm(ws, ranked)
        spans = _spans(text, start, end, {k for f in found for k in (f["from"], f["to"] - 1)})
        taken = []
        for f in found:
            begin, stop = spans[f["from"]][0], spans[f["to"] - 1][1]
            taken.append((begin, stop))
            out.append((begin, stop, f["license"], f["template"], round(f["saved"], 6), True, f["missing"], f["added"], begin, stop))
        for m in _TAG.finditer(text, start):
            if m.start() >= end:
                break
            for name, a, b in identifiers(m.group(1)):
                begin, stop = m.start(1) + a, m.start(1) + b
                if any(begin < e and stop > s for s, e in taken):
                    continue
                own = words_of(f"{_TAG_WORD} {name}")  # held against the templates like a tag of its own
                for f in confirm(own, savings(own))[:1]:
                    taken.append((begin, stop))
                    out.append((begin, stop, f["license"], f["template"], round(f["saved"], 6), True, f["missing"], f["added"], begin, stop))
        if not taken:
            gain, k = ranked[0]
            a, b, missing, added = nearest(ws, ready[k][2])
            spans = _spans(text, start, end, {a, b - 1})
            near = (spans[a][0], spans[b - 1][1]) if a < b else (None, None)
            out.append((start, end, None, ready[k][0], round(gain, 6), False, missing, added, *near))
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each match of a template, or unexplained block, of every text."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "begin", "end", "license", "template", "saved", "confirmed", "missing_words", "added_words", "near_begin", "near_end"]
    strings = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for k, text in enumerate(batch.column(1)):
                for row in scan_text(text.as_py() or ""):
                    ids.append(k)
                    rows.append(row)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 10
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_(), strings, strings, pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *arrays], names)

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, begin long, end long, license string, template string, saved double, confirmed boolean, missing_words array<string>, added_words array<string>, near_begin long, near_end long")
