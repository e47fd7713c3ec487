"""Words of UTF-8 texts as NumPy arrays.

An Arrow string column is one run of bytes with offsets. All work here is done on
pieces of that run: word boundaries by a table look-up, word hashes as differences
of one running polynomial sum modulo 2**64. What is held of a text beside its bytes
is 16 bytes a word (hash, start and end), however long texts and words are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 18

_bytes = np.arange(256)
#: White space of the contracts: 0x20 and 0x09 to 0x0D.
SPACE = (_bytes == 0x20) | ((_bytes >= 9) & (_bytes <= 13))
#: Words of [^\x20\x09-\x0D]+.
SOLID = ~SPACE
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
ALNUM = (
    ((_bytes >= 0x30) & (_bytes <= 0x39))
    | ((_bytes >= 0x41) & (_bytes <= 0x5A))
    | ((_bytes >= 0x61) & (_bytes <= 0x7A))
    | (_bytes >= 0x80)
)
#: Bytes that begin a code point.
LEAD = (_bytes & 0xC0) != 0x80
FOLD = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 0x20, _bytes).astype(np.uint8)

_draw = np.random.Generator(np.random.PCG64(20240607))
_KEYS = _draw.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * U64(2) + U64(1)
_BASES = [int(x) * 2 + 1 for x in _draw.integers(1 << 61, 1 << 62, size=2)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, for places within two pieces."""
    if which not in _powers:
        tables = []
        for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            t = np.full(2 * PIECE + 1, b, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[which] = tables[0], tables[1]
    return _powers[which]


def _within(places: np.ndarray, at: int, piece: int) -> np.ndarray:
    """Where the places of a piece begin and end; in their own type, or all would be converted for it."""
    return np.searchsorted(places, np.array([at, min(at + piece, np.iinfo(places.dtype).max)], places.dtype))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool, which: int = 0, piece: int = PIECE) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; ``which`` picks one of two independent ones.

    Spans come in order and don't overlap. A long text is summed up piece by piece, so
    what is held beside the spans doesn't grow with it, however long a span is.
    """
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    keys = _KEYS[which][FOLD] if fold else _KEYS[which]
    power, inverse = _power_tables(which)
    if len(data) <= 2 * piece:
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        terms = keys[data]
        terms *= power[: len(data)]
        np.cumsum(terms, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts])
    base, back = _BASES[which], pow(_BASES[which], -1, 1 << 64)
    out, scale = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    upto = U64(0)
    for at in range(0, len(data) + 1, piece):
        part = data[at : at + piece]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(keys[part] * power[: len(part)], out=sums[1:])
        sums *= U64(pow(base, at, 1 << 64))
        sums += upto
        a, b = _within(starts, at, piece)
        out[a:b] = sums[starts[a:b] - at]
        scale[a:b] = inverse[starts[a:b] - at] * U64(pow(back, at, 1 << 64))
        a, b = _within(ends, at, piece)
        # A span's start lies in this piece or an earlier one, so its sum is known.
        out[a:b] = sums[ends[a:b] - at] - out[a:b]
        upto = sums[-1]
    out *= scale
    return mix(out)


def span_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """How many bytes of each data[start:end] the table marks; spans in order, without overlap."""
    out = np.zeros(len(starts), np.int32)
    upto = 0
    for at in range(0, len(data) + 1, piece):
        part = data[at : at + piece]
        sums = np.zeros(len(part) + 1, np.int32)
        np.cumsum(table[part], out=sums[1:], dtype=np.int32)
        sums += np.int32(upto)
        a, b = _within(starts, at, piece)
        out[a:b] -= sums[starts[a:b] - at]
        a, b = _within(ends, at, piece)
        out[a:b] += sums[ends[a:b] - at]
        upto = int(sums[-1])
    return out


def marked(data: np.ndarray, table: np.ndarray) -> int:
    """How many bytes the table marks, piece by piece."""
    return sum(int(np.count_nonzero(table[data[at : at + PIECE]])) for at in range(0, len(data), PIECE))


def _boundaries(data: np.ndarray, word: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; first and last are the bytes where texts begin and end."""
    inside = word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[last] = False
    return starts, np.flatnonzero(inside & ~after) + 1


class Words(NamedTuple):
    """The words of one text: its row, bytes, and per word the hash and the place."""

    row: int
    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, at


def spans(data: np.ndarray, table: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that the table marks, found piece by piece."""
    starts, ends, before = [], [], False
    for at in range(0, len(data), piece):
        inside = table[data[at : at + piece]]
        turn = np.empty(len(inside), bool)
        turn[0] = inside[0] != before
        np.not_equal(inside[1:], inside[:-1], out=turn[1:])
        place = np.flatnonzero(turn)
        begins = inside[place]
        place = (place + at).astype(np.int32)
        starts.append(place[begins])
        ends.append(place[~begins])
        before = inside[-1]
    if before:
        ends.append(np.array([len(data)], np.int32))
    none = np.empty(0, np.int32)
    return np.concatenate(starts or [none]), np.concatenate(ends or [none])


def words(column: pa.Array, word: np.ndarray = SOLID, fold: bool = False, piece: int = PIECE) -> Iterator[Words]:
    """The words of every text, row by row."""
    raw, at = buffers(column)
    n, row = len(at) - 1, 0
    none64, none = np.empty(0, np.uint64), np.empty(0, np.int64)
    while row < n:
        if at[row + 1] - at[row] > 2 * piece:
            data = raw[at[row] : at[row + 1]]
            s, e = spans(data, word, piece)
            yield Words(row, data, span_hashes(data, s, e, fold, piece=piece), s, e)
            row += 1
            continue
        stop = max(row + 1, int(np.searchsorted(at, at[row] + piece, "right")) - 1)
        base, data = at[row], raw[at[row] : at[stop]]
        if len(data) == 0:
            for k in range(row, stop):
                yield Words(k, data, none64, none, none)
            row = stop
            continue
        own = at[row : stop + 1] - base
        full = np.flatnonzero(own[1:] > own[:-1])
        s, e = _boundaries(data, word, own[full], own[full + 1] - 1)
        h = span_hashes(data, s, e, fold)
        cuts = np.searchsorted(s, own)
        for k in range(stop - row):
            a, b, o = cuts[k], cuts[k + 1], own[k]
            yield Words(row + k, data[o : own[k + 1]], h[a:b], s[a:b] - o, e[a:b] - o)
        row = stop


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, worked out some at a time."""
    m = max(len(hashes) - n + 1, 0)
    out = np.empty(m, np.uint64)
    for at in range(0, m, PIECE):
        x = hashes[at : min(at + PIECE, m)].copy()
        for k in range(1, n):
            x = mix(x * U64(0x9E3779B97F4A7C15) + hashes[at + k : at + k + len(x)])
        out[at : at + len(x)] = x
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's signed 64-bit values."""
    return np.ascontiguousarray(x).view(np.int64)
