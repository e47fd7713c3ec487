"""Token ids in directly addressable codes.

An id is cut into chunks, lowest first, one level for each chunk width. A level holds
the chunks of the ids that reach it, a bitmap telling which of them go on, and a rank
directory, the bits set before each block of 512. The chunk of an id at the next
level is at the rank of its bit, so any token is read by one look-up a level: no
block is decoded.

A container is one file of whole documents in ascending doc_id order:

    magic b"EVDAC2\\0\\0", u64 n_tokens, u64 n_docs, u64 n_levels, u64 shard, u64 part,
    u64 first byte of the levels, then for each of MOST_LEVELS levels u64 width in bits
    and u64 n_chunks (0 for levels that aren't there); i64 doc_id[n_docs];
    u64 first_token[n_docs + 1]; then for each level the chunks (width bits, padded to 8
    bytes), the bitmap (u64 words, low bit first) and the directory (u64 for each block
    of 512 bits). All values are little-endian. One line break ends the file.

The head tells where everything is, so a token at a place is read by ranges of a few
bytes: the head, and for each level its chunk, its block's bitmap and rank. Files are
neither compressed nor wrapped, and Spark's writer for lines of text commits them on any
store, a container a file; those of a lost executor are written again. Beside them a
small table (file, shard, part, first, n_tokens, n_docs) names the container of a place.
A container ends with the batch of documents that takes it to PART_TOKENS or more.

Cases: a null or empty text has the end id only; ties and repeated rows of a doc_id
keep the order of their texts; rows without doc_id, or with a text that is no whole
number, come first; further columns are ignored; an empty table gives a table without
containers. A very long text is encoded in pieces cut at white space, and what is held
is its ids; a single word is not cut.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import bytetext as B
from evigraph.llm.shared import cut, fresh_path, map_batches, prepare
from evigraph.llm.source_mix import sums_before

MAGIC = b"EVDAC2\0\0"
WIDTHS = (8, 8, 16)
END_ID = 2
#: Tokens in a container, about: 5 MB. Where files should be larger, give more.
PART_TOKENS = 1 << 21
MOST_LEVELS = 4
#: Bytes of the head.
HEAD = 8 * (7 + 2 * MOST_LEVELS)
#: Bytes of a text that are encoded at once, about.
LONG = 1 << 20
_BLOCK = 512
_NO_ID = -(1 << 63)
_BLANK = re.compile(rb"[ \t-\r]")


def _padded(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return raw + bytes(-len(raw) % 8)


def encode(ids: np.ndarray, doc_ids: Sequence[int], firsts: np.ndarray, widths: Sequence[int] = WIDTHS, shard: int = 0, part: int = 0) -> bytes:
    """A container of ids below 2**sum(widths); firsts has a last entry, len(ids)."""
    left = np.asarray(ids, np.uint32)
    shape, body = [], []
    for k, width in enumerate(widths):
        chunk = (left & np.uint32((1 << width) - 1)).astype(f"<u{width // 8}")
        more = (left >> np.uint32(width)) > 0 if k + 1 < len(widths) else np.zeros(len(left), bool)
        bits = np.zeros(-(-len(left) // _BLOCK) * _BLOCK, bool)
        bits[: len(left)] = more
        words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.bitwise_count(words.reshape(-1, _BLOCK // 64)).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8") if len(ones) else np.empty(0, "<u8")
        shape += [width, len(chunk)]
        body += [_padded(chunk), words.tobytes(), ranks.tobytes()]
        left = left[more] >> np.uint32(width)
    shape += [0] * (2 * MOST_LEVELS - len(shape))
    levels_at = HEAD + 8 * (2 * len(doc_ids) + 1)
    head = [len(ids), len(doc_ids), len(widths), shard, part, levels_at, *shape]
    return b"".join([MAGIC, np.array(head, "<u8").tobytes(), np.asarray(doc_ids, "<i8").tobytes(), np.asarray(firsts, "<u8").tobytes(), *body])


class Layout:
    """What the head of a container says: its numbers, and where the parts of each level begin."""

    def __init__(self, head: bytes | memoryview):
        if len(head) < HEAD or bytes(head[:8]) != MAGIC:
            raise ValueError("not a container of directly addressable codes")
        self.n_tokens, self.n_docs, n_levels, self.shard, self.part, at, *shape = (int(x) for x in np.frombuffer(head, "<u8", HEAD // 8 - 1, 8))
        self.levels = []
        for width, n in zip(shape[: 2 * n_levels : 2], shape[1 : 2 * n_levels : 2], strict=True):
            blocks = -(-n // _BLOCK)
            bitmap = at + -(-n * width // 64) * 8
            ranks = bitmap + blocks * _BLOCK // 8
            self.levels.append((width, n, at, bitmap, ranks))
            at = ranks + 8 * blocks


def token_at(fetch: Callable[[int, int], bytes], layout: Layout, place: int) -> int:
    """The id at a place of a container, by ranges: fetch(at, n) gives n of its bytes."""
    if not 0 <= place < layout.n_tokens:
        raise IndexError(place)
    out = shift = 0
    for width, _, chunks, bitmap, ranks in layout.levels:
        size = width // 8
        out |= int.from_bytes(fetch(chunks + size * place, size), "little") << shift
        block, bit = divmod(place, _BLOCK)
        bits = int.from_bytes(fetch(bitmap + block * (_BLOCK // 8), _BLOCK // 8), "little")
        if not bits >> bit & 1:
            break
        place = int.from_bytes(fetch(ranks + 8 * block, 8), "little") + (bits & ((1 << bit) - 1)).bit_count()
        shift += width
    return out


class Reader:
    """Random access to a container in memory."""

    def __init__(self, raw: bytes | memoryview):
        layout = Layout(raw)
        self.n_tokens, n_docs = layout.n_tokens, layout.n_docs
        self.shard, self.part = layout.shard, layout.part
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, HEAD)
        self.firsts = np.frombuffer(raw, "<u8", n_docs + 1, HEAD + 8 * n_docs).astype(np.int64)
        self.levels = []
        for width, n, chunks, bitmap, ranks in layout.levels:
            blocks = -(-n // _BLOCK)
            words = np.frombuffer(raw, "<u8", blocks * _BLOCK // 64, bitmap)
            self.levels.append((width, np.frombuffer(raw, f"<u{width // 8}", n, chunks), words, np.frombuffer(raw, "<u8", blocks, ranks)))

    def tokens(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in any order."""
        places = np.asarray(places, np.int64)
        out = np.zeros(len(places), np.uint32)
        live, shift = np.arange(len(places)), 0
        for width, chunk, words, ranks in self.levels:
            out[live] |= chunk[places].astype(np.uint32) << np.uint32(shift)
            word, bit = places >> 6, (places & 63).astype(np.uint64)
            more = np.flatnonzero((words[word] >> bit) & B.U64(1)) if len(places) else places
            if not len(more):
                break
            places, live, word, bit = places[more], live[more], word[more], bit[more]
            rank = ranks[places // _BLOCK].astype(np.int64)
            first = places // _BLOCK * (_BLOCK // 64)
            for k in range(_BLOCK // 64):  # whole words of the block before the bit's
                before = first + k < word
                rank += np.where(before, np.bitwise_count(words[np.minimum(first + k, len(words) - 1)]), 0)
            rank += np.bitwise_count(words[word] & ((B.U64(1) << bit) - B.U64(1)))
            places, shift = rank, shift + width
        return out

    def token(self, place: int) -> int:
        return int(self.tokens(np.array([place]))[0])

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document: its places are a run at every level."""
        return self.run(int(self.firsts[k]), int(self.firsts[k + 1]))

    def _rank(self, level: int, place: int) -> int:
        _, _, words, ranks = self.levels[level]
        if place == 0:
            return 0
        last = place - 1
        block = last // _BLOCK
        rank = int(ranks[block]) + int(np.bitwise_count(words[block * (_BLOCK // 64) : last >> 6]).sum())
        return rank + int(np.bitwise_count(words[last >> 6] & B.U64((2 << (last & 63)) - 1 & 0xFFFFFFFFFFFFFFFF)))

    def run(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b."""
        out = np.zeros(b - a, np.uint32)
        live: np.ndarray | slice = slice(None)
        shift = 0
        for level, (width, chunk, words, _) in enumerate(self.levels):
            out[live] |= chunk[a:b].astype(np.uint32) << np.uint32(shift)
            bits = np.unpackbits(words[a >> 6 : -(-b // 64)].view(np.uint8), bitorder="little")
            more = np.flatnonzero(bits[a - (a >> 6 << 6) :][: b - a])
            if not len(more):
                break
            live = more if isinstance(live, slice) else live[more]
            a, b, shift = self._rank(level, a), self._rank(level, a) + len(more), shift + width
        return out


class _Vocabulary:
    """Numbers of distinct 64-bit hashes, in the order in which they came: a table of slots, probed one after the other."""

    _MUL = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, most: int):
        bits = int(2 * most).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table, self.keys, self.n = np.full(1 << bits, -1, np.int32), np.empty(most, np.uint64), 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * self._MUL) >> self.shift).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those that aren't there."""
        out, slot = np.full(len(hashes), -1, np.int32), self._slots(hashes)
        open_: np.ndarray | slice = slice(None)
        while len(slot):
            row = self.table[slot]
            same = (row >= 0) & (self.keys[row] == hashes)
            places = np.arange(len(out))[open_]
            out[places[same]] = row[same]
            more = (row >= 0) & ~same
            open_, slot, hashes = places[more], (slot[more] + 1) & self.mask, hashes[more]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """New distinct hashes, as many as there is room for."""
        rows = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        self.keys[self.n : self.n + len(hashes)] = hashes
        self.n += len(hashes)
        slot = self._slots(hashes)
        while len(rows):
            free = self.table[slot] < 0
            self.table[slot[free]] = rows[free]  # of several for one slot the last gets it
            left = self.table[slot] != rows
            rows, slot = rows[left], (slot[left] + 1) & self.mask


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text cut at white space into pieces of about LONG bytes, one at least; no word is cut."""
    at = 0
    while len(text) - at > 2 * LONG:
        stop = _BLANK.search(text, at + LONG)
        if not stop:
            break
        yield text[at : stop.start()]
        at = stop.start()
    yield text[at:]


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once.

    Only for a lower-casing model whose words never reach across white space, nor from
    a letter to a punctuation mark: the constructor reads the model file and refuses any
    other normalizer, cutting rule or kind of model than the ones below. A-Z are
    lower-cased and blanks put between letters and such marks before texts are cut at
    ASCII white space, so there are few distinct words; the model would do the same.
    Texts that may hold a special token are encoded as they stand.
    """

    # How the model file words what this class relies on.
    NORMALIZERS = (
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    )
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    # End of fixed values.
    MOST_WORDS = 1 << 20
    #: Marks that never continue a word; the apostrophe does.
    _MARKS = np.isin(np.arange(256), list(b'.,;:!?#$%&*)]"'))
    _LETTER = (np.arange(256) >= 0x61) & (np.arange(256) <= 0x7A)
    #: Words that are one run of Latin letters, or of marks: one word to the model.
    _SIMPLE = re.compile(rb"(?:[a-z]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[.,;:!?#$%&*()\[\]\"]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        with open(path, encoding="utf-8") as f:
            fault = self.refused(json.load(f))
        if fault:
            raise ValueError(f"this tokenizer can't be applied word by word: {fault}")
        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    @classmethod
    def refused(cls, said: dict) -> str | None:
        """Why a model file, as read from JSON, is none of those meant; None if it is one."""
        if (said.get("normalizer") or {}).get("normalizers") != list(cls.NORMALIZERS):
            return "its normalizer is another"
        cutting = (said.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if len(cutting) != 2 or cutting[0].get("pattern") != {"Regex": cls.WORDS} or not cutting[0].get("invert") or cutting[0].get("behavior") != "Removed":
            return "it cuts words by another rule"
        if cutting[1].get("type") != "ByteLevel" or cutting[1].get("add_prefix_space") or cutting[1].get("use_regex"):
            return "it cuts or pads words once more"
        model = said.get("model") or {}
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix") or model.get("dropout"):
            return "its model isn't one of pairs with word ends"
        for t in said.get("added_tokens") or []:
            if not t["content"].startswith("<|") or t["content"].split() != [t["content"]] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                return f"its token {t['content']!r} isn't one that stands in <| and takes no white space"
        return None

    def _clear(self, most: int = MOST_WORDS) -> None:
        self.known = _Vocabulary(most)
        self.flat, self.first, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all texts in a row, starts and ends of their words, number of words of each)."""
        data = B.FOLD[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        letter = self._LETTER[data]
        # Two-byte Latin letters: U+00C0 to U+023F but for the signs of times and division, and
        # for U+0130, whose lower case ends in a combining dot that goes on with a mark.
        lead = data - np.uint8(0xC3)
        pair = np.flatnonzero(lead[:-1] <= 5)
        pair = pair[~((lead[pair] == 0) & ((data[pair + 1] == 0x97) | (data[pair + 1] == 0xB7)) | (lead[pair] == 1) & (data[pair + 1] == 0xB0))]
        letter[pair + 1] = True
        at = np.flatnonzero(letter[:-1] & self._MARKS[data[1:]]) + 1
        data = np.insert(data, at, 0x20)
        starts += np.searchsorted(at, starts, "right")
        begin, end = B.spans(data, B.SOLID)
        return data, begin, end, np.diff(np.searchsorted(begin, starts))

    def _numbers(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word; new ones are learned. Two words of one 64-bit hash would be taken for one."""
        hashes = B.span_hashes(data, begin, end, False)
        of = self.known.find(hashes)
        new = np.flatnonzero(of < 0)
        if len(new):
            found, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            if self.known.n + len(found) > len(self.known.keys):
                self._clear(max(self.MOST_WORDS, len(begin)))
                return self._numbers(data, begin, end)
            of[new] = self.known.n + back
            self.known.add(found)
            raw = data.tobytes()
            self._learn([raw[a:b] for a, b in zip(begin[new[first]].tolist(), end[new[first]].tolist(), strict=True)])
        return of

    def _learn(self, words: list[bytes]) -> None:
        """Encode words that are new, simple ones as joined texts of many."""
        simple = np.fromiter((self._SIMPLE.fullmatch(w) is not None for w in words), bool, len(words))
        size = np.zeros(len(words), np.int64)
        flat, order = [], []
        some = np.flatnonzero(simple)
        parts = np.split(some, range(1000, len(some), 1000)) if len(some) else []
        joined = [b" ".join([words[k] for k in part]).decode() for part in parts]
        rest = [np.flatnonzero(~simple)]
        for part, e in zip(parts, self.model.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                size[part] = np.diff(ends, prepend=0)
                flat.append(ids)
                order.append(part)
            else:  # never so for the words meant; then one by one
                rest.append(part)
        left = np.concatenate(rest)
        for k, e in zip(left, self.model.encode_batch_fast([words[k].decode() for k in left], add_special_tokens=False), strict=True):
            size[k] = len(e.ids)
            flat.append(np.array(e.ids, np.uint32))
        place = np.concatenate([*order, left]).astype(np.int64)
        first = np.empty(len(words), np.int64)
        first[place] = len(self.flat) + np.cumsum(size[place]) - size[place]
        self.flat = np.concatenate([self.flat, *flat])
        self.first, self.size = np.concatenate([self.first, first]), np.concatenate([self.size, size])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        if all(len(t) <= 2 * LONG for t in texts):
            return self._encode(texts)
        parts = [list(_pieces(t)) for t in texts]
        got = [self._encode([p]) for own in parts for p in own]
        sizes = np.concatenate([[0], np.cumsum([int(n[0]) for _, n in got])])
        ends = np.concatenate([[0], np.cumsum([len(own) for own in parts])])
        return np.concatenate([ids for ids, _ in got]), np.diff(sizes[ends])

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = [k for k, t in enumerate(texts) if b"<|" in t]
        data, begin, end, counts = self._cut([b"" if b"<|" in t else t for t in texts])
        of = self._numbers(data, begin, end)
        size = self.size[of]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.first[of] - (ends - size), size) + np.arange(total)]
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        if not whole:
            return ids, np.diff(at)
        parts = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
        for k in whole:
            parts[k] = np.array(self.model.encode(texts[k].decode(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def write(docs: DataFrame, tokenizer_path: str, out_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", part_tokens: int = PART_TOKENS) -> None:
    """Write the containers of all texts, in ascending doc_id order over shards and parts."""
    spark = prepare(docs.sparkSession, 256)
    src = docs.select(F.coalesce(F.col(id_col).try_cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = src.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = _tokenizer(tokenizer_path), 0
        ids, doc_ids, sizes, shard, held = [], [], [], None, 0

        def flush() -> pa.RecordBatch:
            firsts = np.concatenate([[0], np.cumsum(sizes)])
            return pa.RecordBatch.from_arrays([pa.array([encode(np.concatenate(ids), doc_ids, firsts, shard=shard, part=part)], pa.binary())], ["container"])

        for batch in batches:
            raw, at = B.buffers(batch.column(1))
            k, rows = 0, batch.num_rows
            shard = batch.column(2)[0].as_py() if rows else shard
            while k < rows:  # some texts at a time
                stop = max(k + 1, int(np.searchsorted(at, at[k] + 4 * B.PIECE, "right")) - 1)
                got, n_ids = tok.encode([raw[at[r] : at[r + 1]].tobytes() for r in range(k, stop)])
                ends = np.cumsum(n_ids)
                with_end = np.insert(got, ends, np.uint32(end_id))
                ids.append(with_end)
                doc_ids += batch.column(0)[k:stop].to_pylist()
                sizes += (n_ids + 1).tolist()
                held += len(with_end)
                k = stop
                if held >= part_tokens:
                    yield flush()
                    part, held = part + 1, 0
                    ids, doc_ids, sizes = [], [], []
        if doc_ids:
            yield flush()

    # A string column keeps any bytes, and the writer puts them out as they are.
    lines = ordered.mapInArrow(run, "container binary").select(F.col("container").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", 1).option("compression", "none").text(f"{out_path}/containers")
    _write_index(spark, out_path)


def _containers(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the containers at a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/containers")
    return files.select(F.substring_index("path", "/", -1).alias("file"), "content")


def _write_index(spark: SparkSession, path: str) -> None:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        heads = [Layout(memoryview(h.as_buffer())) for h in batch.column(1)]
        cols = [pa.array([getattr(h, c) for h in heads], pa.int64()) for c in ("shard", "part", "n_tokens", "n_docs")]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], ["file", "shard", "part", "n_tokens", "n_docs"])

    heads = _containers(spark, path).select("file", F.substring("content", 1, HEAD).alias("head")).where(F.length("head") == HEAD)
    heads = cut(map_batches(heads, run, "file string, shard long, part long, n_tokens long, n_docs long"), "heads")
    # Tokens before each container, in the order of shards and parts.
    shards = sums_before(heads.groupBy("shard").agg(F.sum("n_tokens").alias("n")), "shard", ["n"]).select("shard", "n_before")
    parts = sums_before(heads, "part", ["n_tokens"], ["shard"]).join(shards, "shard")
    parts = parts.select("file", "shard", "part", (F.col("n_before") + F.col("n_tokens_before")).alias("first"), "n_tokens", "n_docs")
    parts.coalesce(8).write.parquet(f"{path}/index")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(file, shard, part, first, n_tokens, n_docs) of the containers at a path."""
    return spark.read.schema("file string, shard long, part long, first long, n_tokens long, n_docs long").parquet(f"{path}/index")


class TokenFiles:
    """Single tokens of written files, read by ranges of bytes from the driver.

    ``bytes_read`` counts what was fetched.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.bytes_read = spark, path.rstrip("/"), 0

    def tokens_at(self, places: Sequence[int]) -> list[int]:
        """The ids at some places of all tokens, in the order asked for."""
        wanted = F.array(*[F.lit(int(p)).cast("long") for p in places])
        here = F.filter(wanted, lambda p: (p >= F.col("first")) & (p < F.col("first") + F.col("n_tokens")))
        rows = index(self.spark, self.path).withColumn("here", here).where(F.size("here") > 0).collect() if len(places) else []
        found: dict[int, int] = {}
        for r in rows:
            with _Ranges(self.spark, f"{self.path}/containers/{r['file']}") as ranges:
                layout = Layout(ranges.fetch(0, HEAD))
                found |= {p: token_at(ranges.fetch, layout, p - r["first"]) for p in r["here"]}
            self.bytes_read += ranges.n
        if missing := [p for p in places if p not in found]:
            raise IndexError(f"no token at {missing[0]}")
        return [found[p] for p in places]

    def token_at(self, place: int) -> int:
        return self.tokens_at([place])[0]


class _Ranges:
    """Ranges of a file on any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.n = spark, path, 0

    def __enter__(self) -> _Ranges:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        self.stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        self.read = jvm.org.apache.commons.io.IOUtils.toByteArray
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()

    def fetch(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        self.n += n
        return bytes(self.read(self.stream, n))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    prepare(spark)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            reader = Reader(memoryview(content.as_buffer()))
            ids, firsts = reader.run(0, reader.n_tokens).astype("<u4"), reader.firsts.tolist()
            for doc_id, a, b in zip(reader.doc_ids.tolist(), firsts, firsts[1:], strict=False):
                out.append((name, None if doc_id == _NO_ID else doc_id, a, b - a, zlib.crc32(ids[a:b])))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = _containers(spark, path).where(F.length("content") >= HEAD)
    docs = map_batches(files, run, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(index(spark, path).select("file", "first"), "file").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to the shared folder and read the files back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write(docs, tokenizer_path, path, end_id)
    return read(docs.sparkSession, path)
