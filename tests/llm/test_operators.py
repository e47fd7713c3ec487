"""Each corpus operator against a brute-force version, on rows that hold every awkward case."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigraph.llm import bytetext as B
from evigraph.llm import decontam, language_id, license_scan, line_dedup, near_dedup, quality_knn, quality_rules, source_mix, token_output, url_filter
from evigraph.llm.queries import tokenizer_path

rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdeéßžЖ") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, row string"


def prose(n, r=rng):
    out = []
    for _ in range(n):
        w = r.choice(VOCAB)
        out.append(w.capitalize() if r.random() < 0.1 else w)
        out.append(r.choice([" ", " ", " ", "\n", "  ", ", ", ".\n", "\t"]))
    return "".join(out)


def texts():
    """Texts with nulls, copies, near copies, repeats, long and empty ones."""
    base = [prose(rng.randrange(30, 300)) for _ in range(40)]
    out = [None, "", " \n\t ", "one", "One", "a b", "é", "!!! ###", "x" * 5000, base[0], base[0]]
    out += base
    for b in base[:12]:  # near copies of growing distance
        ws = b.split(" ")
        for share in (0.01, 0.03, 0.06, 0.12):
            out.append(" ".join(rng.choice(VOCAB) if rng.random() < share else w for w in ws))
    line = "this very line is repeated over documents and is long enough "
    out += [prose(20) + "\n" + line + "\n" + prose(5), "\n".join([line.upper()] * 3), line + " x", *["\r " + line + "\n" + prose(3) for _ in range(6)]]
    out += ["\n".join(["same line again"] * 30), "la " * 200, prose(40) * 3]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ["en", "fr", None][i % 3], ["s0", "s1", "s0", None][i % 4] if i % 7 else "s0", None, "clash", "clash", "clash") for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


SOLID = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Words.


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 18])
@pytest.mark.parametrize(("table", "pattern"), [(B.SOLID, SOLID), (B.ALNUM, ALNUM)])
def test_words_equal_the_pattern(rows, piece, table, pattern):
    all_texts = [r[1] for r in rows] + [prose(3000)]
    column = pa.array(["skipped", *all_texts])[1:]
    got = {}
    for w in B.words(column, table, piece=piece):
        got[w.row] = [w.data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends, strict=True)]
        assert len(w.hashes) == len(got[w.row])
    low = {i: [x.translate(LOW) for x in ws] for i, ws in got.items()}
    assert low == {i: pattern.findall((t or "").translate(LOW)) for i, t in enumerate(all_texts)}


def test_hashes_depend_on_the_word_alone():
    a, b = B.words(pa.array(["Abc abc xAbc", "zz Abc\nABC"]), fold=False), B.words(pa.array(["Abc", "ABC abc"]), fold=True)
    first, second = (w.hashes for w in a)
    assert first[0] == second[1] and len({*first, *second}) == 5
    one, two = (w.hashes for w in b)
    assert one[0] == two[0] == two[1]


# 2. Quality rules.


def brute_rules(text):
    text = text or ""
    ws = SOLID.findall(text)
    n, chars = len(ws), sum(map(len, ws))
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if SOLID.search(line):
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + sum(map(len, SOLID.findall(line)))
            seen.add(line)

    def covered(k, later_only):
        grams = [tuple(ws[i : i + k]) for i in range(n - k + 1)]
        places, earlier = set(), set()
        for i, g in enumerate(grams):
            if (g in earlier) if later_only else grams.count(g) > 1:
                places.update(range(i, i + k))
            earlier.add(g)
        return places

    repeat = len(covered(3, False))
    runs = [sum(len(ws[i]) for i in covered(k, True)) for k in range(5, 11)]
    failed = n < 50 or 100 * repeat > 50 * n
    kept = not failed and 100 * dup_chars <= 20 * chars and all(100 * c <= m * chars for c, m in zip(runs, (15, 14, 13, 12, 11, 10), strict=True))
    return (n, chars, len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, failed, kept, dup_chars, *runs)


def test_quality_rules(docs, rows, none):
    got = {r["doc_id"]: tuple(r)[1:] for r in quality_rules.score(docs).collect()}
    assert got == {r[0]: brute_rules(r[1]) for r in rows}
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in got.items() if v[6]}
    assert quality_rules.score(none).count() == 0 and quality_rules.keep(none).count() == 0


# 3. Near-duplicates.


def shingle_set(text, k):
    ws = SOLID.findall((text or "").translate(LOW))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def brute_groups(pairs, k, percent=80):
    sets = {i: shingle_set(t, k) for i, t in pairs}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                ra, rb = find(i), find(j)
                comp[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, rows, none, k):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.groups(docs, k).collect()}
    assert got == brute_groups([(r[0], r[1]) for r in rows], k)
    if k == 5:
        kept = near_dedup.keep(docs, k)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i, v in got.items() if v[2]] or sorted(i for i, v in got.items() if v[2]) == sorted(r["doc_id"] for r in kept.collect())
        assert near_dedup.groups(none, k).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_chains_of_near_copies_are_one_group(spark, monkeypatch, small):
    """Each text is near the next only: all links must be found and no pivot sees them all."""
    if small:  # every bucket a grid, every component a large one
        monkeypatch.setattr(near_dedup, "CELL", 2)
        monkeypatch.setattr(near_dedup, "LARGE", 1)
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    chain = []
    for step in range(40):
        chain.append(" ".join(words))
        for at in r.sample(range(400), 12):
            words[at] = f"n{step}x{at}"
    order = list(range(40))
    r.shuffle(order)
    data = [(order[i], t) for i, t in enumerate(chain)] + [(100 + i, " ".join(f"z{i}q{j}" for j in range(60))) for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_dedup.groups(df, 2).collect()}
    assert got == brute_groups(data, 2)


def test_repeated_and_null_ids(spark):
    t = prose(80)
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (7, t), (8, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.groups(df, 2).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, None, True), (7, 5, False), (8, 8, True)], key=str)
    assert sorted(str(r["doc_id"]) for r in near_dedup.keep(df, 2).collect()) == ["5", "8", "None"]


def test_repeated_ids_with_other_texts_go_by_their_texts(spark):
    ws = [[f"{c}{i}" for i in range(200)] for c in "abc"]
    near = [[*w[:195], "x", *w[196:]] for w in ws]
    a, b, c, a2, b2, c2 = (" ".join(w) for w in (*ws, *near))
    data = [(5, a), (5, b), (5, a2), (6, a2), (7, b2), (3, c), (9, c2), (9, "quite another text"), (8, ""), (8, None), (None, a)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.groups(df, 2).collect()), key=str)
    want = [(5, 5, True), (5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (3, 3, True), (9, 3, False), (9, 9, True), (8, 8, True), (8, 8, True), (None, None, True)]
    assert got == sorted(want, key=str)
    kept = sorted((str(r["doc_id"]), (r["text"] or "")[:1]) for r in near_dedup.keep(df, 2).collect())
    assert kept == [("3", "c"), ("5", "a"), ("5", "b"), ("8", ""), ("9", "q"), ("None", "a")]


def test_one_fixed_row_of_equal_ids_and_texts_is_kept(spark):
    """Rows that differ in other columns only: the smallest stays, whatever the order and the partitions."""
    t = prose(80)
    data = [(5, t, s, n) for s in ("c", "a", None, "b") for n in ({"k": 2}, {"k": 1}, None)] + [(6, t, "a", None), (8, "", "x", None), (8, None, "y", None), (8, None, "x", None)]
    seen = set()
    for k in range(10):
        random.Random(k).shuffle(data)
        df = spark.createDataFrame(data, "doc_id long, text string, source string, tags map<string,int>").repartition(1 + k % 4)
        seen.add(tuple(sorted(str(tuple(r)) for r in near_dedup.keep(df, 2).collect())))
    assert len(seen) == 1 and len(next(iter(seen))) == 2 and "None, None)" in next(iter(seen))[0]


def test_ids_that_are_no_numbers_are_kept(spark):
    t = prose(80)
    df = spark.createDataFrame([("7", t), ("05", t), ("x", t), ("x", t), (None, t)], "doc_id string, text string")
    assert sorted(str(r["doc_id"]) for r in near_dedup.keep(df, 2).collect()) == ["05", "None", "x", "x"]


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    limit = near_dedup.most_flips(0.8)
    for n in (20, 300, 3000):
        flips = {0.8: [], 0.5: []}
        for _ in range(40):
            for j in flips:
                common = int(round(n * 2 * j / (1 + j)))
                x = r.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64) * np.uint64(2)
                a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:common], x[n:]]))
                sa, sb = (near_dedup.bands_and_sketch(near_dedup.samples(s))[1] for s in (a, b))
                flips[j].append(int(np.bitwise_count(sa ^ sb).sum()))
        assert max(flips[0.8]) <= limit < min(flips[0.5])


# 4. Mix.


def test_mix_meets_targets(docs, rows, none):
    got = source_mix.mix(docs, bin_rows=16).collect()
    size = {i: len(SOLID.findall(t or "")) for i, t, *_ in rows}
    assert {r["doc_id"]: r["size"] for r in got} == size
    total = sum(size.values())
    longest = max(size.values())
    by = {}
    src = {r[0]: r[3] for r in rows}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        t = by.setdefault(src[r["doc_id"]], [0, r["target"], r["source_size"]])
        t[0] += r["taken"]
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    free, share = set(names), {}
    while True:  # water filling
        rest = total - sum(share.values())
        level = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if level[s] > 3 * by[s][2]}
        if not full:
            share |= level
            break
        share |= {s: 3 * by[s][2] for s in full}
        free -= full
    for s in names:
        assert by[s][1] == pytest.approx(share[s]) and abs(by[s][0] - share[s]) <= longest
    assert 0 <= total - sum(t[0] for t in by.values()) <= longest
    again = {r["doc_id"]: r["taken"] for r in source_mix.mix(docs.repartition(5), bin_rows=7).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    assert source_mix.mix(none).count() == 0


def test_sums_and_places_over_many_groups(spark, monkeypatch):
    r = random.Random(8)
    values = [(k % 3, k // 3, r.randrange(100)) for k in range(300)]
    df = spark.createDataFrame(values, "by int, place long, v long").repartition(5)
    got = {(x["by"], x["place"]): x["v_before"] for x in source_mix.sums_before(df, "place", ["v"], ["by"], group=7).collect()}
    assert got == {(b, p): sum(v for c, q, v in values if c == b and q < p) for b, p, _ in values}
    monkeypatch.setattr(source_mix, "GROUP", 2)
    got = {x["place"]: x["n"] for x in source_mix.numbered(df.where("by = 0"), [F.desc("place")], "n", 100).collect()}
    assert got == {p: 100 - p for p in range(100)}


def test_rows_without_id_spread_over_the_bins(spark, monkeypatch):
    """Thousands of rows of no id and of one id fall into many bins; each is taken by itself."""
    seen = []
    real = source_mix.cut
    monkeypatch.setattr(source_mix, "cut", lambda df, name, *a: seen.append((name, out := real(df, name, *a))) or out)
    data = [(None if k % 2 else 7, "one two three", "s") for k in range(2000)] + [(k, "a b", "t") for k in range(100, 400)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    got = source_mix.mix(df, bin_rows=20).collect()
    placed = next(d for name, d in seen if name == "placed").groupBy("rank", "bin").count().agg(F.max("count"), F.count("bin")).first()
    assert placed[0] < 60 and placed[1] > 80
    assert len(got) == 2300 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for size in {r["source_size"] for r in got}:
        own = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 6


def test_many_sources_meet_their_targets(spark):
    sizes = [(None if k == 77 else f"host{k:03d}", (k * 37) % 101, 1) for k in range(120)]
    got = {r["source"]: (r["rank"], r["target"]) for r in source_mix.source_targets(spark.createDataFrame(sizes, "source string, source_size long, n_docs long"), (1, 2, 3), 3).collect()}
    names = sorted((s for s, *_ in sizes if s), key=str) + [None]
    size = {s: n for s, n, _ in sizes}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    free, share, total = set(names), {}, sum(size.values())
    while True:
        level = (total - sum(share.values())) / sum(weight[x] for x in free)
        full = {s for s in free if level * weight[s] > 3 * size[s]}
        if not full:
            share |= {s: level * weight[s] for s in free}
            break
        share |= {s: 3 * size[s] for s in full}
        free -= full
    assert {s: r for s, (r, _) in got.items()} == {s: k + 1 for k, s in enumerate(names)}
    assert {s: t for s, (_, t) in got.items()} == pytest.approx(share)


def test_repeat_keeps_columns(docs, rows):
    taken = {r["doc_id"]: r["copies"] for r in source_mix.mix(docs).collect()}
    out = source_mix.repeat(docs)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in taken.items() if c}


# 5. Token output.


def test_codes_give_random_access():
    r = np.random.default_rng(4)
    for n in (0, 1, 511, 512, 513, 4000):
        ids = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        firsts = np.unique(np.concatenate([[0], np.sort(r.integers(0, n + 1, 5)), [n]])) if n else np.array([0, 0])
        reader = token_output.Reader(token_output.encode(ids, list(range(len(firsts) - 1)), firsts))
        assert (reader.tokens(np.arange(n)) == ids).all()
        places = r.integers(0, max(n, 1), 50 if n else 0)
        assert (reader.tokens(places) == ids[places]).all() and all(reader.token(int(p)) == ids[p] for p in places[:5])
        for k in range(len(firsts) - 1):
            assert (reader.document(k) == ids[firsts[k] : firsts[k + 1]]).all()
        raw = token_output.encode(ids, [], np.array([n]), shard=3, part=4)
        layout = token_output.Layout(raw[: token_output.HEAD])
        assert (layout.shard, layout.part, layout.n_tokens) == (3, 4, n)
        assert [token_output.token_at(lambda at, k: raw[at : at + k], layout, int(p)) for p in places] == ids[places].tolist()
    with pytest.raises(ValueError):
        token_output.Reader(b"something else")
    with pytest.raises(IndexError):
        token_output.token_at(lambda at, k: raw[at : at + k], layout, layout.n_tokens)


ODD = [
    "it's we'll 'd 's", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "İstanbul ΑΣ ΟΔΟΣ ς", "1234 5 ½ ²", "a\x1cb \x1c! !\x85?  x　y", "😀 👨‍👩‍👧", "\x00 \x01a", "ﬁ Å Å", "가각",
    "Straße…. ×. ÷, a×, ñ. ÑANDÚ! é. x×.", "a≠b, a.̸ b!́", "Ɂ. ɐ. ȿ, ǆ;", "don't, 's. 'LL", "##ab$$ (c) [d] \"e\"", "…,a…!", "ª. º, µ!",
]


def test_word_wise_ids_equal_the_library(rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    all_texts = [r[1] or "" for r in rows] + ODD
    ids, sizes = token_output.WordTokenizer(tokenizer_path()).encode([t.encode() for t in all_texts])
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k, t in enumerate(all_texts):
        assert ids[at[k] : at[k + 1]].tolist() == model.encode(t, add_special_tokens=False).ids, t


def test_letters_that_change_their_length_in_lower_case():
    """Every such code point, and every Latin letter of two bytes, before and after every mark."""
    from tokenizers import Tokenizer

    model, words = Tokenizer.from_file(tokenizer_path()), token_output.WordTokenizer(tokenizer_path())
    letters = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and len(chr(c).lower()) != 1] + [chr(c) for c in range(0xC0, 0x250)]
    assert "\u0130" in letters
    given = [f"{a}{c}{m}{b} x{m}{c}" for c in letters for m in ".,;:!?#$%&*)]\"'" for a, b in (("", ""), ("B", "L"))]
    given += ["B\u0130LG\u0130.", "B\u0130LG\u0130, D\u0130L\u0130; x", "(\u0130)", "\u0130.\u0130.", "\u0130"]
    ids, sizes = words.encode([t.encode() for t in given])
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    for t, got, want in zip(given, parts, model.encode_batch_fast(given, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids, t


def test_token_output(spark, docs, rows, none):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.round_trip(docs, tokenizer_path()).collect()}
    start, want = 0, {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    assert token_output.round_trip(none, tokenizer_path()).count() == 0
    two = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted(r["start"] for r in token_output.round_trip(two, tokenizer_path()).collect()) == [0, 2, 5]


def test_single_tokens_are_read_by_a_few_bytes(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    want = [x for _, t, *_ in sorted(rows, key=lambda r: r[0]) for x in [*model.encode(t or "", add_special_tokens=False).ids, 2]]
    path = f"file://{tmp_path}/tokens"
    token_output.write(docs, tokenizer_path(), path, part_tokens=500)
    files = token_output.TokenFiles(spark, path)
    places = [0, len(want) - 1, *random.Random(2).sample(range(len(want)), 40), 7, 7]
    assert files.tokens_at(places) == [want[p] for p in places] and files.token_at(5) == want[5]
    n = token_output.index(spark, path).count()
    assert n == 4 and token_output.read(spark, path).agg(F.sum("n_tokens")).first()[0] == len(want)
    assert files.bytes_read <= token_output.HEAD * (n + 1) + 3 * 76 * (len(places) + 1)
    with pytest.raises(IndexError):
        files.tokens_at([3, len(want)])


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    text = " ".join(ODD) + prose(400) + "x" * 300 + "\n<|endoftext|> " + prose(100)
    tok = token_output.WordTokenizer(tokenizer_path())
    for size in (1, 10, 100):
        monkeypatch.setattr(token_output, "LONG", size)
        ids, sizes = tok.encode([text.encode(), b"", prose(5).encode(), text.encode()])
        assert ids[: sizes[0]].tolist() == model.encode(text, add_special_tokens=False).ids and sizes[1] == 0 and sizes[0] == sizes[3]
        assert len(ids) == sizes.sum()


def test_vocabularies_start_anew_when_they_are_full(monkeypatch):
    tok = token_output.WordTokenizer(tokenizer_path())
    texts = [prose(60).encode() for _ in range(12)] + [",".join(f"w{k}x" for k in range(300)).encode()]
    want = tok.encode(texts)
    monkeypatch.setattr(tok, "MOST_WORDS", 40)
    tok._clear(40)
    for _ in range(2):
        got = [tok.encode([t]) for t in texts]
        assert (np.concatenate([i for i, _ in got]) == want[0]).all() and [int(n[0]) for _, n in got] == want[1].tolist()


def test_numbers_of_words():
    r = np.random.default_rng(1)
    v = token_output._Vocabulary(1000)
    keys = np.unique(r.integers(0, 1 << 63, 1000, dtype=np.uint64))
    for part in np.array_split(r.permutation(keys), 7):
        assert (v.find(part) == -1).all()
        n = v.n
        v.add(part)
        assert (v.find(part) == np.arange(n, v.n)).all()
    assert sorted(v.find(keys)) == list(range(len(keys)))


def test_other_tokenizers_are_refused(tmp_path):
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        said = json.load(f)
    said["model"] |= {"vocab": {"a": 0, "a</w>": 1}, "merges": []}
    ways = [
        lambda d: d["normalizer"]["normalizers"].pop(), lambda d: d["pre_tokenizer"]["pretokenizers"].pop(0), lambda d: d["pre_tokenizer"]["pretokenizers"][1].update(add_prefix_space=True),
        lambda d: d["model"].update(end_of_word_suffix=None), lambda d: d["added_tokens"][0].update(lstrip=True), lambda d: d["added_tokens"][0].update(content="<| a |>"), lambda d: d.update(normalizer=None),
    ]
    assert token_output.WordTokenizer.refused(said) is None
    for way in ways:
        other = json.loads(json.dumps(said))
        way(other)
        (tmp_path / "t.json").write_text(json.dumps(other))
        with pytest.raises(ValueError):
            token_output.WordTokenizer(str(tmp_path / "t.json"))


# 6. Decontamination.


def test_decontamination(spark, docs, rows, none):
    words = [ALNUM.findall((t or "").translate(LOW)) for _, t, *_ in rows]
    long = [w for w in words if len(w) > 60]
    items = [(1, " ".join(long[0][5:30])), (2, "- " + "; ".join(long[1][0:10]).upper()), (10, " ".join(long[2][-12:])), (11, "nowhere " * 12), (3, long[3][0]), (4, ""), (5, None), (6, " ".join(long[0][5:30])), (7, " ".join(long[4][3:7])), (8, " ".join(long[5][3:12])), (None, " ".join(long[6][0:10]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontam.scan(docs, bench).collect()}
    wins = {}
    for item, t in items:
        ws = ALNUM.findall((t or "").translate(LOW))
        for k in range(max(1, len(ws) - 9) if ws else 0):
            wins.setdefault(tuple(ws[k : k + 10]), set()).add(item)
    want = {}
    for (i, *_), ws in zip(rows, words, strict=True):
        hit, who = set(), set()
        for n in {len(w) for w in wins}:
            for p in range(len(ws) - n + 1):
                if tuple(ws[p : p + n]) in wins:
                    hit.update(range(p, p + n))
                    who |= wins[tuple(ws[p : p + n])]
        names = sorted(str(x) for x in who if x is not None)
        want[i] = (len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    assert got == want
    assert sum(v[4] for v in want.values()) >= 5
    kept = decontam.keep(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in want.items() if not v[4]}
    assert decontam.scan(none, bench).count() == 0
    assert decontam.scan(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_decides_by_row(spark):
    passage = " ".join(f"leak{k}" for k in range(12))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    held = [(None, "before " + passage), (None, "clean without an id"), (7, passage + " after"), (7, "clean with the same id"), (8, "clean"), (8, "clean")]
    df = spark.createDataFrame([(*r, "clash") for r in held], "doc_id long, text string, _scan_row string").repartition(3)
    kept = decontam.keep(df, bench)
    assert kept.columns == df.columns
    assert sorted(r["text"] for r in kept.collect()) == ["clean", "clean", "clean with the same id", "clean without an id"]


# 7. URLs.


def test_urls(spark):
    urls = [None, "", "no scheme/casino", "http://a.example.com/en/1", "http://WWW.Example.com/en/1", "http://x.com", "http://x.com/a", "http://b.net/es/xxx", "http://b.net/de/xxx", "http://b.org/essex/1", "http://b.org/cheap-pills", "http://b.org/free/free", "http://c.org?q=http://d.net/es/", "https://e.org#adult-x", "http://notexample.com/en/", "http://b.net/fr", "ftp://f.org/freebets", "http://g.org/CASINO"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {urls[r["page_id"]]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got == {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/casino": ("", "", None, "block"),
        "http://a.example.com/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"), "http://WWW.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://x.com": ("x.com", "", None, "allow"), "http://x.com/a": ("x.com", "/a", "com/", "allow"), "http://b.net/es/xxx": ("b.net", "/es/xxx", "net/es/", "block"),
        "http://b.net/de/xxx": ("b.net", "/de/xxx", None, "block"), "http://b.org/essex/1": ("b.org", "/essex/1", None, "allow"), "http://b.org/cheap-pills": ("b.org", "/cheap-pills", None, "block"),
        "http://b.org/free/free": ("b.org", "/free/free", None, "allow"), "http://c.org?q=http://d.net/es/": ("c.org", "", None, "allow"), "https://e.org#adult-x": ("e.org", "", None, "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://b.net/fr": ("b.net", "/fr", None, "allow"), "ftp://f.org/freebets": ("f.org", "/freebets", None, "allow"), "http://g.org/CASINO": ("g.org", "/CASINO", None, "block"),
    }
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_terms(spark, oracle, tmp_path):
    """Weights, escapes and boundaries against the SQL, on urls made of terms and their neighbours."""
    r = random.Random(12)
    terms = [*url_filter.STRICT, *url_filter.SOFT, "winner", "freedom", "sussex", "en", "a"]
    urls = ["http://h.org/win/discount", "http://h.org/free-download", "http://h.org/%63asino", "http://h.org/%43ASINO", "http://h.org/ads-track", "http://h.org/%2563asino", "http://h.org/%zz%6", "http://adult.h.org/", "http://h.org/c%C3%A9casino", "http://h.org/casino\u00e9", None]
    urls += ["http://h.org/" + "".join(r.choice(terms) + r.choice(["-", "/", "_", ".", "%20", "%2d", "", "é", "1", "%E4"]) for _ in range(r.randrange(1, 5))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[x["page_id"]]: x["verdict"] for x in url_filter.judge(df.where("page_id < 11")).collect()}
    assert [got[u] for u in urls[:8]] == ["allow", "allow", "block", "block", "block", "allow", "allow", "allow"]
    df.coalesce(1).write.parquet(f"{tmp_path}/pages")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    rel = con.sql(url_filter.SQL)
    want = sorted(tuple(map(str, x)) for x in rel.fetchall())
    assert want == sorted(tuple(str(x[c]) for c in rel.columns) for x in url_filter.judge(df).collect())


def test_overlapping_terms_count_once(spark):
    v = url_filter.Vocabulary(["red light"], {"red": 1, "light": 1, "light-house": 2, "house": 1})
    assert v.hits("x red light y") == (1, 0, 0) and v.hits("light-house") == (0, 1, 2) and v.hits("red light-house") == (0, 2, 3)
    assert url_filter.Vocabulary([], {"blog": 0}).hits("http://x.org/blog") == (0, 1, 0)
    odd = spark.createDataFrame([("blog", "soft", 0), ("blog", "soft", None), (None, "soft", 3), (None, None, None), ("log", "soft", 1), ("log", "soft", 4), ("both", "soft", 2), ("Both", "strict", None), ("x", "other", 9)], "term string, kind string, weight int")
    assert url_filter.terms_of(odd) == (["both"], {"blog": 1, "log": 4})
    table = spark.createDataFrame([("Bad", "strict", 0), ("poor", "soft", 2), ("weak", "soft", 1)], "term string, kind string, weight int")
    pages = spark.createDataFrame([(1, "http://a/bad"), (2, "http://a/poor/poor"), (3, "http://a/poor-weak"), (4, "http://a/casino")], "page_id int, url string")
    assert {x["page_id"]: x["verdict"] for x in url_filter.judge(pages, vocabulary=table).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}


# 8. Language.


def _learned(corpus, order):
    runs = {}
    for k, t in enumerate(corpus.values()):
        for piece in language_id._pieces(np.frombuffer(t, np.uint8), order):
            for v in piece.tolist():
                for size in range(1, order + 2):
                    key = size, v & (1 << 8 * size) - 1, k
                    runs[key] = runs.get(key, 0) + 1
    cols = [np.array(x) for x in zip(*runs, strict=True)]
    return list(corpus), *cols, np.array(list(runs.values()))


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_code_lengths_follow_the_escape_rule(order):
    corpus = {"x": b"abcab abd abcabe", "y": b"zab ca  abce"}
    m = language_id.Model(*_learned(corpus, order))

    def brute(k, text):
        plain = lambda t: b" " * order + re.sub(rb"[^a-z]+", b" ", t)
        train, total, s = plain(list(corpus.values())[k]), 0.0, plain(text)
        for i in range(order, len(s)):
            bits, cost = None, 0.0
            for width in range(order, -1, -1):
                ctx, nxt = s[i - width : i], {}
                for j in range(order, len(train)):
                    if train[j - width : j] == ctx:
                        nxt[train[j]] = nxt.get(train[j], 0) + 1
                n, d = sum(nxt.values()), len(nxt)
                if s[i] in nxt:
                    bits = cost - np.log2(nxt[s[i]] / (n + d))
                    break
                cost += -np.log2(d / (n + d)) if n else 0.0
            total += cost + 8 if bits is None else bits
        return total

    texts = [b"abc", b"zab q", b"qq", b"ab", b"abcab  abce zz"]
    want = [[brute(0, t), brute(1, t)] for t in texts]
    data = [np.frombuffer(t, np.uint8) for t in texts]
    assert m.bits_of(data) == pytest.approx(np.array(want), rel=1e-5)
    assert [m.bits(d) for d in data] == [pytest.approx(w, rel=1e-5) for w in want]


def test_long_texts_are_scored_in_pieces(monkeypatch):
    m = language_id.Model(*_learned({"x": b"some words of it", "y": b"other ones"}, 4))
    data = np.frombuffer((b"words,  of   other " * 20) + b" ", np.uint8)
    whole = m.bits_of([data])[0]
    for piece in (1, 3, 7, 100):
        monkeypatch.setattr(B, "PIECE", piece)
        assert m.bits(data) == pytest.approx(whole, rel=1e-6)


def test_models_of_bounded_size_take_the_commonest_contexts_whole(spark):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(VOCAB) for _ in range(60)), "ab"[k % 2]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def learned(**kw):
        _, size, run, of, n = language_id.learn(df, **kw)
        out = {}
        for s, v, k, c in zip(size.tolist(), run.tolist(), of.tolist(), n.tolist(), strict=True):
            out.setdefault((s, k, v >> 8), {})[v & 255] = c
        return out

    whole, some = learned(), learned(most=200)
    assert some.items() <= whole.items() and len(some) < len(whole)
    for s in range(1, 6):
        for k in (0, 1):
            kept = [sum(c.values()) for (x, y, _), c in some.items() if (x, y) == (s, k)]
            gone = [sum(c.values()) for key, c in whole.items() if key[:2] == (s, k) and key not in some]
            assert sum(len(c) for key, c in some.items() if key[:2] == (s, k)) <= 100 and (not gone or not kept or max(gone) <= min(kept))
            assert s > 1 or not gone


def test_languages_are_scored_in_groups(spark, monkeypatch):
    r = random.Random(9)
    corpus = {f"l{k:02}": " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(30)).encode() for k in range(19)}
    texts = [np.frombuffer(t, np.uint8) for t in (*corpus.values(), b"ab", b"")]
    grouped = language_id.Model(*_learned(corpus, 4))
    assert [t.width for t in grouped.trees] == [8, 8, 3]
    monkeypatch.setattr(language_id, "GROUP", 100)
    whole = language_id.Model(*_learned(corpus, 4))
    assert grouped.bits_of(texts) == pytest.approx(whole.bits_of(texts), rel=1e-6)  # sums of float32 in another order
    assert [grouped.predict(b)[0] for b in grouped.bits_of(texts)[:19]] == list(corpus)


def test_languages_of_every_document_by_brute_force(spark, tmp_path):
    from evigraph.llm.queries import op8_partial_matching_language

    r = random.Random(12)
    words = {"a": ["sun", "moon", "stone", "River"], "b": ["sonne", "mond", "stein", "fluß"], "c": ["солнце", "луна", "камень", "река"]}
    rows = [(k, " ".join(r.choice(words[lang]) for _ in range(r.randint(1, 9))) + r.choice(["", ".", " 12"]), lang, "s") for k, lang in enumerate("abc" * 16)]
    rows += [(100, None, "a", "s"), (101, "12 !", "b", "s"), (102, "mond stone", None, None), (None, "луна", "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: (x["held_out"], x["lang_pred"], x["score"]) for x in op8_partial_matching_language(spark, str(tmp_path)).collect()}
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 3 == 1

    def runs(t):
        lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())
        return b" " * 4 + re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", lower).lstrip(b" ")

    tables = {}
    for k, t, lang, _ in rows:
        if t is not None and lang is not None and not held(k):
            s = runs(t)
            for i in range(4, len(s)):
                for width in range(5):
                    nxt = tables.setdefault(lang, {}).setdefault(s[i - width : i], {})
                    nxt[s[i]] = nxt.get(s[i], 0) + 1

    def bits(table, s):
        total = 0.0
        for i in range(4, len(s)):
            for width in range(4, -1, -1):
                nxt = table.get(s[i - width : i], {})
                n, d = sum(nxt.values()), len(nxt)
                if s[i] in nxt:
                    total -= np.log2(nxt[s[i]] / (n + d))
                    break
                total -= np.log2(d / (n + d)) if n else 0.0
            else:
                total += 8
        return total

    assert len(got) == len(rows)
    for k, t, _, _ in rows:
        if t is None or not re.search(r"[^\W\d_]", t):
            assert got[k] == (held(k), "und", 0.0)
            continue
        cost = {lang: bits(table, runs(t)) for lang, table in tables.items()}
        best = min(sorted(cost), key=cost.get)
        assert got[k][:2] == (held(k), best) and got[k][2] == pytest.approx(1 / sum(2 ** (cost[best] - c) for c in cost.values()), rel=1e-3)


def test_language_accuracy(spark, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    s = r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert s["a"] > 0.98 and 0 <= s["lo"] and s["hi"] <= 1
    odd = d.limit(300).select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(90001, None, "en"), (90002, "", "en"), (90003, "12 !?", None), (90004, "the", None)], "doc_id long, text string, lang string"))
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.identify(odd).where("doc_id > 90000").collect()}
    assert [got[90001 + k] for k in range(3)] == [("und", 0.0)] * 3 and got[90004][0] != "und"
    assert language_id.identify(none).count() == 0
    unlearned = language_id.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {x["lang_pred"] for x in unlearned.collect()} == {"und"}


# 9. Quality.


def test_quality_accuracy(spark):
    from evigraph.llm.queries import op9_neighbour_quality

    d = "/root/testdata/sf0.1"
    r = op9_neighbour_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = r[r.quality == 1].score.to_numpy(), r[r.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2
    assert auc > 0.98 and ((r.score >= 0) & (r.score <= 1)).all() and (r.predicted == (r.score >= 0.3)).all() and (r.predicted == r.quality).mean() > 0.95


def test_quality_votes_exactly(docs, rows, none, spark):
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows if r[0] % 3] + [(None, 1), (0, None)], "doc_id long, quality int")
    model = quality_knn.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_knn.score(docs.select("doc_id", "text"), model).collect()}
    counts = np.stack([quality_knn.term_counts(w) for w in B.words(pa.array([r[1] for r in rows]), fold=True)])
    for (i, *_), v in zip(rows, model.latent(counts), strict=True):
        ranked = sorted((-round(float(v @ u), quality_knn.DIGITS), k) for k, u in enumerate(model.vectors))[: quality_knn.NEIGHBOURS]
        w = [(max(-s, 0) ** quality_knn.SHARPNESS, model.labels[k]) for s, k in ranked]
        want = (sum(x * y for x, y in w) + quality_knn.PRIOR * model.share) / (sum(x for x, _ in w) + quality_knn.PRIOR)
        assert got[i] == pytest.approx(want, abs=1e-6)
    blank = quality_knn.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_knn.score(docs.select("doc_id", "text"), blank).collect()} == {0.5}
    assert quality_knn.score(none.select("doc_id", "text"), model).count() == 0


def test_equal_neighbours_vote_in_hash_order():
    r = np.random.default_rng(3)
    kinds = r.random((4, quality_knn.TERMS)).astype(np.float32)
    labels = r.integers(0, 2, 120)
    model = quality_knn.Model(kinds[np.arange(120) % 4], labels)
    got = model.scores(kinds)
    for k in range(4):
        first = labels[np.arange(120) % 4 == k][: quality_knn.NEIGHBOURS]
        want = (first.sum() + quality_knn.PRIOR * model.share) / (len(first) + quality_knn.PRIOR)
        assert got[k] == pytest.approx(want, abs=1e-6)


# 10. Lines.


def brute_lines(pairs):
    keys = lambda t: [x.strip(" \t\n\v\f\r").translate(LOW) for x in (t or "").split("\n")]
    held, last = {}, {}
    for i, t in pairs:
        for k in set(keys(t)):
            if len(k) >= 40:
                held[k] = held.get(k, 0) + 1
                last[k] = max(last.get(k, -1), i)
    out = {}
    for i, t in pairs:
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, keys(t), strict=True) if not (held.get(k, 0) >= 5 and last[k] != i)]
        out[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


@pytest.mark.parametrize("group_bytes", [64 << 20, 1])
def test_line_dedup(docs, rows, none, monkeypatch, group_bytes):
    if group_bytes == 1:
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.dedup(docs, group_bytes=group_bytes, min_docs=5, probes=3).collect()}
    want = brute_lines([(r[0], r[1]) for r in rows])
    assert got == want and sum(v[1] for v in want.values()) >= 8
    text = line_dedup.dedup(docs, group_bytes=group_bytes, with_text=True).collect()
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in text)
    assert line_dedup.dedup(none).count() == 0


@pytest.mark.parametrize("group_bytes", [64 << 20, 1])
def test_lines_of_null_text_and_repeated_ids(spark, group_bytes):
    line = "a line that is held by many documents, and long enough for it"
    held = [(k, f"own {k}\n{line}\n\n{line} ") for k in range(6)] + [(None, line), (7, line), (7, line), (7, f"{line}\nx"), (8, None)]
    df = spark.createDataFrame([(None if i is None else str(i), t) for i, t in held] + [("no number", line)], "doc_id string, text string")
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup(df, group_bytes=group_bytes, with_text=True).collect())
    want = [(str(k), 4, 2, f"own {k}\n") for k in range(6)] + [("None", 1, 1, ""), ("no number", 1, 1, ""), ("7", 1, 0, line), ("7", 1, 0, line), ("7", 2, 0, f"{line}\nx"), ("8", 1, 0, "")]
    assert got == sorted(want)
    # Rows of one document count once: five rows, two documents.
    few = spark.createDataFrame([(1, line)] * 4 + [(2, line)], "doc_id long, text string").repartition(3)
    assert {r["n_dropped"] for r in line_dedup.dedup(few, group_bytes=group_bytes).collect()} == {0}
    more = few.unionByName(spark.createDataFrame([(k, line) for k in (3, 4, 5, 5, None)], "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["n_dropped"]) for r in line_dedup.dedup(more, group_bytes=group_bytes).collect()) == [*[("1", 1)] * 4, ("2", 1), ("3", 1), ("4", 1), ("5", 0), ("5", 0), ("None", 1)]


@pytest.mark.parametrize("piece", [1, 5, 64])
def test_lines_in_pieces_equal_the_whole(rows, monkeypatch, piece):
    whole = [line_dedup.Lines(np.frombuffer((r[1] or "").encode(), np.uint8), 40) for r in rows]
    monkeypatch.setattr(B, "PIECE", piece)
    monkeypatch.setattr(B.span_hashes, "__defaults__", (0, piece))
    for r, x in zip(rows, whole, strict=True):
        y = line_dedup.Lines(np.frombuffer((r[1] or "").encode(), np.uint8), 40)
        assert x.n == y.n and all((getattr(x, c) == getattr(y, c)).all() for c in ("begin", "end", "keys", "prints"))


def test_perfect_hash_is_minimal_and_survives_bytes():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        prints, counts, last = keys ^ np.uint64(77), np.arange(len(keys)) + 5, np.arange(len(keys)) * 3
        shard = line_dedup.Shard.from_bytes(line_dedup.Shard.build(keys, prints, counts, last).to_bytes())
        assert sorted(shard.index.slots(keys)) == list(range(len(keys)))
        found, holder = shard.probe(keys, prints)
        assert found.all() and (holder == last).all()
        assert not shard.probe(keys, prints + np.uint64(1))[0].any()
        strange = np.setdiff1d(r.integers(0, 1 << 63, 1000, dtype=np.uint64), keys)
        assert not shard.probe(strange, strange)[0].any()


def test_long_lines_hash_alike_in_pieces():
    line = ("word " * 30_000).strip()
    data = np.frombuffer(("x\n" + line + "\n" + "y " * 400_000 + "\n " + line.upper() + " ").encode(), np.uint8)
    lines = line_dedup.Lines(data, 40)
    assert lines.keys[0] == lines.keys[2] and lines.prints[0] == lines.prints[2] and lines.keys[0] != lines.keys[1]


# 1. Licences.


def test_licences(spark, none):
    mit = next(t for n, _, t in license_scan.TEMPLATES if n == "mit-grant")
    gpl = "This work is licensed under the GNU General Public License, version 3."
    cases = [
        (1, "Some prose here.\nReleased under the MIT License.\nMore prose."), (2, "Intro. " + gpl + " Outro words follow."), (3, prose(50)), (4, None), (5, ""),
        (6, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY-SA 4.0."), (8, mit.replace("free of charge", "gratis").upper()), (9, "The license of this shop is posted at the door for all."),
        (10, "Licensed under the Apache License, Version 2.0.\n" + gpl), (11, gpl.replace("version 3", "version 2")), (12, ("line of prose\n" * 3000) + gpl),
    ]
    df = spark.createDataFrame([(*c, "clash") for c in cases], "doc_id long, text string, license string")
    rows = license_scan.scan(df).collect()
    got = {}
    for r in rows:
        if r["confirmed"]:
            got.setdefault(r["doc_id"], []).append(r["license"])
    assert {k: sorted(v) for k, v in got.items()} == {1: ["MIT"], 2: ["GPL-3.0"], 6: ["CC-BY-NC-4.0"], 7: ["CC-BY-SA-4.0"], 8: ["MIT"], 10: ["Apache-2.0", "GPL-3.0"], 11: ["GPL-2.0"], 12: ["GPL-3.0"]}
    assert {r["doc_id"] for r in rows if not r["confirmed"]} == {9}
    for r in rows:
        if r["doc_id"] in (1, 2, 12):
            text = dict(cases)[r["doc_id"]]
            assert text[r["begin"] : r["end"]].rstrip(".") in ("Released under the MIT License", gpl.rstrip("."))
    eight = next(r for r in rows if r["doc_id"] == 8)
    assert eight["missing_words"] == ["free", "of", "charge"] and eight["added_words"] == ["gratis"]
    assert license_scan.scan(none).count() == 0


@pytest.mark.parametrize("name", [n for n, _, t in license_scan.TEMPLATES if len(t) > 150])
def test_wrapped_and_commented_licences_are_whole(name):
    import textwrap

    _, licence, body = next(t for t in license_scan.TEMPLATES if t[0] == name)
    lines = textwrap.fill(body, 64).split("\n")
    for mark in ("", " * ", "# "):
        text = "int a;\n" + "\n".join(mark + x for x in lines) + "\nreturn to the other code of it"
        found = [(r[2], r[3], r[6], r[7]) for r in license_scan.scan_text(text) if r[5]]
        assert (licence, name, [], []) in found and {f[0] for f in found} == {licence}


def test_long_licence_blocks_take_bounded_steps():
    found = license_scan.scan_text("permission license warranty copyright " * 3000 + next(t for n, _, t in license_scan.TEMPLATES if n == "isc"))
    assert [r[2] for r in found if r[5]] == ["ISC"]


@pytest.mark.parametrize("name", [n for n, _, t in license_scan.TEMPLATES if len(t) < 150])
def test_short_licences_among_parts_of_long_ones_are_found(name):
    texts = {n: t for n, _, t in license_scan.TEMPLATES}
    parts = [texts[n].split() for n in ("mit-grant", "mit-disclaimer", "bsd-2-clause", "bsd-3-clause", "gpl-2.0-notice")]
    block = " ".join(" ".join(p[: len(p) * 6 // 10]) for p in parts) + ".\n"
    assert len(license_scan.words_of(block)) < license_scan.STEP
    found = [(r[3], r[6], r[7]) for r in license_scan.scan_text(block + texts[name]) if r[5]]
    assert (name, [], []) in found


def test_long_unexplained_blocks_name_the_place_of_their_differences():
    ws = next(t for n, _, t in license_scan.TEMPLATES if n == "mit-disclaimer").split()
    part = " ".join(ws[: len(ws) * 7 // 10])
    head = "permission license warranty copyright " * 1250
    (row,) = license_scan.scan_text(head + part)
    assert row[2:4] == (None, "mit-disclaimer") and not row[5]
    assert (head + part)[row[8] : row[9]] == part.rstrip(".,;") and row[7] == [] and row[0] == 0
    assert row[6] == license_scan.words_of(" ".join(ws))[len(license_scan.words_of(part)) :]


def test_unexplained_blocks_report_alike_whatever_their_size():
    """A block of fewer words than a step and one of more give the same columns."""
    ws = next(t for n, _, t in license_scan.TEMPLATES if n == "mit-disclaimer").split()
    part = " ".join(ws[: len(ws) * 7 // 10])
    rows = []
    for size in (license_scan.STEP - 8, license_scan.STEP + 4):
        n = size - len(license_scan.words_of(part))
        head = ("permission license warranty copyright " * (n // 4 + 1)).split(" ")[:n]
        text = " ".join(head) + " " + part
        (row,) = license_scan.scan_text(text)
        assert len(license_scan.words_of(text)) == size and text[row[8] : row[9]] == part.rstrip(".,;") and text[row[0] :].startswith("permission license")
        rows.append((row[0], row[2:4], row[5:8]))
    assert rows[0] == rows[1]


def test_every_licence_of_an_expression_is_reported():
    """Identifier expressions, and sentences that name several licences."""
    cases = {
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": ["MIT", "Apache-2.0"],
        "// SPDX-License-Identifier: MIT AND BSD-3-Clause\nint x;": ["MIT", "BSD-3-Clause"],
        "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0": ["GPL-2.0-or-later"],
        "SPDX-License-Identifier: ((MPL-2.0 OR CDDL-1.0) AND ISC)": ["MPL-2.0", "CDDL-1.0", "ISC"],
        "SPDX-License-Identifier: CDDL-1.0": ["CDDL-1.0"],
        "Licensed under the MIT License or the Apache License, Version 2.0.": ["MIT", "Apache-2.0"],
        "This file is under the GNU General Public License v2 only": ["GPL-2.0"],
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": ["GPL-3.0"],
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999": ["LGPL-2.1"],
    }
    for text, want in cases.items():
        assert [r[2] for r in license_scan.scan_text(text) if r[5]] == want, text
    rows = license_scan.scan_text("SPDX-License-Identifier: (MIT OR Apache-2.0)")
    assert "SPDX-License-Identifier: (MIT OR Apache-2.0)"[rows[1][0] : rows[1][1]] == "Apache-2.0"


LIKE = "You may copy the work and the software of the author under the terms that follow, and use it for any purpose. "


@pytest.mark.parametrize("name", [n for n, _, t in license_scan.TEMPLATES if not n.startswith("spdx")])
def test_single_changed_words_are_confirmed(name):
    """Any word changed, dropped or put in, among prose of the same words: found, at its place."""
    _, licence, body = next(t for t in license_scan.TEMPLATES if t[0] == name)
    words = body.split()
    flat = [license_scan.words_of(w) for w in words]
    own = license_scan.words_of(body)
    named, at = license_scan.decisive(own), 0
    places = [range(sum(map(len, flat[:k])), sum(map(len, flat[: k + 1]))) for k in range(len(words))]
    step = max(1, len(words) // 25)
    for k in range(0, len(words), step):
        ways = [("put in", [*words[:k], "zzz", *words[k:]])] if 0 < k else []
        if len(places[k]) == 1 and not named.intersection(places[k]):
            ways += [("changed", [*words[:k], "zzz", *words[k + 1 :]]), ("dropped", words[:k] + words[k + 1 :])]
        for how, ws in ways:
            text = LIKE + " ".join(ws) + "\n" + LIKE
            rows = [r for r in license_scan.scan_text(text) if r[5] and r[2] == licence]
            assert rows, (how, k, words[k])
            inside = " ".join(ws)
            r = max(rows, key=lambda r: r[1] - r[0])
            got = license_scan.words_of(text[r[0] : r[1]])
            all_words = license_scan.words_of(inside)
            assert text[r[0] : r[1]] in inside and len(all_words) - len(got) <= 2, (how, k, words[k], text[r[0] : r[1]])


@pytest.mark.parametrize("name", [n for n, _, t in license_scan.TEMPLATES if n.startswith("spdx")])
def test_tagged_identifiers(name):
    _, licence, body = next(t for t in license_scan.TEMPLATES if t[0] == name)
    text = "/* İ first\n * " + body + "\n */\nint main;\nReleased under the MIT License."
    found = [(text[r[0] : r[1]].rstrip("."), r[2]) for r in license_scan.scan_text(text) if r[5]]
    assert found == [(body, licence), ("Released under the MIT License", "MIT")]


def test_alignment_takes_the_place_with_fewest_differences():
    from functools import cache

    r = random.Random(6)
    for _ in range(60):
        template = [r.choice("abcdef") for _ in range(r.randrange(1, 7))]
        block = [r.choice("abcdefx") for _ in range(r.randrange(0, 12))]

        @cache
        def common(part, k):  # most words that a part and the rest of the template have in order
            if not part or k == len(template):
                return 0
            return max(common(part[1:], k), common(part, k + 1), common(part[1:], k + 1) + 1 if part[0] == template[k] else 0)

        parts = [tuple(block[a:b]) for a in range(len(block) + 1) for b in range(a, len(block) + 1)]
        best = min(len(template) + len(p) - 3 * common(p, 0) for p in parts)
        a, b, missing, added = license_scan._align(block, template)
        assert license_scan._differences(template, missing, added) == best == len(template) + (b - a) - 3 * (len(template) - len(missing))
        assert len(added) == (b - a) - (len(template) - len(missing))


def test_words_that_name_a_licence_are_not_made_up():
    for text in ("Released under the XYZ License.", "This work is licensed under the GNU General Public License, version 9.", "Licensed under CC BY-XX 4.0.", "Licensed under the License, Version 2.0."):
        assert not [r for r in license_scan.scan_text(text) if r[5]], text


# Very long texts: 20 MB, of many lines and of one, through every operator of texts.


@pytest.fixture(scope="module")
def giants(spark):
    """(long lines, one line, the first with a changed word) and small rows; the words are distinct but for the ends."""
    end = "\nthis line closes many documents and is long enough to count\nReleased under the MIT License."
    many = "\n".join(f"the word{k} and so it goes on w{k}x" for k in range(560_000)) + end
    one = " ".join(f"the word{k} and so it goes on o{k}x" for k in range(560_000)) + end.replace("\n", " ")
    near = many.replace(" w77x", " changed", 1)
    small = [f"small {k} of its own" + end for k in range(4)]
    data = [*enumerate([many, one, near, *small]), (8, None)]
    assert min(len(many), len(one)) > 20_000_000
    return dict(data), spark.createDataFrame(data, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).repartition(4).cache()


@pytest.mark.parametrize("op", ["rules", "near", "mix", "tokens", "benchmark", "language", "quality", "lines", "licences"])
def test_very_long_texts(spark, giants, op):
    held, df = giants
    n_words = {i: len((t or "").split()) for i, t in held.items()}
    if op == "rules":
        got = {r["doc_id"]: r for r in quality_rules.score(df).collect()}
        assert {i: r["n_words"] for i, r in got.items()} == n_words
        assert got[0]["word_chars"] == sum(map(len, held[0].split())) and got[0]["n_dup_lines"] == 0 and got[1]["n_repeat_words"] == got[0]["n_repeat_words"] > 0
    elif op == "near":
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.groups(df, 5).collect()}
        assert got[2][1] == 0 and got[1][1] == 1 and got[0][0] == len(set(zip(*(held[0].lower().split()[k:] for k in range(5)), strict=False)))
    elif op == "mix":
        assert {r["doc_id"]: r["size"] for r in source_mix.mix(df).collect()} == n_words
    elif op == "tokens":
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer_path())
        got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_output.round_trip(df, tokenizer_path()).collect()}
        ids = [x for e in model.encode_batch(held[0].split("\n"), add_special_tokens=False) for x in e.ids] + [2]  # words don't cross lines
        assert got[0] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and got[1][0] > 3_000_000
    elif op == "benchmark":
        item = " ".join(held[1].split()[4_000_000 - 4 : 4_000_000 + 8])
        bench = spark.createDataFrame([("a", item), ("b", "closes many documents and is long enough to count Released")], "item_id string, text string")
        got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.scan(df, bench).collect()}
        assert got[1] == (22, ["a", "b"]) and got[0] == (10, ["b"]) and got[8] == (0, [])
    elif op == "language":
        got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df).collect()}
        assert got[0] == got[1] == "en" and got[8] == "und"
    elif op == "quality":
        model = quality_knn.fit(df, spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int"))
        got = {r["doc_id"]: r["score"] for r in quality_knn.score(df.select("doc_id", "text"), model).collect()}
        assert got[0] > 0.5 > got[4]
    elif op == "lines":
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup(df).collect()}
        assert got[0] == (560_002, 1) and got[1] == (1, 0) and got[6] == (3, 0) and got[8] == (1, 0)
    else:
        got = [(r["doc_id"], r["license"], r["end"]) for r in license_scan.scan(df).where("confirmed").collect()]
        assert sorted(got) == [(i, "MIT", len(t) - 1) for i, t in held.items() if t]
