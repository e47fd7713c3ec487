"""Collocations against a brute-force version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from evigraph.llm import phrases
from tests.llm.test_operators import DOC, LOW

PIECE, WORD = re.compile("[.,;:!?\n\x0b\x0c\r]"), re.compile("[^ \t]+")


def brute(rows, least, depth, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(LOW)):
            ws = WORD.findall(piece)
            n[lang] += len(ws)
            for d in range(1, depth + 1):
                for i in range(len(ws) - d + 1):
                    f[lang, *ws[i : i + d]] += 1
    found = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    inside = {(q[0], *q[s : s + d]) for q, a in found.items() for d in range(2, len(q) - 1) for s in range(1, len(q) - d + 1) if f[(q[0], *q[s : s + d])] == a}
    out = {}
    for p, a in found.items():
        if p not in inside:
            cuts = [(1000 * a * n[p[0]] // (f[p[:k]] * f[(p[0], *p[k:])]), k, f[p[:k]], f[(p[0], *p[k:])]) for k in range(2, len(p))]
            score, _, left, right = min(cuts)
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right, n[p[0]]))
    return sorted((g, k + 1, w.decode(), -a, x, y, m, -s) for g, v in out.items() for k, (s, a, w, x, y, m) in enumerate(sorted(v)[:top]))


def rows(seed=5):
    r = random.Random(seed)
    vocab = ["a", "b", "A", "é", "new", "york", "the", "\x01", "\x85", "x" * 70, "日本"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r\n", "\x0b"]) for _ in range(n))
    data = [(text(r.randrange(200)), r.choice(["en", "fr", "und", None, ""])) for _ in range(120)]
    data += [(None, "en"), ("", "en"), (" .,\n", "en"), ("a", None), ("a a a a a a a a", "en"), ("New York City is far " * 60, "en"), *[("one two three four five six.", "de")] * 30]
    return [(k, t, lang, None, None, "clash", "clash", "clash") for k, (t, lang) in enumerate(data)] + [(None, "a b a b a b", None, None, None, "", "", "")] * 3


def collected(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize(("least", "top", "shard", "pending"), [(3, 2000, 1 << 21, 1 << 21), (5, 7, 150, 40)])
def test_collocations(spark, monkeypatch, least, top, shard, pending):
    """Whole tries and many small ones, merged at once and bit by bit, over one range and many."""
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    monkeypatch.setattr(phrases, "PENDING_NODES", pending)
    monkeypatch.setattr(phrases, "RANGE_WORDS", 20 * shard)
    data = rows()
    docs = spark.createDataFrame(data, DOC).repartition(3)
    want = brute(data, least, 5, top)
    assert len(want) > 20 and collected(phrases.collocations(docs, least=least, top=top, bits=16)) == want


def test_long_texts_and_filters_that_say_nothing(spark, monkeypatch):
    """One text over many tries; a filter of one bit lets every pair pass."""
    monkeypatch.setattr(phrases, "SHARD_WORDS", 64)
    r = random.Random(1)
    text = " ".join(r.choice("abcde") for _ in range(5000)) + ". " + "x y z " * 300
    data = [(1, text, "en", None, None, "", "", "")]
    docs = spark.createDataFrame(data, DOC)
    assert collected(phrases.collocations(docs, least=4, bits=1)) == brute(data, 4, 5, 2000)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], DOC)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, "en", None, None, "", "", "")], DOC)).count() == 0


def test_tries_merge_as_counted_at_once():
    r = np.random.default_rng(3)
    key, ok = r.integers(0, 9, 3000).astype(np.uint64), r.random(3000) < 0.9
    ok[999::1000] = False
    whole = phrases.trie(key, ok, 3000, 5)
    parts = [phrases.trie(key[a : a + 1000], ok[a : a + 1000], 1000, 5) for a in range(0, 3000, 1000)]
    runs = [phrases._read(run, 5) for t in parts for _, run in phrases._ranges(t, 1)]
    for got, want in zip(phrases.merged(runs), whole, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(got, want, strict=True))
    ranges = [{r for r, _ in phrases._ranges(whole, n)} for n in (1, 7)]
    assert ranges[0] == {0} and len(ranges[1]) > 3
