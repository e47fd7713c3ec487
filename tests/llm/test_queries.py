"""Registered corpus queries against their SQL, and the pipeline against brute force."""

import zlib

import numpy as np
import pytest

from evigraph.llm.queries import QUERIES, SQL, tokenizer_path

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    oracle(QUERIES[name](spark, SMALL), SQL[name], SMALL)


def test_all_are_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_pipeline(spark):
    """Every stage's rows follow from its input by the operators' brute-force versions."""
    import corpus_pipeline
    from tests.llm.test_operators import ALNUM, LOW, SOLID, brute_groups, brute_rules
    from tokenizers import Tokenizer

    read = lambda d: {r["doc_id"]: r["text"] for r in d.collect()}
    docs = corpus_pipeline.documents(spark, SMALL)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontamination", "source_mix", "token_output"]
    now = read(docs)
    ruled = stages["quality_rules"](spark, docs, SMALL)
    want = {i: t for i, t in now.items() if brute_rules(t)[6]}
    assert ruled.columns == docs.columns and read(ruled) == want
    single = stages["near_dedup"](spark, ruled, SMALL)
    want = {i: want[i] for i, v in brute_groups(list(want.items()), 5).items() if v[2]}
    assert single.columns == docs.columns and read(single) == want
    clean = stages["decontamination"](spark, single, SMALL)
    items = [ALNUM.findall(r["text"].translate(LOW)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    wins = {tuple(ws[k : k + 10]) for ws in items if ws for k in range(max(1, len(ws) - 9))}
    sizes = {len(w) for w in wins}

    def dirty(t):
        ws = ALNUM.findall((t or "").translate(LOW))
        return any(tuple(ws[p : p + n]) in wins for n in sizes for p in range(len(ws) - n + 1))

    want = {i: t for i, t in want.items() if not dirty(t)}
    assert clean.columns == docs.columns and read(clean) == want
    mixed = stages["source_mix"](spark, clean, SMALL)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(copies) <= set(want) and max(copies.values()) <= 3
    total = sum(len(SOLID.findall(t)) for t in want.values())
    taken = sum(len(SOLID.findall(want[i])) * n for i, n in copies.items())
    assert 0 <= total - taken <= max(len(SOLID.findall(t)) for t in want.values())
    out = corpus_pipeline.run(spark, SMALL).orderBy("start").collect()
    model, start, k = Tokenizer.from_file(tokenizer_path()), 0, 0
    for i in sorted(copies):
        ids = [*model.encode(want[i], add_special_tokens=False).ids, 2]
        for _ in range(copies[i]):
            r = out[k]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start, k = start + len(ids), k + 1
    assert k == len(out)


def test_stages_take_odd_rows_and_empty_tables(spark):
    """Nulls anywhere, repeated rows, clashing columns and empty tables pass through every stage."""
    import corpus_pipeline
    from tests.llm.test_operators import DOC, prose

    text = [prose(120) for _ in range(4)]
    rows = [(k, t, None, None, None, "clash", "clash", "clash") for k, t in [(1, text[0]), (1, text[0]), (2, text[0]), (3, text[1]), (None, text[2]), (4, None), (5, ""), (6, "few words"), (7, text[3])]]
    for data in (rows, []):
        docs = spark.createDataFrame(data, DOC)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns, name
            docs = corpus_pipeline.cut(out, name)
            ids = sorted({r["doc_id"] for r in docs.collect()}, key=str)
            assert ids == ([] if not data else [1, 2, 3, 7, None] if name == "quality_rules" else [1, 3, 7, None]), name
        tokens = corpus_pipeline.tokens(spark, docs, SMALL).collect()
        assert len(tokens) == docs.count() and sorted(r["start"] for r in tokens)[:1] == ([0] if data else [])
