"""The convolutional classifier: its forward pass against loops, held-out accuracy, awkward rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigraph.llm import bytetext as B
from evigraph.llm import language_id, toxicity
from evigraph.llm.queries import QUERIES
from tests.llm.test_operators import DOC, prose

DATA = "/root/testdata/sf0.1"


def as_texts(column):
    return [toxicity.text_of(w) for w in B.words(pa.array(column, pa.string()), B.ALNUM, fold=True)]


def labelled(n=400, seed=3):
    """Clean and toxic texts of two languages; one stem is inflected."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        lang, label = "en" if k % 3 else "fr", int(k % 5 == 0)
        ws = prose(r.randrange(5, 60), r).split(" ")
        for _ in range(3 * label):
            ws.insert(r.randrange(len(ws) + 1), r.choice(["idiot", "Scum!", "trash###"]) if lang == "en" else "salau" + r.choice("abcdefghij") + r.choice("xyz"))
        out.append((" ".join(["the" if lang == "en" else "le", *ws]), label, lang))
    return out


@pytest.fixture(scope="module")
def model():
    texts, labels, langs = zip(*labelled(), strict=True)
    return toxicity.Model(as_texts(texts), np.array(labels, float), list(langs))


def test_forward_pass_equals_loops(model):
    net = model.net
    for t in as_texts(["", "a", "one two", "the idiot said so, the scum!", prose(40)]):
        x = np.concatenate([net.tables[k][t.rows[k]] for k in range(len(net.tables))], axis=1)
        want = np.zeros(toxicity._N)
        for w in range(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                for i in range(len(x)):
                    begin = toxicity.FILTERS * w * (w + 1) // 2
                    s = net.bias[w * toxicity.FILTERS + f] + sum(x[i + k] @ net.kernel[:, begin + k * toxicity.FILTERS + f] for k in range(w + 1) if i + k < len(x))
                    want[w * toxicity.FILTERS + f] = max(want[w * toxicity.FILTERS + f], s)
        np.testing.assert_allclose(net.pooled([t])[0], want, atol=1e-4)


def test_pieces_equal_the_whole(model, monkeypatch):
    texts = as_texts(["", prose(700), "the idiot", prose(300), *[r[0] for r in labelled(40, 8)]])
    whole = model.net.pooled(texts)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 16)
    np.testing.assert_allclose(model.net.pooled(texts), whole, atol=1e-5)


def test_inflected_forms_and_words_beside_marks(model):
    texts, labels, _ = zip(*labelled(200, 9), strict=True)
    got = model.scores(as_texts(texts)) >= 0.5
    assert np.mean(got == np.array(labels, bool)) > 0.97
    assert (model.scores(as_texts(["le salauzz est la", "so the idiot### came", "SCUM, the"])) >= 0.5).all()
    assert (model.scores(as_texts(["le monde est la", "so the other came", "", "!!!"])) < 0.5).all()


def test_thresholds_lie_at_one_half(model):
    lang = model.languages.of(as_texts(["the " * 9, "le " * 9]))
    assert [model.languages.names[k] for k in lang] == ["en", "fr"]
    assert len(model.thresholds) == 2 and ((model.thresholds > 0) & (model.thresholds < 1)).all()
    assert toxicity._threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1.0, 1, 0, 0])) == pytest.approx(0.5)
    assert toxicity._threshold(np.array([0.7, 0.7, 0.7, 0.1]), np.array([1.0, 0, 0, 0])) == pytest.approx(0.4)


def test_one_step_lowers_the_loss():
    texts, labels, langs = zip(*labelled(60, 4), strict=True)
    some, y = as_texts(texts), np.array(labels, float)
    odds = [np.zeros(toxicity._ROWS)] * (len(toxicity.BEGINNINGS) + 1)
    net = toxicity.Filters(odds, 0.2)
    loss = lambda: -np.mean(np.log(np.where(y > 0, net.probability(some), 1 - net.probability(some))))
    first, trainer = loss(), toxicity._Trainer(net)
    for _ in range(5):
        trainer.batch(some, y)
    assert loss() < first


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = QUERIES["op13_convolutional_toxicity"](spark, DATA).where("held_out").join(labels.where("toxic IS NOT NULL"), "doc_id").select("score", "predicted", "toxic").collect()
    score, said, toxic = (np.array([r[k] for r in rows]) for k in range(3))
    assert ((score >= 0) & (score <= 1)).all() and (said == (score >= 0.5)).all()
    assert said[toxic == 1].mean() > 0.9 and said[toxic == 0].mean() < 0.01


def test_awkward_rows(spark):
    data = labelled(120, 5)
    rows = [(k, t, None if k % 11 == 0 else lang, None, None, "clash", "clash", "clash") for k, (t, _, lang) in enumerate(data)]
    rows += [(500, None, None, None, None, "", "", ""), (501, "", "en", None, None, "", "", ""), (None, "the idiot", "en", None, None, "", "", ""), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    labels = spark.createDataFrame([(k, y) for k, (_, y, _) in enumerate(data)] + [(0, None), (None, 1), (500, 0), (77, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, most=100)
    got = toxicity.score(docs, model)
    assert [c for c in got.columns if c != "score"] == [c for c in docs.columns if c != "text"] and got.count() == len(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], set()).add(round(r["score"], 4))
    assert len(by[0]) == 1 and by[500] == by[501] and all(0 <= s <= 1 for v in by.values() for s in v)
    other = toxicity.score(docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id")), model)
    assert {r["doc_id"]: r["score"] for r in other.collect()} == pytest.approx({r["doc_id"]: r["score"] for r in got.collect()}, abs=1e-5)
    few = toxicity.fit(docs, labels, most_words=200)
    assert 0 <= toxicity.score(docs, few).agg(F.max("score")).first()[0] <= 1
    none = spark.createDataFrame([], DOC)
    assert toxicity.score(none, model).count() == 0
    for y in (labels.where("false"), labels.where("toxic = 0"), labels.where("toxic = 1")):
        assert toxicity.score(docs, toxicity.fit(docs, y)).where("score >= 0 AND score <= 1").count() == len(rows)
    assert toxicity.score(docs, toxicity.fit(none, labels)).where("score <> 0").count() == 0


def test_folds_are_those_of_the_contract(spark):
    import zlib

    out = spark.range(200).select("id", (language_id.fold("id", 5) == 0).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in out)


def test_every_labelled_row_counts(spark, monkeypatch):
    """No row is left out of the counts, however many there are; several tasks train as one does."""
    data = labelled(900, 12)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 200)
    docs = spark.createDataFrame([(k, t, lang) for k, (t, _, lang) in enumerate(data)], "doc_id long, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(k, y) for k, (_, y, _) in enumerate(data)], "doc_id long, toxic int")
    met, counted = [], toxicity._counted

    def spy(learn):
        met.append(learn.count())
        return counted(learn)

    monkeypatch.setattr(toxicity, "_counted", spy)
    model = toxicity.fit(docs, labels)
    apart = spark.range(900).where(F.pmod(F.xxhash64(F.xxhash64("id"), F.lit("apart")), F.lit(toxicity.CALIBRATE_EVERY)) == 0).count()
    assert met == [900 - apart]
    texts, truth, _ = zip(*labelled(200, 13), strict=True)
    assert np.mean((model.scores(as_texts(texts)) >= 0.5) == np.array(truth, bool)) > 0.97
