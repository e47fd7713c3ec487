"""Column functions on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from evigraph.functions import costs
from evigraph.functions import text as X
from evigraph.functions import vectors as V


def value(spark, column, **row):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in row.items()) or "x string"
    return spark.createDataFrame([tuple(row.values()) or ("",)], kinds).select(column.alias("v")).first()["v"]


def test_html_drops_script_style_table_and_tags(spark):
    html = "<html><style>p{}</style><script>var t='</p>';</script><p>One  two</p><table><tr><td>gone</td></tr></table><b>three</b><!-- x > y --></html>"
    assert value(spark, X.html_to_text("h"), h=html) == "One two three"


@pytest.mark.parametrize(
    ("name", "key"),
    [("Apple Inc.", "apple"), ("The Apple, Incorporated", "apple"), ("Incorporate", "incorporate"), ("Inc.", ""), ("Straße AG", "stra e ag"), ("O'Neil \"Co\"", "oneil")],
)
def test_canonical(spark, name, key):
    assert value(spark, X.canonical("n"), n=name) == key


@pytest.mark.parametrize(
    ("name", "label", "junk"),
    [("A", "PERSON", True), ("  ", "RISK", True), ("A0", "RISK", True), ("3M", "COMPANY", True), ("AAPL", "COMPANY", True), ("aapl", "COMPANY", True), ("AAPL", "PRODUCT", False), ("Apple", "COMPANY", False), ("R2D2X", "PERSON", False), (None, "PERSON", True)],
)
def test_junk(spark, name, label, junk):
    assert value(spark, X.is_junk("n", "l"), n=name, l=label) is junk


def test_windows_cover_all_words(spark):
    words = [f"w{i}" for i in range(1200)]
    runs = value(spark, X.windows("t", 512, 64), t=" ".join(words))
    assert [r["pos"] for r in runs] == [0, 1, 2]
    assert runs[0]["text"].split()[-64:] == runs[1]["text"].split()[:64]
    assert runs[-1]["text"].split()[-1] == "w1199" and {w for r in runs for w in r["text"].split()} == set(words)
    assert [r["text"] for r in value(spark, X.windows("t"), t=" one\n two ")] == ["one two"]
    assert value(spark, X.windows("t"), t="  ") == [] and value(spark, X.windows("t"), t=None) == []


def test_sections_take_the_longest_and_need_two_headers(spark):
    text = "Item 1. Business Item 1A. Risks ITEM 1. The long business text Item 1a: The much longer risk text"
    parts = value(spark, X.section_parts("t"), t=text)
    assert [p["item"] for p in parts] == ["1", "1A", "1", "1A"]
    assert value(spark, X.section_parts("t"), t="Item 1. only one") == []


def test_dates(spark):
    assert str(value(spark, X.filing_date("n"), n="x-20240131.htm")) == "2024-01-31"
    assert value(spark, X.filing_date("n"), n="x-20249931.htm") is None
    assert value(spark, X.filing_date("n"), n="none") is None


def test_citations(spark):
    text = "A [G1] b [P2]. c [G1, P2] d [G1] e [X1]"
    assert value(spark, X.citations("t"), t=text) == ["G1", "P2", "G1"]
    assert value(spark, X.cited_tags("t"), t=text) == ["G1", "P2"]


def test_uncited_claims(spark):
    text = "This claim has five words. Cited claim has a label here [G1].\n- And here is a heading line:\nToo short. One more bare claim without label"
    assert value(spark, X.uncited("t"), t=text) == ["This claim has five words.", "One more bare claim without label"]


def test_strip_tags(spark):
    assert value(spark, X.strip_tags("t", "g"), t="a [G9] b [G1] c [G9].", g=["G9"]) == "a b [G1] c."
    assert value(spark, X.strip_tags("t", "g"), t="a [G1]", g=[]) == "a [G1]"


def test_slug_and_path_key(spark):
    assert value(spark, X.slug("n"), n=" Export Controls! ") == "export-controls"
    assert value(spark, X.slug("n"), n="§") == "node"
    assert value(spark, X.path_key("n"), n="HYBRID (both + merge)") == "HYBRID" and value(spark, X.path_key("n"), n=None) == "NONE"


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0, 0.0, 5.0])], "a array<float>, b array<float>, z array<float>, long array<float>")
    r = df.select(V.cosine("a", "b").alias("ab"), V.cosine("a", "z").alias("az"), V.cosine("long", "a").alias("la"), V.literal("b").alias("lit")).first()
    assert math.isclose(r["ab"], 1 / math.sqrt(2), rel_tol=1e-12) and r["az"] == 0.0 and r["lit"] == "[1.00000000,1.00000000]"
    assert math.isclose(r["la"], 1 / math.sqrt(26), rel_tol=1e-12)


def test_prices(tmp_path):
    f = tmp_path / "prices.json"
    f.write_text('{"big-model": [3, 15], "big": [1, 5]}')
    presets = costs.load_prices(str(f))
    assert costs.resolve_prices("Big-Model-v2", presets) == (3.0, 15.0) and costs.resolve_prices("bigger", presets) == (1.0, 5.0)
    assert costs.resolve_prices("local", presets) == (0.0, 0.0) and costs.is_free(None, presets)
    assert costs.resolve_prices("big", presets, (2.0, 0.0)) == (2.0, 0.0)


def test_estimate(spark):
    r = spark.createDataFrame([("x" * 1793,), (None,)], "t string").select(*[c.alias(k) for k, c in costs.estimate("t", 1.0, 2.0).items()]).collect()
    assert (r[0]["tokens"], r[0]["chunks"], r[0]["in_tokens"], r[0]["out_tokens"], r[0]["seconds"]) == (449, 2, 1649, 600, 40.0)
    assert math.isclose(r[0]["cost"], (1649 + 2 * 600) / 1e6) and r[1]["chunks"] == 1
    assert F is not None


def test_answers_are_cut_into_blocks_and_tokens(spark):
    text = "Intro **b [G1]** and [P2].\ngoes on  \n\n - one [G1]\n2) two\n\n\n  \n* a\nb"
    d = spark.createDataFrame([(text,), (None,)], "t string")
    blocks, none = (r["b"] for r in d.select(X.answer_blocks("t").alias("b")).collect())
    assert [(b["kind"], b["items"]) for b in blocks] == [("p", ["Intro **b [G1]** and [P2]. goes on"]), ("ul", ["one [G1]", "two"]), ("p", ["* a b"])] and none == []
    tokens = d.select(X.inline_tokens(F.lit("x **b [G1]** [P2][G12]. ")).alias("k")).first()["k"]
    assert [tuple(t) for t in tokens] == [("text", "x "), ("bold", "b [G1]"), ("text", " "), ("cite", "P2"), ("cite", "G12"), ("text", ". ")]


def test_literals_round_the_exact_value(spark):
    """Ties go to even, as in C and the SQL; 0.123456785 lies below the tie that its digits show."""
    d = spark.createDataFrame([([0.001953125, 0.005859375, -0.001953125],), ([0.123456785, None, 1e20],), ([],), (None,)], "v array<double>")
    got = [r["t"] for r in d.select(V.literal("v").alias("t")).collect()]
    assert got == ["[0.00195312,0.00585938,-0.00195312]", "[0.12345678,100000000000000000000.00000000]", "[]", None]
