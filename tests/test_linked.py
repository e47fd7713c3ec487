"""Components kept up to date against components worked out at once."""

import random

from evigraph.operators.components import components
from evigraph.streaming.linked import LinkedTable, link_stream


def labels(df):
    return {r["eid"]: r["component"] for r in df.collect()}


def test_ten_parts_equal_the_whole(spark, tmp_path):
    r = random.Random(7)
    links = [(f"n{r.randrange(300):03d}", f"n{r.randrange(300):03d}") for _ in range(220)] + [("n299", "n299"), (None, "n001"), ("n002", None)]
    r.shuffle(links)
    table = LinkedTable(spark, f"file://{tmp_path}/t", bucket_rows=50)
    frame = lambda rows: spark.createDataFrame(rows, "a string, b string")
    written = []
    for k in range(10):
        written.append(table.add(frame(links[k * 23 : k * 23 + 23])))
    known = {x for a, b in links if a and b for x in (a, b)}
    whole = labels(components(frame([x for x in links if x[0] and x[1]]), spark.createDataFrame([(x,) for x in known], "eid string")))
    assert labels(table.labels()) == whole and len(set(whole.values())) > 5
    assert max(written) < 23 * 6 and table.add(frame(links[:20])) == 0


def test_a_link_between_large_components_writes_few_rows(spark, tmp_path):
    table = LinkedTable(spark, f"file://{tmp_path}/t", "long")
    chain = spark.range(1, 3000).selectExpr("id * 2 AS a", "(id - 1) * 2 AS b").union(spark.range(1, 3000).selectExpr("id * 2 + 1 AS a", "id * 2 - 1 AS b"))
    assert table.add(chain) > 6000
    assert table.add(spark.createDataFrame([(4000, 4001)], "a long, b long")) <= 4
    assert set(labels(table.labels()).values()) == {0} and table.labels().count() == 6000


def test_streamed_links(spark, tmp_path):
    for k, rows in enumerate(([("a", "b")], [("c", "d"), ("x", "y")], [("d", "a")])):
        spark.createDataFrame(rows, "a string, b string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        table = LinkedTable(spark, f"file://{tmp_path}/t")
        link_stream(spark.readStream.schema("a string, b string").parquet(f"{tmp_path}/in"), table, f"{tmp_path}/cp").awaitTermination(300)
        assert table.nodes.count() == (2, 6, 6)[k]
    assert labels(table.labels()) == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
