"""evigraph: evidence graphs, retrieval and grounded answers on PySpark DataFrames."""
