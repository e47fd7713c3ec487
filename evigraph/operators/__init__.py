"""Operators over the graph, the vectors and the evidence."""
