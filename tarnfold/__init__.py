"""Spark-first analytics: relational, ordered, text, mining, graph, streaming, statistics and simulation operators."""
