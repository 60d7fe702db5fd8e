"""Spark-first knowledge-graph and text analytics: every operator takes and returns DataFrames."""
