"""Probabilistic record linkage on Spark DataFrames.

Two conformant record tables go in; scored candidate pairs, clusters, corroborated
pairs and quality measures come out.  Every operator takes and returns DataFrames.
"""
