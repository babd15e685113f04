"""Code-graph analytics expressed as Spark DataFrames."""
