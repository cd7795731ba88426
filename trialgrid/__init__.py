"""Experiment-result analytics on Spark: sources, operators, plans and streams over DataFrames."""
