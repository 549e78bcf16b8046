"""Annotation linking and concept-hierarchy analytics on Spark DataFrames."""
