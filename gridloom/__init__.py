"""Annotation, experiment and corpus analytics on Spark DataFrames."""
