"""Novelty discovery and label-set curation on Spark DataFrames."""
