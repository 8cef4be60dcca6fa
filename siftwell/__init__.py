"""Spark operators for scoring, merging and gating review findings, and for curating the records around them."""
