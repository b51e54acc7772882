"""orderflow: Spark jobs for exchange order flow and for training-data corpora."""
