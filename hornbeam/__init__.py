"""Evaluation analytics on Spark: scores against outcomes, as lazily built DataFrame plans."""
