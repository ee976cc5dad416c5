"""Span analytics on Spark: detection, evaluation and dataset preparation as DataFrame plans."""
