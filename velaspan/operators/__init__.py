"""Operators: detection, spans, evaluation, addresses, resampling, validation, generation, export."""
