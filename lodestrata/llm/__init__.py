"""Operators for large-scale training-data pipelines (filters, dedup, decontamination, scoring, mixing)."""
