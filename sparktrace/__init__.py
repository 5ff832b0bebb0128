"""Deterministic trace-log analytics expressed as Spark DataFrame plans."""
