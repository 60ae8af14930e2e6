"""Instruction-data preparation and model-evaluation analytics on Spark."""
