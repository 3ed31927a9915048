"""Mineral prospectivity analytics as Spark DataFrame, MLlib and streaming jobs."""
