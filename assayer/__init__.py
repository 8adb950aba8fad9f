"""Comparative-evaluation analytics and training-data preparation as Spark jobs."""
