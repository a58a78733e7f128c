"""Transcript-evidence analytics and training-data operators on Spark."""
