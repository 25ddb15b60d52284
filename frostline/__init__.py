"""Spark-native analytics for instrument sessions: frames, observations, reference series."""
