"""Prediction-market analytics as Spark DataFrame jobs."""
