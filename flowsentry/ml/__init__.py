"""Spark ML detectors, anomaly scoring, voting and model-quality metrics."""
