"""Structured Streaming jobs: ingest, running state, windows and alerting."""
