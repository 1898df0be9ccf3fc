"""Readers, writers and the adapters that shape input tables into packets, flows, alerts and predictions."""
