"""Representation analytics as Spark jobs: inventory, windows, tokens, geometry, probes, audits."""
