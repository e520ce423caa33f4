"""Scans, samples, catalog discovery and sinks."""
