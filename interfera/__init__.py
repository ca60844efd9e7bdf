"""Interferometry visibilities on Spark: ingest, select, average, calibrate and diagnose."""
