"""Inputs and outputs: derived listings over the test tables, CSV/JSON/parquet readers and writers."""
