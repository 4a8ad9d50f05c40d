"""Spark jobs over documentation corpora: selection, sectioning, indexing, search and release planning."""
