"""Readers, sinks and the document-shaped views over the given tables."""
