"""Paged-document analytics on Spark: documents, pages, lines, boxes and edits as tables."""
