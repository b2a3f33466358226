"""Operators over paged-document tables, one module per theme; each is DataFrame in, DataFrame out."""
