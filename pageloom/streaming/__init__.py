"""Structured Streaming forms of the edit log and the job queue."""
